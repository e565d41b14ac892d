"""The operators: extraction, graph, layout, tiles, records and search."""
