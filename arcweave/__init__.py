"""Link-graph analytics on Spark: extraction, enrichment, layout, tiles, search and paths as DataFrame plans."""
