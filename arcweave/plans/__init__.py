"""Registered queries, the SQL that says what they return, and the adapters that feed them."""
