"""Contract queries by theme: each module has QUERIES and ORACLE."""
