"""The registered queries: each module has QUERIES (name -> function) and SQL (name -> oracle)."""
