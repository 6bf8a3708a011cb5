"""Plans: the registered queries (catalog), their SQL oracle, end-to-end jobs, materialization."""
