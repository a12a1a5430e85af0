"""The registered queries: each applies operators to the tables, with SQL of the same result."""
