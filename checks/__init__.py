"""Test inputs derived from the given tables, and the SQL that states the expected results."""
