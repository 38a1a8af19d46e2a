"""Queries over the TPC-H-style tables, each with the SQL that states its result."""
