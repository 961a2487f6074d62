"""Queries by name, and the SQL that they are checked against."""
