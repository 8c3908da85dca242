"""Registered queries over the given tables, each one with the SQL that must give the same rows."""
