"""Whole queries over the given tables, with SQL that says the same."""
