"""Queries: operators applied to the tables in their roles, with their SQL."""
