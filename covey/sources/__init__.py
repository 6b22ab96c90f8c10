"""Readers, writers, and the roles of tables."""
