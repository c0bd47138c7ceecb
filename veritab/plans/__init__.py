"""Registered queries, and for each the SQL that states what it must return."""
