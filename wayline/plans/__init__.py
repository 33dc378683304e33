"""Registered queries over the driver tables, and the SQL that states what each returns."""
