"""Registered queries: operators bound to tables, with the SQL that they are held against."""
