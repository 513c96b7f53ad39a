"""Registered queries, their input views and the SQL they are checked against."""
