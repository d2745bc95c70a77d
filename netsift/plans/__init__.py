"""Queries over the shared test tables, with the views that shape those tables into logs."""
