"""Queries over the test tables, with SQL for those that SQL expresses."""
