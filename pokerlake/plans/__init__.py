"""The analyses: each function takes tables and returns one result table, unsorted."""
