"""Queries over the driver's tables: each has a DataFrame form and, where SQL can say it, a SQL form."""
