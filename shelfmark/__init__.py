"""Catalog analytics on Spark: lazy DataFrame transforms and Column expressions."""
