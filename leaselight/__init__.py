"""Bulk valuation of rental listings, and corpus preparation, on Spark DataFrames."""
