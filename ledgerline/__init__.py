"""Ledgerline: ordered, immutable event logs as Spark DataFrames."""
