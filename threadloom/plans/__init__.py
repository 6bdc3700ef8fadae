"""Iterative plans: loops over DataFrames that cut their lineage in the shared folder."""
