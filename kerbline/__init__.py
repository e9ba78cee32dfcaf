"""Garage and meter revenue, visit, occupancy and permit analytics on Spark DataFrames."""
