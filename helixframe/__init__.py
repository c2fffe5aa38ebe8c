"""Stratified association analytics and training-data operators on Spark DataFrames."""
