"""Code-knowledge analytics on Spark: call graphs, stage hierarchies and their upkeep as DataFrames."""
