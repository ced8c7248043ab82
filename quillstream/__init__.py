"""Document analytics on Spark DataFrames: cleaning, routing, grouping, scoring, selection, snapshots."""
