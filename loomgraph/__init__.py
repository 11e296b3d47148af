"""loomgraph: graph retrieval and corpus preparation on Spark DataFrames."""
