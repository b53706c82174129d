"""rollbook: consolidation of heterogeneous record sheets, and analytics over them, on Spark DataFrames."""
