"""loomgraph: source-graph analytics and corpus operators as lazy PySpark DataFrames."""
