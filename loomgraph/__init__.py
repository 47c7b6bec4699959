"""loomgraph: knowledge-graph analytics and data preparation on Spark."""
