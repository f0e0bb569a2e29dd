"""tessera: behaviour-graph analysis of packages and event-like data, built on Spark DataFrames."""
