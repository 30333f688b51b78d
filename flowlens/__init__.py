"""Analytics over event and network-flow tables, written for Spark DataFrames, Spark SQL and Structured Streaming."""
