"""Security-event analytics on Spark: DataFrame operators, sources, functions and streams."""
