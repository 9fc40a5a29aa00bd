"""Trip telemetry analytics on Spark DataFrames."""
