"""Library analytics, transition planning and sequencing on Spark DataFrames."""
