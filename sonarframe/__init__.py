"""sonarframe: signal analytics over Spark DataFrames."""
