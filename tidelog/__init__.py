"""Event archives, append-only streams and sorted tables on Spark DataFrames."""
