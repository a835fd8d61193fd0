"""webstrata: analytics over archives of captured HTTP exchanges, on Spark DataFrames."""
