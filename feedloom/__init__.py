"""feedloom: event-feed analytics expressed as Spark DataFrames."""
