"""kvlake: an ordered key-value engine over append-only mutation logs, expressed as Spark DataFrames."""
