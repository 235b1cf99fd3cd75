"""A property-graph analytics engine over typed Spark DataFrames."""
