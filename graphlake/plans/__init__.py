"""Query languages compiled to DataFrames, and plan policies."""
