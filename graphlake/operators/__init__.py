"""Graph, text, validation, inference, cache and access operators over DataFrames."""
