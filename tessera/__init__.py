"""Graph, lexical and dense retrieval over DataFrames, and training-data operators."""
