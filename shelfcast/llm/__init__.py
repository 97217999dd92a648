"""Operators that prepare training data for language models, each a Spark job over DataFrames."""
