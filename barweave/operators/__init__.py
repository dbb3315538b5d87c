"""User-level operators: DataFrame in, DataFrame out."""
