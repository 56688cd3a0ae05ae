"""Relational, ranking and data-quality operators: DataFrame in, DataFrame out."""
