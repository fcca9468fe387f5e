"""Operators: DataFrame in, DataFrame out, lazily; every window has a total order."""
