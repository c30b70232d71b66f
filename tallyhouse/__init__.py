"""Governed analytics on Spark: DataFrame-in, DataFrame-out operators."""
