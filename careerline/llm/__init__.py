"""Operators for preparing training data: ten methods, each a Spark job over a whole table."""
