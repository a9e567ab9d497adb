"""Scalar functions as SQL expressions, valid in Spark SQL and in standard engines alike."""
