"""Predicates and scalar expressions, as Spark columns."""
