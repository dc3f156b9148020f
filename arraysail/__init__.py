"""Labelled numerical arrays (samples by features with named coordinates) as Spark DataFrames."""

from arraysail.session import session

__all__ = ["session"]
