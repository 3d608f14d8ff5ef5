"""Curation of ranked feeds on Spark: every operator maps DataFrames to DataFrames."""

from digestry.settings import Settings

__all__ = ["Settings"]
