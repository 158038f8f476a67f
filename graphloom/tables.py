"""Readers for the Parquet tables that the queries run on."""

from graphloom.sources.tables import table

__all__ = ["table"]
