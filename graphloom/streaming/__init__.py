"""Incremental maintenance from streams of files."""

from graphloom.streaming import index_stream

__all__ = ["index_stream"]
