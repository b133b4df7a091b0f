"""Sorting large inventories of files and documents with Spark DataFrames."""

from filewright.config import RetentionPolicy, Taxonomy
from filewright.session import build_session

__all__ = ["RetentionPolicy", "Taxonomy", "build_session"]
