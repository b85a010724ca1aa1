"""Spark-native behaviour analytics over enterprise activity logs."""

from vigilume.config import Settings

__all__ = ["Settings"]
