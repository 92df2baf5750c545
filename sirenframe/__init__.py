"""Sirenframe: dispatch documents and their messages -> an incident table, on Spark."""

from sirenframe.session import configure, shared_dir, written

__all__ = ["configure", "shared_dir", "written"]
