"""Change-data-capture stream engine on Spark DataFrames and Structured Streaming."""

from tidemark.session import build_session, use_utc

__all__ = ["build_session", "use_utc"]
