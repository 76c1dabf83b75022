"""Security-log analytics on Spark: logs in, canonical events, findings and alerts out."""

from vigilake.session import configure

__all__ = ["configure"]
