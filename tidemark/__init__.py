"""tidemark: retail-wealth analytics expressed as Spark DataFrame jobs."""

from tidemark.session import build_session

__all__ = ["build_session"]
