"""riskloom: deterministic risk and site-quality audits as Spark jobs over tables."""

from riskloom.session import build_session

__all__ = ["build_session"]
