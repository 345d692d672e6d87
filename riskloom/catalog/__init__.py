"""All registered queries; importing this package fills the registry."""

from riskloom.catalog import captures, checks, guard, repos, reports, texts, web  # noqa: F401
from riskloom.catalog.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
