"""Named queries over the domain tables; importing a module registers its queries."""

from . import feed, maintenance, markup, stats, streams, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "feed", "maintenance", "markup", "stats", "streams", "text"]
