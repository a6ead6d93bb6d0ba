"""The registered queries; importing this module registers them all."""

from . import formats, governance, models, monitor, named, quality, reactions, relational, series, streams, text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
