"""All registered queries."""

from catalog import itemization, mining, preparation, ranking, regions, studies, trees  # noqa: F401
from catalog.base import ORACLES, QUERIES, forget

__all__ = ["ORACLES", "QUERIES", "forget"]
