"""All queries of the library, registered as their modules are imported."""

from . import features, intake, market, operations, point_in_time, records, streams  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
