"""Named queries, their SQL, and the stage graph."""

from . import engine_queries, fleet_queries, geometry_queries, kernel_queries, more_queries, signal_queries  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
