"""Energy time-series analytics for microgrids, written as Spark DataFrame jobs."""

from wattframe.tables import Tables

__all__ = ["Tables"]
