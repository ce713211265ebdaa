"""Every operator applied to the driver tables, each next to the SQL that says what it must give."""

from popgauge.probes import (  # noqa: F401
    endtoend, inputs, joins, metrics, models, order, recodes, reports, reshaping, tables, texts,
)
from popgauge.probes.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
