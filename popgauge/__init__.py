"""Weighted survey-distribution analytics on PySpark DataFrames."""

from popgauge.spec import HighDimTask, LowDimTask
from popgauge.session import ensure_checkpoint_dir, get_session

__all__ = ["HighDimTask", "LowDimTask", "ensure_checkpoint_dir", "get_session"]
