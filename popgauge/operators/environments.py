"""Model-made rows and a weighted sample of real ones in one encoded table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgauge.operators.reshape import encode_categoricals
from popgauge.operators.sampling import weighted_sample


def envs_dataset(made: DataFrame, real: DataFrame, variables: Sequence[str], n: int, weight: str,
                 ids: Sequence[str], levels: Mapping[str, Sequence[str]], *, ordered: Sequence[str] = (),
                 keep: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``env`` 1 for the model-made rows, 0 for ``n`` real rows drawn by weight; categoricals encoded."""
    drawn = weighted_sample(real, n, weight, ids, seed=seed).select(*variables, F.lit(0).alias("env"))
    stacked = made.select(*variables, F.lit(1).alias("env")).unionByName(drawn)
    return encode_categoricals(stacked, levels, ordered=ordered, keep=keep)
