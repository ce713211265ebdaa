"""From raw columns to scores: a table builder, its tasks of the catalog, floors and bench scores in one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgauge.functions.labels import INF, interval_scheme
from popgauge.operators.floors import bootstrap_floor
from popgauge.operators.tabulate import merge_cells, task_cells
from popgauge.plans import builds as B
from popgauge.plans.catalog import low_dim_tasks
from popgauge.plans.scoring import RUN, eval_low_dim
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table
from popgauge.session import cut_lineage
from popgauge.spec import task_frame

TASKS = [t for t in low_dim_tasks() if t.dataset == "scf"]

#: Order lines under the raw column names of the household survey.
RAW = {
    "foodhome": "l_extendedprice / 10", "foodaway": "l_tax * 20000", "fooddelv": "l_discount * 10000",
    "age": "CAST(l_partkey % 80 + 15 AS INT)", "hhsex": "CAST(l_suppkey % 2 + 1 AS INT)", "racecl5": "CAST(l_orderkey % 5 + 1 AS INT)",
    "edcl": "CAST(l_linenumber % 4 + 1 AS INT)", "married": "CAST(l_orderkey % 2 + 1 AS INT)", "kids": "CAST(l_suppkey % 3 AS INT)",
    "hhouses": "CAST(l_partkey % 2 AS INT)", "income": "l_extendedprice", "rent": "l_quantity * 20", "asset": "l_extendedprice * l_quantity",
    "debt": "l_extendedprice * l_linenumber", "networth": "l_extendedprice * (l_quantity - l_linenumber)", "wgt": "l_quantity",
}


def _bands(column: str, breaks: list[float]) -> str:
    return S.band_sql(column, *interval_scheme(breaks, "US dollars"))


_AGES = S.band_sql("age", [*B.FIVE_YEAR_TOPS, 89, INF], [*B.FIVE_YEAR_LABELS, "85-89", "90+"])
_CODES = {"sex": ("hhsex", {1: "Male", 2: "Female"}), "race": ("racecl5", B.SCF_RACE), "education": ("edcl", B.SCF_EDUCATION),
          "house_own": ("hhouses", {1: "yes", 0: "no"})}
CLEAN = f"""raw AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in RAW.items())} FROM lineitem),
clean AS (SELECT {_AGES} AS age_group, {", ".join(f"{S.case_sql(f'CAST({c} AS VARCHAR)', m)} AS {n}" for n, (c, m) in _CODES.items())},
  {_bands("foodhome + foodaway + fooddelv", B.SCF_BREAKS["food"])} AS food_group, {", ".join(f"{_bands(c, B.SCF_BREAKS[c])} AS {c}_group" for c in ("asset", "debt", "networth"))},
  kids, income, wgt AS weight FROM raw)"""
LONG = " UNION ALL ".join(
    f"SELECT {t.task_id} AS task_id, {t.condition} AS cond, {t.outcome} AS level, weight AS w, income AS mw, 'model ' || kids AS model, 'QA' AS prompting FROM clean"
    for t in TASKS)


@probe("build_tasks_scores", f"""WITH {CLEAN},
long AS ({LONG}){S.ANSWERS[len(S.long_sql()):]}{S.floors_sql(8)}
SELECT model, prompting, task_id, round(score, 6) AS score, round(worst, 6) AS worst, round(best, 6) AS best,
  round({S.bench_sql("score", "worst", "best")}, 6) AS bench FROM runs JOIN floors USING (task_id)""")
def build_tasks_scores(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "lineitem").select(*[F.expr(sql).alias(name) for name, sql in RAW.items()])
    clean = B.scf(raw).withColumn("model", F.concat(F.lit("model "), "kids")).withColumn("prompting", F.lit("QA"))
    cells = cut_lineage(task_cells(clean, TASKS, RUN, extra={"mw": F.col("income")}))
    truth = merge_cells(cells)
    answers = merge_cells(cells.where(F.col("cond").isNotNull()), *RUN, weight="mw")
    runs = eval_low_dim(truth, answers, bootstrap_floor(truth, task_frame(spark, TASKS)))
    return runs.select(*RUN, "task_id", *[r6(c).alias(c) for c in ("score", "worst", "best", "bench")])
