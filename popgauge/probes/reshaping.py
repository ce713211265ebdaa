"""Set operations and reshaping (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.functions.text import fill
from popgauge.operators import reshape as X
from popgauge.operators import tabulate as T
from popgauge.operators.cells import distinct_cells
from popgauge.plans.scoring import RUN, detail_table
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table, u_sql
from popgauge.spec import task_frame


@probe("union_results", """SELECT doc_id AS id, 'docs' AS source, lang FROM documents UNION ALL SELECT item_id, 'items', NULL FROM benchmark
UNION ALL SELECT page_id, 'pages', NULL FROM pages""")
def union_results(spark, folder):
    return X.union_results({
        "docs": table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang"),
        "items": table(spark, folder, "benchmark").select(F.col("item_id").alias("id")),
        "pages": table(spark, folder, "pages").select(F.col("page_id").alias("id")),
    }, "source")


@probe("distinct_cells", f"WITH {S.SURVEY} SELECT DISTINCT priority, region, brand FROM survey")
def distinct(spark, folder):
    return distinct_cells(S.survey(spark, folder, "priority", "region", "brand"), ["priority", "region", "brand"])


@probe("except_levels", """SELECT DISTINCT 'o_orderpriority' AS variable, o_orderpriority AS level FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def except_levels(spark, folder):
    allowed = spark.createDataFrame(
        [("o_orderpriority", "1-URGENT"), ("o_orderpriority", "2-HIGH"), ("o_orderstatus", "F")], "variable string, level string"
    )
    return X.except_levels(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"], allowed)


@probe("melt", """SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def melt(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return X.melt(part, ["p_partkey"], ["p_size", "p_retailprice"], "measure", "value")


@probe("pivot_scores", f"""WITH {S.SCORES}
SELECT task_id, task_name, dataset, """ + ", ".join(
    f"round(max(score) FILTER (model = '{m}'), 6) AS {m}" for m in sorted(S.MODEL_OF_REGION.values())
) + " FROM scores WHERE NOT prob GROUP BY ALL")
def pivot_scores(spark, folder):
    models = sorted(S.MODEL_OF_REGION.values())
    wide = X.pivot_scores(S.scores(spark, folder).where(~F.col("prob")), models)
    return wide.select("task_id", "task_name", "dataset", *[r6(m).alias(m) for m in models])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O"]


@probe("encode_categoricals", f"""WITH {S.SURVEY}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN rebate = 'yes' THEN 1 ELSE 0 END AS rebate, CASE WHEN status = 'O' THEN 1 ELSE 0 END AS status,
  CAST(CASE priority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 WHEN '1-URGENT' THEN 5 END AS INTEGER) AS priority, region,
  {", ".join(f"CASE WHEN segment = '{s}' THEN 1 ELSE 0 END AS segment_{s}" for s in SEGMENTS)} FROM survey""")
def encode(spark, folder):
    df = S.survey(spark, folder, "rebate", "status", "priority", "segment", "region").drop("weight", "spend")
    levels = {
        "rebate": ["yes", "no"], "status": STATUSES, "segment": SEGMENTS,
        "priority": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"],
        "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    }
    return X.encode_categoricals(df, levels, ordered=["priority"], keep=["region"])


@probe("flatten_results", f"""WITH {S.TRUTH}
SELECT task_id, cond, 'Reality' AS side, level, round(w, 6) AS w FROM reality""")
def flatten(spark, folder):
    records = T.ground_truth(S.truth_cells(spark, folder))
    return T.flatten_results(records, "true_vals", "true_weights", "Reality").withColumn("w", r6("w"))


PROMPTS = " ".join(f"WHEN {t.task_id} THEN '{t.prompt}'" for t in S.LOW)


@probe("detail_table", f"""WITH {S.ANSWERS},
o AS (SELECT task_id, level, CAST(row_number() OVER (PARTITION BY task_id ORDER BY level) - 1 AS INTEGER) AS lvl FROM lvls),
b AS (SELECT s.model, s.prompting, s.task_id, s.cond, o.lvl, s.level AS lvl_names, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM spine s JOIN told USING (model, prompting, task_id, cond) JOIN o USING (task_id, level)
  LEFT JOIN reality USING (task_id, cond, level) LEFT JOIN mdl USING (model, prompting, task_id, cond, level))
SELECT model, prompting, task_id, cond, lvl, lvl_names, 'Reality' AS type, round(p, 6) AS prop, replace(CASE task_id {PROMPTS} END, '{{}}', cond) AS prompt FROM b
UNION ALL SELECT model, prompting, task_id, cond, lvl, lvl_names, 'Model', round(q, 6), replace(CASE task_id {PROMPTS} END, '{{}}', cond) FROM b""")
def detail(spark, folder):
    from pyspark.sql import Window

    cells = S.low_cells(spark, folder)
    truth = S.truth_of(cells)
    # A handful of levels per task.
    order = F.row_number().over(Window.partitionBy("task_id").orderBy("level"))
    levels = T.task_levels(truth).withColumn("ord", order)
    shown = detail_table(truth, S.answers_of(cells), levels)
    prompts = task_frame(spark, S.LOW).select("task_id", "prompt")
    return shown.join(F.broadcast(prompts), "task_id").select(
        *RUN, "task_id", "cond", "lvl", "lvl_names", "type", r6("prop").alias("prop"),
        fill("prompt", F.col("cond")).alias("prompt"),
    )


@probe("task_grid", f"""WITH v AS (SELECT o_orderpriority AS v_cond, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS ord FROM (SELECT DISTINCT o_orderpriority FROM orders)),
o AS (SELECT DISTINCT l_returnflag AS v_out FROM lineitem),
two AS (SELECT a.v_cond || ',' || b.v_cond AS v_cond, 2 AS dim, a.ord * 100 + b.ord AS code FROM v a JOIN v b ON a.ord < b.ord),
three AS (SELECT a.v_cond || ',' || b.v_cond || ',' || c.v_cond AS v_cond, 3 AS dim, (a.ord * 100 + b.ord) * 100 + c.ord AS code FROM v a JOIN v b ON a.ord < b.ord JOIN v c ON b.ord < c.ord),
four AS (SELECT t.v_cond || ',' || v.v_cond AS v_cond, 4 AS dim, t.code * 100 + v.ord AS code FROM three t JOIN v ON t.code % 100 < v.ord),
five AS (SELECT t.v_cond || ',' || v.v_cond AS v_cond, 5 AS dim, t.code * 100 + v.ord AS code FROM four t JOIN v ON t.code % 100 < v.ord),
g AS (SELECT v_out, v_cond, dim, code FROM (SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four UNION ALL SELECT * FROM five) CROSS JOIN o)
SELECT v_out, v_cond, dim FROM g QUALIFY row_number() OVER (PARTITION BY v_out, dim ORDER BY {u_sql("code", stream=42)}, code) <= 4""")
def task_grid(spark, folder):
    from pyspark.sql import Window

    # Variable names taken from the data: distinct priorities and flags, a handful of each.
    names = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("v_cond")).distinct()
    conditions = names.withColumn("ord", F.row_number().over(Window.orderBy("v_cond")))
    outcomes = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("v_out")).distinct()
    grid = X.task_grid(outcomes, conditions, cap=4)
    return grid.withColumn("v_cond", F.array_join("v_cond", ","))
