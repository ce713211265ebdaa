"""Projections, recodes and predicates (2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.functions import recode as R
from popgauge.operators import tabulate as T
from popgauge.operators.concepts import Concept, select_concepts
from popgauge.operators.filters import drop_headings, keep_until
from popgauge.operators.reshape import ordered_levels
from popgauge.plans.names import DATASET_NAMES, MODEL_NAMES
from popgauge.plans.reports import dashboard_filter, is_sensitive, small_tasks
from popgauge.probes import survey as S
from popgauge.probes.inputs import landed_sheets, sheet_of
from popgauge.probes.registry import probe, r6, scratch, table
from popgauge.sources import read_sheet
from popgauge.spec import task_frame

PRIORITY_LABELS = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "normal", "5-LOW": "low"}


@probe("recode_map", """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'normal' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS priority FROM orders""")
def recode_map(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", R.recode_map("o_orderpriority", PRIORITY_LABELS).alias("priority"))


@probe("recode_binary", """SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS toxic,
  CASE WHEN quality IN (1, 2) THEN 'good' ELSE 'other' END AS quality FROM documents d LEFT JOIN labels USING (doc_id)""")
def recode_binary(spark, folder):
    df = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return df.select("doc_id", R.recode_binary("toxic", 1, "yes", "no").alias("toxic"),
                     R.recode_binary("quality", [1, 2], "good", "other").alias("quality"))


@probe("recode_rules_fcase", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'builder'
  WHEN c_acctbal > 5000 THEN 'rich' END AS kind FROM customer""")
def recode_rules(spark, folder):
    customer = table(spark, folder, "customer")
    kind = R.recode_rules([
        (F.col("c_acctbal") < 0, "debt"), (F.col("c_mktsegment") == "BUILDING", "builder"),
        (F.col("c_acctbal") > 5000, "rich"),
    ])
    return customer.select("c_custkey", kind.alias("kind"))


@probe("recode_last_wins", """SELECT s_suppkey, CASE WHEN s_nationkey > 20 THEN 'Abroad' WHEN s_nationkey IN (4, 5, 6, 7) THEN 'West'
  WHEN s_nationkey IN (3, 4, 5) THEN 'South' WHEN s_nationkey IN (1, 2, 3) THEN 'North' END AS area FROM supplier""")
def recode_last(spark, folder):
    key = F.col("s_nationkey")
    area = R.recode_last_wins([
        (key.isin(1, 2, 3), "North"), (key.isin(3, 4, 5), "South"), (key.isin(4, 5, 6, 7), "West"), (key > 20, "Abroad"),
    ])
    return table(spark, folder, "supplier").select("s_suppkey", area.alias("area"))


@probe("coerce_numeric", """SELECT c_custkey, TRY_CAST(replace(replace(c_name, 'Customer#', ''), ',', '') AS DOUBLE) AS number,
  TRY_CAST(c_mktsegment AS DOUBLE) AS none, c_acctbal AS balance FROM customer""")
def coerce_numeric(spark, folder):
    customer = table(spark, folder, "customer")
    # Thousands separators as the landed sheets have them.
    shown = F.format_number("c_acctbal", 2)
    return customer.select(
        "c_custkey", R.coerce_numeric(F.regexp_replace("c_name", "^Customer#", "")).alias("number"),
        R.coerce_numeric("c_mktsegment").alias("none"), R.coerce_numeric(shown, strip=",").alias("balance"),
    )


@probe("sentinel_to_null", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS segment,
  CAST(NULLIF(c_nationkey, 0) AS VARCHAR) AS nation FROM customer""")
def sentinel_to_null(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.select("c_custkey", R.sentinel_to_null("c_mktsegment", "BUILDING", "MACHINERY").alias("segment"),
                           R.sentinel_to_null("c_nationkey", 0).cast("string").alias("nation"))


@probe("null_fill", "SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def null_fill(spark, folder):
    df = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return df.select("doc_id", R.null_fill("quality", 0).alias("quality"), R.null_fill("toxic", 0).alias("toxic"))


@probe("ordinal_label", """SELECT s_suppkey, CASE s_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS label FROM supplier""")
def ordinal_label(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", R.ordinal_label("s_nationkey", ["one", "two", "three"]).alias("label")
    )


@probe("derive_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax * l_extendedprice, 4) AS total,
  round(100 * l_quantity / (l_quantity + l_linenumber), 6) AS pct, round(100 - 100 * l_quantity / (l_quantity + l_linenumber), 6) AS rest FROM lineitem""")
def derive_columns(spark, folder):
    q, share = F.col("l_quantity"), F.col("l_discount")
    pct = 100 * q / (q + F.col("l_linenumber"))
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        *S.IDS, F.round(price * (1 - share) + F.col("l_tax") * price, 4).alias("total"),
        r6(pct).alias("pct"), r6(100 - pct).alias("rest"),
    )


@probe("ordered_levels", """SELECT o_orderkey, o_orderpriority AS priority,
  CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 0 END AS INTEGER) AS ord FROM orders""")
def ordered(spark, folder):
    order = spark.createDataFrame(
        [(level, i + 1) for i, level in enumerate(["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"])], "level string, ord int"
    )
    df = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return ordered_levels(df, "priority", order).withColumn("ord", F.coalesce("ord", F.lit(0)))


@probe("select_rename", "SELECT p_type AS kind, p_partkey AS id, p_size AS size FROM part")
def select_rename(spark, folder):
    names = {"p_type": "kind", "p_partkey": "id", "p_size": "size"}
    return table(spark, folder, "part").select(*names).withColumnsRenamed(names)


@probe("concept_select", """SELECT c_custkey AS id, c_acctbal AS balance, CASE WHEN c_nationkey = 1 THEN 'Male' ELSE 'Female' END AS sex,
  orders_n, CASE WHEN orders_n IN (1, 2, 3, 4, 5) THEN 1 ELSE 0 END AS weekly, spent
FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS orders_n FROM orders GROUP BY 1) n ON k = c_custkey""")
def concept_select(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "id")
    tables = {
        "CUST": table(spark, folder, "customer").withColumnRenamed("c_custkey", "id"),
        "SPEND": orders.select("id", "o_totalprice"),
        "COUNTS": orders.groupBy("id").agg(F.count(F.lit(1)).alias("n")),
    }
    concepts = [
        Concept("balance", "CUST", "c_acctbal"), Concept("sex", "CUST", "c_nationkey", "nhanes_sex"),
        Concept("orders_n", "COUNTS", "n"), Concept("weekly", "COUNTS", "n", "nhanes_alcohol"),
        Concept("spent", "SPEND", "o_totalprice", total=True),
    ]
    out = select_concepts(tables, concepts, "id")
    return out.withColumns({"spent": F.round("spent", 2), "weekly": F.coalesce("weekly", F.lit(0))})


@probe("name_map_default", f"""SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'LLama3 8B' WHEN 1 THEN 'IPEDS' ELSE s_name END AS shown FROM supplier""")
def name_map(spark, folder):
    raw = F.when(F.col("s_nationkey") % 3 == 0, "llama3_8b").when(F.col("s_nationkey") % 3 == 1, "edu").otherwise(F.col("s_name"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", R.name_or_self(R.name_or_self(raw, MODEL_NAMES), DATASET_NAMES).alias("shown")
    )


@probe("filter_cond_range", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 40")
def filter_cond_range(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_size").alias("psize"))
    task = S.LOW[3]
    return part.where(task.in_scope()).withColumnRenamed("psize", "p_size")


@probe("filter_subset", """SELECT o_orderkey, 'lwr' AS kind FROM orders WHERE o_totalprice >= 100000
UNION ALL SELECT o_orderkey, 'levels' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_subset(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")
    )
    lower = orders.where(S.LOW[2].subset.predicate()).select("o_orderkey", F.lit("lwr").alias("kind"))
    levels = orders.where(S.LOW[5].subset.predicate()).select("o_orderkey", F.lit("levels").alias("kind"))
    return lower.unionByName(levels)


@probe("filter_weight_age", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_nationkey >= 18")
def filter_weight_age(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.where((F.col("c_acctbal") > 0) & (F.col("c_nationkey") >= 18)).select("c_custkey", "c_acctbal")


@probe("filter_not_null", """SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def filter_not_null(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return df.select("doc_id", "lang", "quality").dropna(subset=["quality"])


@probe("filter_headings", """SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('small ring', 'red widget')
  AND NOT regexp_matches(p_name, '(?i)\\bhot\\b')""")
def filter_headings(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return drop_headings(part, "p_name", ["small ring", "red widget"], r"\bhot\b")


@probe("filter_prefix_rows", """WITH o AS (SELECT *, o_orderkey // 5000 AS sheet, row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) + 1 AS line FROM orders),
m AS (SELECT sheet, min(line) AS until FROM o WHERE o_orderpriority = '5-LOW' AND o_totalprice > 490000 GROUP BY 1)
SELECT sheet, line, o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS day FROM o LEFT JOIN m USING (sheet) WHERE until IS NULL OR line <= until""")
def filter_prefix_rows(spark, folder):
    """Landed sheets, each cut at its own last row by the lines' numbers in the file."""
    path = scratch(spark, "order-sheets")
    orders = table(spark, folder, "orders").withColumn("sheet", F.expr("o_orderkey DIV 5000"))
    landed_sheets(orders, "o_orderkey", ["o_orderkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("day")],
                  ["Orders", "key,priority,total,day"], path)
    rows = read_sheet(spark, path, "o_orderkey bigint, priority string, total double, day string", 1)
    marker = (F.col("priority") == "5-LOW") & (F.col("total") > 490000)
    return keep_until(rows, "line", marker, ["file"]).select(sheet_of("file"), "line", "o_orderkey", "day")


@probe("filter_task_size", f"""WITH {S.SCORES},
sizes AS (SELECT task_id, count(*) AS size FROM hp GROUP BY 1)
SELECT model, task_id, prob, round(score, 6) AS score, size FROM scores JOIN sizes USING (task_id) WHERE size <= 250""")
def filter_task_size(spark, folder):
    sizes = T.task_size_high_dim(S.survey(spark, folder, *S.CELL_COLUMNS), S.HIGH)
    kept = small_tasks(S.scores(spark, folder), sizes)
    return kept.select("model", "task_id", "prob", r6("score").alias("score"), "size")


@probe("filter_dashboard", f"""WITH {S.SCORES}
SELECT model, task_id, dim, round(score, 6) AS score FROM scores WHERE NOT prob AND dataset IN ('acs', 'meps', 'brfss') AND dim IN (1, 3)""")
def filter_dashboard(spark, folder):
    shown = dashboard_filter(S.scores(spark, folder), False, ["acs", "meps", "brfss"], [1, 3])
    return shown.select("model", "task_id", "dim", r6("score").alias("score"))


@probe("is_sensitive", f"""WITH {S.TRUTH}
SELECT task_id, k AS n_levels, task_id IN (2, 3) AS sensitive FROM kk""")
def sensitive(spark, folder):
    counts = T.level_counts(S.truth_cells(spark, folder))
    specs = task_frame(spark, S.LOW).select(
        "task_id", is_sensitive(F.concat(F.array("v_out"), F.col("v_cond")), ("segment", "region")).alias("sensitive")
    )
    return counts.join(specs, "task_id")
