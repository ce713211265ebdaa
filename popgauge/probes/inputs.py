"""Sources and sinks (2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge import sources as IO
from popgauge.operators import tabulate as T
from popgauge.operators.floors import bootstrap_floor, missing_floors
from popgauge.operators.sampling import train_val_split
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, scratch, table, uniform_sql
from popgauge.session import cut_lineage
from popgauge.sources.floorstore import FloorStore, fingerprints
from popgauge.spec import task_frame


def landed_sheets(df, order, columns, titles, path):
    """Write one text file a ``sheet``: the title rows, then the columns as delimited lines by rising place."""
    body = df.select("sheet", F.col(order).cast("bigint").alias("place"), F.to_csv(F.struct(*columns)).alias("value"))
    heads = df.select("sheet").distinct().select("sheet", F.posexplode(F.array(*[F.lit(t) for t in titles])).alias("place", "value"))
    lines = body.unionByName(heads.withColumn("place", F.col("place").cast("bigint") - len(titles)))
    lines.repartition("sheet").sortWithinPartitions("sheet", "place").select("sheet", "value").write.partitionBy("sheet").text(path)


def sheet_of(file):
    return F.regexp_extract(file, r"/sheet=(\d+)/", 1).cast("bigint").alias("sheet")


@probe("scan_parquet", """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 10 GROUP BY 1""")
def scan_parquet(spark, folder):
    df = IO.read_parquet(spark, f"{folder}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return df.where("l_quantity > 10").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )


@probe("sink_parquet_if_absent", "SELECT o_orderkey, o_orderstatus FROM orders")
def write_once(spark, folder):
    path = scratch(spark, "once")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    IO.write_once(orders, path)
    # The table is there now: this one leaves it alone.
    IO.write_once(orders.where("o_orderstatus = 'F'"), path)
    return spark.read.parquet(path)


@probe("scan_header_rows_json", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def header_rows(spark, folder):
    """Documents of up to 100 rows under one header each."""
    cells = F.array("o_orderstatus", F.col("o_orderkey").cast("string"), "o_orderpriority")
    head = F.array(F.array(F.lit("status"), F.lit("id"), F.lit("priority")))
    sheets = table(spark, folder, "orders").groupBy(F.expr("o_orderkey DIV 100").alias("sheet")).agg(F.collect_list(cells).alias("rows"))
    return IO.header_rows(sheets.select(F.to_json(F.concat(head, "rows")).alias("doc")), "doc", ["id", "priority", "status"])


@probe("scan_with_skiprows", """SELECT p_partkey // 500 AS sheet, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 3 AS row,
  p_name AS name, p_brand AS brand, p_size AS size FROM part""")
def skip_rows(spark, folder):
    """Landed sheets of up to 500 rows, with three title rows and a header that names other columns."""
    path = scratch(spark, "part-sheets")
    part = table(spark, folder, "part").withColumn("sheet", F.expr("p_partkey DIV 500"))
    landed_sheets(part, "p_partkey", ["p_name", "p_brand", "p_size", "p_type"], ["Parts", "as landed, in full", "", "a,b,c,d"], path)
    rows = IO.read_sheet(spark, path, "name string, brand string, size int", 3)
    return rows.select(sheet_of("file"), F.col("line").alias("row"), "name", "brand", "size")


@probe("scan_csv", "SELECT doc_id, quality, toxic FROM labels")
def scan_csv(spark, folder):
    path = scratch(spark, "labels-csv")
    table(spark, folder, "labels").write.csv(path, header=True)
    return IO.read_csv(spark, path, "doc_id bigint, quality int, toxic int")


RECORDS = f"""WITH {S.ANSWERS}
SELECT model, prompting, r.task_id, cond AS condition, string_agg(level, ';' ORDER BY level) AS model_vals, tw AS total_weight, CAST(n AS BIGINT) AS n_data
FROM ans r JOIN conds c USING (task_id, cond) GROUP BY ALL"""


def _records(spark, folder):
    cells = S.low_cells(spark, folder)
    truth = T.ground_truth(S.truth_of(cells))
    said = F.array_sort(F.collect_list(F.struct("level", "w")))
    answers = S.answers_of(cells).groupBy("model", "prompting", "task_id", F.col("cond").alias("condition")).agg(said.alias("a"))
    return answers.join(truth, ["task_id", "condition"]).select(
        "model", "prompting", "task_id", "condition", "true_vals", "true_weights", "n_data", "total_weight",
        F.col("a.level").alias("model_vals"), F.col("a.w").alias("model_weights"), F.lit(None).cast("string").alias("model_texts"),
    )


@probe("sink_result_json", RECORDS)
def sink_results(spark, folder):
    path = scratch(spark, "results")
    IO.write_results(_records(spark, folder), path)
    back = spark.read.schema("condition string, model_vals array<string>, total_weight double, n_data bigint, model string, prompting string, task_id int").json(path)
    return back.select("model", "prompting", "task_id", "condition", F.array_join("model_vals", ";").alias("model_vals"), "total_weight", "n_data")


@probe("scan_result_json", f"""WITH {S.ANSWERS}
SELECT model, prompting, task_id, cond, level, round(w, 2) AS w FROM ans""")
def scan_results(spark, folder):
    path = scratch(spark, "results")
    IO.write_results(_records(spark, folder), path)
    # Run and task are folder names; the records come from the files.
    read = IO.read_results(spark, path, multi_line=False)
    long = T.flatten_results(read, "model_vals", "model_weights", "Model")
    return long.select("model", "prompting", "task_id", "cond", "level", F.round("w", 2).alias("w"))


def _high_results(spark, folder, path):
    df = S.survey(spark, folder, "rebate", "priority", "segment", "model", "prompting")
    rows = df.select("rebate", "priority", "segment", "weight", (F.col("spend") / 100000).alias("lgbm_pred"),
                     (F.col("weight") / 50).alias("llm_pred"), "model", "prompting", F.lit(101).alias("task_id"), "l_orderkey")
    IO.write_high_dim(rows, path)


@probe("scan_hd_result", f"""WITH {S.SURVEY}
SELECT prompting, priority, segment, round(sum(abs(spend / 100000 - weight / 50) * weight) / sum(weight), 6) AS l1 FROM survey WHERE model = 'phi4' GROUP BY ALL""")
def scan_high(spark, folder):
    path = scratch(spark, "high")
    _high_results(spark, folder, path)
    rows = IO.read_high_dim(spark, path).where("model = 'phi4' AND task_id = 101")
    gap = F.sum(F.abs(F.col("lgbm_pred") - F.col("llm_pred")) * F.col("weight")) / F.sum("weight")
    return rows.groupBy("prompting", "priority", "segment").agg(r6(gap).alias("l1"))


@probe("prune_hd_result", f"""WITH {S.SURVEY}
SELECT rebate, priority, segment, weight, round(spend / 100000, 9) AS lgbm_pred, round(weight / 50, 9) AS llm_pred FROM survey""")
def prune_high(spark, folder):
    path, slim = scratch(spark, "high"), scratch(spark, "high-slim")
    _high_results(spark, folder, path)
    rows = IO.read_high_dim(spark, path)
    IO.prune_high_dim(rows, "rebate", ["priority", "segment"]).write.parquet(slim)
    back = spark.read.parquet(slim)
    return back.withColumns({c: F.round(c, 9) for c in ("lgbm_pred", "llm_pred")})


@probe("scan_map_json", """SELECT event_id, 'k' AS "key", CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events""")
def map_json(spark, folder):
    return IO.map_entries(table(spark, folder, "events"), ["event_id"], "props")


@probe("sink_records_json", f"""WITH {S.SCORES} SELECT model, task_id, dataset, prob, round(score, 6) AS score FROM scores""")
def sink_records(spark, folder):
    path = scratch(spark, "scores")
    scores = S.scores(spark, folder).select("model", "task_id", "dataset", "prob", r6("score").alias("score"))
    IO.write_records(scores, path)
    return spark.read.schema(scores.schema).json(path)


@probe("sink_split_dataset", f"""SELECT CASE WHEN {uniform_sql("doc_id", stream=42)} < 0.8 THEN 'train' ELSE 'validation' END AS split, doc_id, md5(text) AS digest FROM documents""")
def sink_split(spark, folder):
    path = scratch(spark, "split")
    docs = train_val_split(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    IO.write_split(docs, path)
    return spark.read.parquet(path).select("split", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


SPEC_ROWS = ", ".join(
    f"({t.task_id}, '{t.name}', '{t.dataset}', '{t.outcome}', '{t.condition or ''}', '{t.prompt}')" for t in S.LOW
)


@probe("task_spec_table", f"""WITH {S.TRUTH}, s(task_id, name, dataset, v_out, v_cond, prompt) AS (VALUES {SPEC_ROWS})
SELECT s.*, k AS n_levels, CAST((SELECT sum(n) FROM conds c WHERE c.task_id = s.task_id) AS BIGINT) AS n_data FROM s JOIN kk USING (task_id)""")
def spec_table(spark, folder):
    truth = S.truth_cells(spark, folder)
    specs = task_frame(spark, S.LOW).select(
        "task_id", "name", "dataset", "v_out", F.array_join("v_cond", ",").alias("v_cond"), "prompt"
    )
    rows = truth.where(F.col("cond").isNotNull()).groupBy("task_id").agg(F.sum("n").alias("n_data"))
    return specs.join(T.level_counts(truth), "task_id").join(rows, "task_id")


@probe("best_err_store", f"""WITH {S.TRUTH}{S.FLOORS}
SELECT task_id, round(best, 6) AS best_err, FALSE AS missing FROM floors UNION ALL SELECT unnest([101, 102, 103, 104]), -1, TRUE""")
def floor_store(spark, folder):
    """A store filled by scoring: its second use finds every floor; the high-dimensional tasks are still missing."""
    store, truth = FloorStore(spark, scratch(spark, "floors")), cut_lineage(S.truth_cells(spark, folder))
    prints = fingerprints(truth, ["cond", "level"], ["w", "n"])
    for _ in range(2):
        floors = store.floors(prints, lambda ids: bootstrap_floor(truth.where(F.col("task_id").isin(ids)), task_frame(spark, [t for t in S.LOW if t.task_id in ids])))
    tasks = task_frame(spark, [*S.LOW, *S.HIGH]).select("task_id")
    todo = missing_floors(tasks, store.read()).withColumn("missing", F.lit(True))
    known = tasks.join(floors, "task_id", "left").join(todo, "task_id", "left")
    return known.select("task_id", F.coalesce(r6("best_err"), F.lit(-1.0)).alias("best_err"), F.coalesce("missing", F.lit(False)).alias("missing"))
