"""Joins (2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.operators import joins as J
from popgauge.operators import tabulate as T
from popgauge.operators.answers import mean_logprob
from popgauge.operators.cells import join_cells_back
from popgauge.operators.sampling import inverse_cdf_draws
from popgauge.plans.reports import min_loss_epoch, variant_columns
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table, text_sql, uniform_sql


@probe("join_inner", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_inner(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, folder, "lineitem").select(*S.IDS).join(part, "l_partkey", "inner")


@probe("join_lookup_default", """WITH codes AS (SELECT n_nationkey AS code, n_name AS name, n_regionkey FROM nation WHERE n_regionkey <> 2)
SELECT c_custkey, coalesce(name, '') AS name FROM customer LEFT JOIN codes ON code = c_nationkey""")
def join_lookup_default(spark, folder):
    nation = table(spark, folder, "nation").where("n_regionkey <> 2")
    # The list names every code twice; the later entry counts.
    older = nation.select(F.col("n_nationkey").cast("string").alias("code"), F.lit("old").alias("name"), F.col("n_nationkey").alias("row"))
    newer = nation.select(F.concat(F.lit(" "), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("row"))
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return J.lookup_default(customer, older.unionByName(newer), {"nation": "code"}, "row").select("c_custkey", "name")


@probe("join_cells_back", f"""WITH {S.SURVEY},
c AS (SELECT priority, segment, sum(CASE WHEN rebate = 'yes' THEN weight ELSE 0 END) / sum(weight) AS p FROM survey GROUP BY ALL)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(p, 6) AS p FROM survey JOIN c USING (priority, segment)""")
def join_back(spark, folder):
    df = S.survey(spark, folder, "priority", "segment", "rebate")
    cells = df.groupBy("priority", "segment").agg(
        (F.sum(F.when(F.col("rebate") == "yes", F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("p")
    )
    return join_cells_back(df, cells, ["priority", "segment"]).select(*S.IDS, r6("p").alias("p"))


@probe("join_multi_by_id", """SELECT coalesce(d.doc_id, l.doc_id, b.item_id) AS id, lang, CAST(quality AS VARCHAR) AS quality, item_id IS NOT NULL AS is_item
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id FULL JOIN benchmark b ON b.item_id = coalesce(d.doc_id, l.doc_id)""")
def join_multi(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("quality"))
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.lit(True).alias("is_item"))
    return J.merge_by_id([docs, labels, items], "id").withColumn("is_item", F.coalesce("is_item", F.lit(False)))


@probe("join_self_variants", f"""WITH {S.SCORES},
v AS (SELECT regexp_replace(model, '(_instruct|_chat)', '') AS family, regexp_matches(model, '(_instruct|_chat)') AS tuned, task_id, prob, score FROM scores)
SELECT a.family, a.task_id, a.prob, round(a.score, 6) AS score_x, round(b.score, 6) AS score_y
FROM v a JOIN v b ON a.family = b.family AND a.task_id = b.task_id AND a.prob = b.prob AND NOT a.tuned AND b.tuned""")
def self_variants(spark, folder):
    pairs = J.self_variants(
        S.scores(spark, folder).withColumns(variant_columns("model")), ["family", "task_id", "prob"], "tuned"
    )
    return pairs.withColumns({"score_x": r6("score_x"), "score_y": r6("score_y")})


@probe("join_annotations", """WITH h AS (SELECT event_type AS run, day(ts) AS epoch, CASE WHEN hour(ts) < 12 THEN 'Training' ELSE 'Evaluation' END AS kind, round(avg(value), 8) AS loss_value FROM events GROUP BY ALL),
e AS (SELECT run, epoch FROM h WHERE kind = 'Evaluation' QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss_value, epoch) = 1),
t AS (SELECT run, max(loss_value) AS y_top FROM h GROUP BY 1)
SELECT h.run, CAST(h.epoch AS INTEGER) AS epoch, kind, loss_value, CAST(e.epoch AS INTEGER) AS stop_epoch, round(y_top * 0.6, 6) AS y FROM h LEFT JOIN e ON e.run = h.run LEFT JOIN t ON t.run = h.run""")
def annotations(spark, folder):
    history = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.when(F.hour("ts") < 12, "Training").otherwise("Evaluation").alias("kind"),
    ).agg(F.round(F.avg("value"), 8).alias("loss_value"))
    marks = min_loss_epoch(history, "run").select("run", F.col("epoch").alias("stop_epoch"), r6("y").alias("y"))
    return history.join(marks, "run", "left")


@probe("join_logprob_score", f"""WITH {S.SCORES},
t AS (SELECT CAST(user_id % 7 + 1 AS INTEGER) AS task_id, user_id, avg(-ln(1 + value)) AS lp FROM events GROUP BY ALL),
m AS (SELECT task_id, avg(lp) AS mean_logprob FROM t GROUP BY 1)
SELECT model, task_id, prob, round(mean_logprob, 6) AS mean_logprob, round(score, 6) AS score FROM scores JOIN m USING (task_id)""")
def logprob_score(spark, folder):
    tokens = table(spark, folder, "events").select(
        (F.col("user_id") % 7 + 1).cast("int").alias("task_id"), F.col("user_id").alias("prompt"),
        (-F.ln(1 + F.col("value"))).alias("logprob"),
    )
    means = mean_logprob(tokens, ["task_id"], "prompt", "logprob")
    return S.scores(spark, folder).join(means, "task_id").select(
        "model", "task_id", "prob", r6("mean_logprob").alias("mean_logprob"), r6("score").alias("score")
    )


@probe("align_levels", f"""WITH {S.TRUTH}
SELECT c.task_id, c.cond, l.level, round(coalesce(w, 0), 6) AS w FROM conds c JOIN lvls l USING (task_id)
LEFT JOIN reality USING (task_id, cond, level)""")
def align_levels(spark, folder):
    truth = S.truth_cells(spark, folder)
    return T.align_levels(T.scoped(truth), T.task_levels(truth)).withColumn("w", r6("w"))


@probe("join_inverse_cdf", f"""WITH {S.SURVEY},
t AS (SELECT ptype, psize, qty_band AS level, sum(weight) AS w FROM survey GROUP BY ALL),
c AS (SELECT ptype, psize, level, sum(w) OVER g AS hi, sum(w) OVER g - w AS lo, sum(w) OVER (PARTITION BY ptype, psize) AS total FROM t
  WINDOW g AS (PARTITION BY ptype, psize ORDER BY level)),
d AS (SELECT DISTINCT ptype, psize, i AS draw, {uniform_sql(text_sql("ptype"), "psize", "i", stream=9)} AS u FROM t, generate_series(0, 99) s(i))
SELECT ptype, psize, CAST(draw AS INTEGER) AS draw, level FROM d JOIN c USING (ptype, psize) WHERE u * total >= lo AND u * total < hi""")
def inverse_cdf(spark, folder):
    cells = T.weighted_tabulate(S.survey(spark, folder, "ptype", "psize", "qty_band"), ["ptype", "psize"], "qty_band")
    return inverse_cdf_draws(cells.withColumnRenamed("qty_band", "level"), ["ptype", "psize"], 100, "ptype", "psize", seed=9)


@probe("anti_already_done", f"""SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def anti_done(spark, folder):
    todo = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.already_done(todo, done, ["o_orderkey"])


@probe("audit_truth_join", """WITH e AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS quality, CASE WHEN lang = 'fr' THEN '1' ELSE '0' END AS toxic FROM documents)
SELECT l.doc_id, 'quality' AS variable, CAST(l.quality AS VARCHAR) AS true_value, e.quality AS pred_value FROM labels l JOIN e USING (doc_id) WHERE CAST(l.quality AS VARCHAR) <> e.quality
UNION ALL SELECT l.doc_id, 'toxic', CAST(l.toxic AS VARCHAR), e.toxic FROM labels l JOIN e USING (doc_id) WHERE CAST(l.toxic AS VARCHAR) <> e.toxic""")
def audit(spark, folder):
    guessed = table(spark, folder, "documents").select(
        "doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"), (F.col("lang") == "fr").cast("int").alias("toxic")
    )
    return J.audit(guessed, table(spark, folder, "labels"), "doc_id", ["quality", "toxic"])
