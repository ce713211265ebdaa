"""Aggregations and metrics (2.4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from popgauge.functions.labels import cut
from popgauge.operators import answers as A
from popgauge.operators import metrics as M
from popgauge.operators import tabulate as T
from popgauge.operators.cells import cell_sums, mean_baseline, share_positive
from popgauge.operators.floors import bootstrap_floor
from popgauge.plans.reports import min_loss_epoch, zero_score_tasks
from popgauge.plans.scoring import RUN, condition_errors, eval_high_dim, eval_low_dim
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table, uniform_sql
from popgauge.spec import task_frame


@probe("weighted_tabulate", f"WITH {S.SURVEY} SELECT priority, spend_band, round(sum(weight), 6) AS w, "
       "count(*) AS n FROM survey GROUP BY ALL")
def weighted_tabulate(spark, folder):
    df = S.survey(spark, folder, "priority", "spend_band")
    return T.weighted_tabulate(df, ["priority"], "spend_band").withColumn("w", r6("w"))


@probe("weighted_distribution", f"""WITH {S.SURVEY},
t AS (SELECT segment, qty_band, sum(weight) AS w FROM survey GROUP BY ALL)
SELECT segment, qty_band, round(w / sum(w) OVER (PARTITION BY segment), 6) AS p FROM t""")
def weighted_distribution(spark, folder):
    df = S.survey(spark, folder, "segment", "qty_band")
    return T.weighted_distribution(df, ["segment"], "qty_band").select("segment", "qty_band", r6("p").alias("p"))


@probe("ground_truth", f"""WITH {S.TRUTH}
SELECT task_id, cond AS condition, string_agg(level, ';' ORDER BY level) AS true_vals,
  string_agg(CAST(CAST(round(w, 0) AS BIGINT) AS VARCHAR), ';' ORDER BY level) AS true_weights,
  CAST(sum(n) AS BIGINT) AS n_data, round(sum(w), 6) AS total_weight FROM reality GROUP BY ALL""")
def ground_truth(spark, folder):
    records = T.ground_truth(S.truth_cells(spark, folder))
    whole = F.transform("true_weights", lambda w: F.round(w, 0).cast("bigint").cast("string"))
    return records.select(
        "task_id", "condition", F.array_join("true_vals", ";").alias("true_vals"),
        F.array_join(whole, ";").alias("true_weights"), "n_data", r6("total_weight").alias("total_weight"),
    )


@probe("multi_task_distribution", f"""WITH {S.TRUTH}
SELECT task_id, cond, level, round(p, 6) AS p, CAST(n AS BIGINT) AS n FROM reality""")
def multi_task_distribution(spark, folder):
    cells = T.scoped(S.truth_cells(spark, folder))
    shares = T.normalise(cells, ["task_id", "cond"])
    return shares.select("task_id", "cond", "level", r6("p").alias("p"), "n")


@probe("l1_distance", f"""WITH {S.ANSWERS}
SELECT model, prompting, task_id, cond, round(l1, 6) AS l1 FROM errs""")
def l1_distance(spark, folder):
    cells = S.low_cells(spark, folder)
    errors = condition_errors(S.truth_of(cells), S.answers_of(cells))
    return errors.select(*RUN, "task_id", "cond", r6("score").alias("l1"))


@probe("l1_worst_uniform", f"""WITH {S.TRUTH},
sp AS (SELECT task_id, cond, level FROM conds JOIN lvls USING (task_id))
SELECT task_id, cond, round(sum(abs(1.0::DOUBLE / k - coalesce(p, 0))), 6) AS worst
FROM sp LEFT JOIN reality USING (task_id, cond, level) JOIN kk USING (task_id) GROUP BY ALL""")
def l1_worst_uniform(spark, folder):
    truth = S.truth_cells(spark, folder)
    shares = T.normalise(T.scoped(truth), ["task_id", "cond"]).join(T.level_counts(truth), "task_id")
    return shares.groupBy("task_id", "cond").agg(r6(M.l1_to_uniform("p", "n_levels")).alias("worst"))


@probe("cond_weighted_mean", f"""WITH {S.ANSWERS}
SELECT model, prompting, task_id, round(score, 6) AS score, round(worst, 6) AS worst FROM runs""")
def cond_weighted_mean(spark, folder):
    cells = S.low_cells(spark, folder)
    runs = eval_low_dim(S.truth_of(cells), S.answers_of(cells))
    return runs.select(*RUN, "task_id", r6("score").alias("score"), r6("worst").alias("worst"))


@probe("bootstrap_floor", f"WITH {S.TRUTH}{S.FLOORS} SELECT task_id, round(best, 9) AS best_err FROM floors")
def bootstrap_floor_query(spark, folder):
    floors = bootstrap_floor(S.truth_cells(spark, folder), task_frame(spark, S.LOW))
    return floors.withColumn("best_err", F.round("best_err", 9))


@probe("bench_score", f"""WITH {S.SURVEY},
e AS (SELECT brand, sum(abs(discount - 0.05) * weight) / sum(weight) AS score,
  sum(tax * weight) / sum(weight) AS worst, sum(discount * weight) / sum(weight) / 4 AS best FROM survey GROUP BY 1)
SELECT brand, round({S.bench_sql("score", "worst", "best")}, 6) AS bench FROM e""")
def bench_score(spark, folder):
    df = S.survey(spark, folder, "brand", "discount", "tax")
    errors = df.groupBy("brand").agg(
        M.weighted_mean(F.abs(F.col("discount") - 0.05), "weight").alias("score"),
        M.weighted_mean("tax", "weight").alias("worst"),
        (M.weighted_mean("discount", "weight") / 4).alias("best"),
    )
    return errors.select("brand", r6(M.bench_score(F.col("score"), F.col("worst"), F.col("best"))).alias("bench"))


@probe("eval_low_dim", f"""WITH {S.ANSWERS}{S.FLOORS}
SELECT model, prompting, task_id, round(score, 6) AS score, round(worst, 6) AS worst, round(best, 6) AS best,
  round({S.bench_sql("score", "worst", "best")}, 6) AS bench FROM runs JOIN floors USING (task_id)""")
def eval_low(spark, folder):
    cells = S.low_cells(spark, folder)
    runs = eval_low_dim(S.truth_of(cells), S.answers_of(cells), S.floors_of(spark, cells))
    return runs.select(*RUN, "task_id", *[r6(c).alias(c) for c in ("score", "worst", "best", "bench")])


@probe("weighted_l1_rows", f"""WITH {S.SURVEY}
SELECT model, ptype, round(sum(abs(discount - tax) * weight) / sum(weight), 6) AS l1 FROM survey GROUP BY ALL""")
def weighted_l1_rows(spark, folder):
    df = S.survey(spark, folder, "model", "ptype", "discount", "tax")
    return df.groupBy("model", "ptype").agg(
        r6(M.weighted_l1(F.col("discount"), F.col("tax"), F.col("weight"))).alias("l1")
    )


@probe("worst_constant", f"""WITH {S.SURVEY}, {S.CELLS}
SELECT task_id, round(least(sum(p * w), sum((1 - p) * w), sum(abs(p - 0.5) * w)) / sum(w), 6) AS worst
FROM hp GROUP BY 1""")
def worst_constant(spark, folder):
    truth = share_positive(cell_sums(S.survey(spark, folder, *S.CELL_COLUMNS), S.HIGH))
    return truth.groupBy("task_id").agg(r6(M.worst_constant(F.col("p"), F.col("w"))).alias("worst"))


@probe("eval_high_dim", f"""WITH {S.SURVEY}, {S.CELLS}, {S.HIGH_FLOORS}
SELECT model, prompting, task_id, round(score, 6) AS score, round(worst, 6) AS worst, round(best, 6) AS best,
  round({S.bench_sql("score", "worst", "best")}, 6) AS bench FROM hev JOIN hfloors USING (task_id)""")
def eval_high(spark, folder):
    sums = S.high_cells(spark, folder)
    runs = eval_high_dim(S.high_truth_of(sums), S.high_answers_of(sums), S.high_floors_of(spark, folder, sums))
    return runs.select(*RUN, "task_id", *[r6(c).alias(c) for c in ("score", "worst", "best", "bench")])


@probe("baseline_mean", f"""WITH {S.SURVEY}, {S.CELLS},
b AS (SELECT task_id, avg(y) AS q FROM hd GROUP BY 1)
SELECT task_id, round(any_value(q), 6) AS q, round(sum(abs(q - p) * w) / sum(w), 6) AS score
FROM hp JOIN b USING (task_id) GROUP BY 1""")
def baseline_mean(spark, folder):
    df = S.survey(spark, folder, *S.CELL_COLUMNS)
    truth = share_positive(cell_sums(df, S.HIGH))
    guessed = truth.join(F.broadcast(mean_baseline(df, S.HIGH)), "task_id")
    return guessed.groupBy("task_id").agg(
        r6(F.first("q")).alias("q"), r6(M.weighted_l1(F.col("q"), F.col("p"), F.col("w"))).alias("score")
    )


@probe("weighted_corr", f"""WITH {S.SURVEY},
m AS (SELECT model, sum(spend * weight) / sum(weight) AS mx, sum(retail * weight) / sum(weight) AS my FROM survey GROUP BY 1)
SELECT model, round(sum(weight * (spend - mx) * (retail - my)) /
  sqrt(sum(weight * (spend - mx) ** 2) * sum(weight * (retail - my) ** 2)), 6) AS correlation
FROM survey JOIN m USING (model) GROUP BY 1""")
def weighted_corr(spark, folder):
    df = S.survey(spark, folder, "model", "retail")
    corr = M.weighted_corr(df, ["model"], "spend", "retail", "weight", bounded_keys=True)
    return corr.withColumn("correlation", r6("correlation"))


KS = f"""WITH {S.SURVEY},
t AS (SELECT priority, spend, sum(CASE WHEN status = 'O' THEN weight ELSE 0 END) AS wx,
  sum(CASE WHEN status = 'F' THEN weight ELSE 0 END) AS wy FROM survey GROUP BY ALL),
c AS (SELECT priority, spend, sum(wx) OVER o / sum(wx) OVER (PARTITION BY priority) AS cdf_x,
  sum(wy) OVER o / sum(wy) OVER (PARTITION BY priority) AS cdf_y FROM t
  WINDOW o AS (PARTITION BY priority ORDER BY spend))
"""


@probe("ks_weighted", KS + "SELECT priority, round(max(abs(cdf_x - cdf_y)), 6) AS ks FROM c GROUP BY 1")
def ks_weighted(spark, folder):
    df = S.survey(spark, folder, "priority", "status")
    return M.ks_weighted(df, ["priority"], "spend", "status", "weight", ("O", "F")).withColumn("ks", r6("ks"))


@probe("cum_weight", KS + "SELECT priority, spend, round(cdf_x, 6) AS cdf_x, round(cdf_y, 6) AS cdf_y FROM c")
def cum_weight(spark, folder):
    df = S.survey(spark, folder, "priority", "status")
    curve = M.cumulative_weights(df, ["priority"], "spend", "status", "weight", ("O", "F"))
    return curve.select("priority", "spend", r6("cdf_x").alias("cdf_x"), r6("cdf_y").alias("cdf_y"))


@probe("corr_by_dim", f"""WITH {S.SURVEY}, {S.CELLS},
seats AS (SELECT model, task_id, w, p, q, row_number() OVER (PARTITION BY model, task_id ORDER BY cell) AS seat
  FROM hall WHERE prompting = 'QA' AND q IS NOT NULL),
j AS (SELECT model, task_id, w, p, q + (2 * {uniform_sql("task_id", "seat")} - 1) * 0.001 AS x FROM seats),
m AS (SELECT model, task_id, sum(w * x) / sum(w) AS mx, sum(w * p) / sum(w) AS mp FROM j GROUP BY ALL),
r AS (SELECT model, task_id, sum(w * (x - mx) * (p - mp)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (p - mp) ** 2)) AS c
  FROM j JOIN m USING (model, task_id) GROUP BY ALL)
SELECT model, dim, round(avg(c), 6) AS avg_cor, round(stddev_samp(c), 6) AS sd_cor
FROM r JOIN (VALUES (101, 2), (102, 2), (103, 3), (104, 4)) d(task_id, dim) USING (task_id) GROUP BY ALL""")
def corr_by_dim(spark, folder):
    sums = S.high_cells(spark, folder)
    truth, answers = S.high_truth_of(sums), S.high_answers_of(sums)
    pairs = answers.where(F.col("prompting") == "QA").join(truth, ["task_id", "cell"])
    # The cell's number within its run seeds the noise: cells of one task, in their own order.
    seat = F.row_number().over(Window.partitionBy("model", "prompting", "task_id").orderBy(F.array_join("cell", "|")))
    noisy = pairs.withColumn("seat", seat).withColumn("x", M.jitter(F.col("q"), "task_id", "seat"))
    corr = M.weighted_corr(noisy, ["model", "task_id"], "x", "p", "w", bounded_keys=True)
    dims = task_frame(spark, S.HIGH).select("task_id", "dim")
    out = M.corr_by_dim(corr.join(dims, "task_id"))
    return out.select("model", "dim", r6("avg_cor").alias("avg_cor"), r6("sd_cor").alias("sd_cor"))


@probe("quantile_975", f"""WITH {S.SURVEY}
SELECT ptype, round(quantile_cont(spend, 0.975), 6) AS q975 FROM survey GROUP BY 1""")
def quantile_975(spark, folder):
    return M.quantiles_by(S.survey(spark, folder, "ptype"), ["ptype"], "spend", [0.975]).select("ptype", r6("q0").alias("q975"))


@probe("task_size_hd", f"""WITH {S.SURVEY}, {S.cells_sql()}
SELECT task_id, CAST(any_value(len(string_split(cell, '|'))) AS INTEGER) AS dim, count(DISTINCT cell) AS size FROM hd GROUP BY 1""")
def task_size_hd(spark, folder):
    return T.task_size_high_dim(S.survey(spark, folder, *S.CELL_COLUMNS), S.HIGH)


@probe("task_size_ld", f"""WITH {S.SURVEY}, """ + " UNION ALL ".join(
    f"SELECT {t.task_id} AS task_id, (count(DISTINCT {t.outcome}) - 1) * "
    f"{f'count(DISTINCT {t.condition})' if t.condition else 1} AS size FROM survey" for t in S.LOW
).replace("SELECT 1 AS task_id", "sizes AS (SELECT 1 AS task_id", 1) + ") SELECT task_id, CAST(size AS BIGINT) AS size FROM sizes")
def task_size_ld(spark, folder):
    return T.task_size_low_dim(S.survey(spark, folder, *S.TASK_COLUMNS), S.LOW)


@probe("null_rates", """WITH j AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
r AS (SELECT 100 * avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) AS lang, 100 * avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) AS quality,
  100 * avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END) AS toxic FROM j)
SELECT 'lang' AS "column", round(lang, 6) AS pct_null FROM r UNION ALL SELECT 'quality', round(quality, 6) FROM r
UNION ALL SELECT 'toxic', round(toxic, 6) FROM r""")
def null_rates(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return T.null_rates(df, ["lang", "quality", "toxic"]).withColumn("pct_null", r6("pct_null"))


@probe("sum_per_id", """SELECT l_orderkey, round(sum(l_quantity), 6) AS qty, round(sum(l_extendedprice), 2) AS spend
FROM lineitem GROUP BY 1""")
def sum_per_id(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.groupBy("l_orderkey").agg(
        r6(F.sum("l_quantity")).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("spend")
    )


@probe("split_counts", """WITH g AS (SELECT o_orderpriority AS priority, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS open,
  count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT priority, 'open' AS side, open AS share, a, n, r FROM g UNION ALL SELECT priority, 'closed', 1 - open, a, n, r FROM g)
SELECT priority, side, flag, round(cnt * share, 6) AS weight FROM
(SELECT priority, side, share, 'a' AS flag, a AS cnt FROM s UNION ALL SELECT priority, side, share, 'n', n FROM s
 UNION ALL SELECT priority, side, share, 'r', r FROM s)""")
def split_counts(spark, folder):
    df = S.survey(spark, folder, "priority", "status", "flag")
    margins = df.groupBy("priority").agg(
        F.avg((F.col("status") == "O").cast("double")).alias("open"),
        *[F.count_if(F.col("flag") == f).alias(f.lower()) for f in ("A", "N", "R")],
    ).withColumn("closed", 1 - F.col("open"))
    cells = T.split_counts(margins, "priority", ["open", "closed"], ["a", "n", "r"], "side", "flag")
    return cells.withColumn("weight", r6("weight"))


@probe("mean_logprob", """WITH t AS (SELECT user_id % 7 AS task_id, user_id AS prompt, avg(-ln(1 + value)) AS lp FROM events GROUP BY ALL)
SELECT task_id, round(avg(lp), 6) AS mean_logprob FROM t GROUP BY 1""")
def mean_logprob(spark, folder):
    tokens = table(spark, folder, "events").select(
        (F.col("user_id") % 7).alias("task_id"), F.col("user_id").alias("prompt"),
        (-F.ln(1 + F.col("value"))).alias("logprob"),
    )
    return A.mean_logprob(tokens, ["task_id"], "prompt", "logprob").withColumn("mean_logprob", r6("mean_logprob"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@probe("permutation_average", f"""WITH m AS (SELECT user_id, hour(ts) AS perm, event_type, sum(value) AS mass FROM events GROUP BY ALL),
o AS (SELECT user_id, perm, sum(mass) AS total FROM m GROUP BY ALL),
s AS (SELECT o.user_id, perm, event_type, total, coalesce(mass, 0) AS mass
  FROM (SELECT * FROM o CROSS JOIN (SELECT unnest({list(EVENT_TYPES)}) AS event_type)) o LEFT JOIN m USING (user_id, perm, event_type))
SELECT user_id, event_type, round(avg(CASE WHEN total = 0 THEN 0.2::DOUBLE ELSE mass / total END), 6) AS p FROM s GROUP BY ALL""")
def permutation_average(spark, folder):
    """Each hour shows the event types in another order; what the letters got is mapped back by that order."""
    levels = F.array(*[F.lit(e) for e in EVENT_TYPES])
    hour, k = F.hour("ts"), len(EVENT_TYPES)
    place = F.pmod(F.array_position(levels, F.col("event_type")) - 1 - F.col("perm"), F.lit(k))
    said = table(spark, folder, "events").groupBy("user_id", hour.alias("perm"), "event_type").agg(F.sum("value").alias("mass"))
    tokens = said.groupBy("user_id", "perm").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" "), F.char(F.lit(65) + place)).alias("key"), F.col("mass").alias("value")))).alias("masses"))
    turn = F.pmod(F.col("perm"), F.lit(k))
    order = F.concat(F.slice(levels, turn + 1, F.lit(k)), F.slice(levels, F.lit(1), turn))
    masses = A.letter_masses(tokens.withColumn("shown", order), ["user_id"], "perm", "shown", "masses")
    return A.permutation_average(masses, ["user_id"], "perm", "level", "mass").select("user_id", F.col("level").alias("event_type"), r6("p").alias("p"))


@probe("mc_vote_distribution", """WITH a AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'view' THEN 'D' ELSE 'Z' END AS letter FROM events)
SELECT user_id, CASE letter WHEN 'A' THEN 'clicks' WHEN 'B' THEN 'errors' WHEN 'C' THEN 'purchases' WHEN 'D' THEN 'views' END AS level,
  CAST(count(*) AS DOUBLE) AS w FROM a GROUP BY ALL""")
def mc_vote_distribution(spark, folder):
    letters = F.when(F.col("event_type") == "click", " A. since").when(F.col("event_type") == "error", "B").when(
        F.col("event_type") == "purchase", "C because").when(F.col("event_type") == "view", "\nD.").otherwise("Z")
    options = F.array(*[F.lit(x) for x in ("clicks", "errors", "purchases", "views")])
    answers = table(spark, folder, "events").select("user_id", letters.alias("text"), options.alias("options"))
    return A.mc_vote_distribution(answers, ["user_id"], "text", "options")


@probe("argmax_decode", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT u.user_id, t.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type) LEFT JOIN c USING (user_id, event_type))
SELECT user_id, event_type AS level FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def argmax_decode(spark, folder):
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = table(spark, folder, "events").groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds]
    )
    labels = F.array(*[F.lit(k) for k in kinds])
    return counts.select("user_id", A.argmax_decode(F.array(*kinds), labels).alias("level"))


@probe("min_loss_epoch", """WITH h AS (SELECT o_orderpriority AS run, year(o_orderdate) * 12 + month(o_orderdate) AS epoch,
  CASE WHEN o_orderstatus = 'F' THEN 'Evaluation' ELSE 'Training' END AS kind, round(avg(o_totalprice), 7) AS loss_value FROM orders GROUP BY ALL),
e AS (SELECT run, epoch FROM h WHERE kind = 'Evaluation' QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss_value, epoch) = 1)
SELECT run, CAST(epoch AS BIGINT) AS epoch, y_top, round(y_top * 0.6, 6) AS y FROM e JOIN (SELECT run, max(loss_value) AS y_top FROM h GROUP BY 1) USING (run)""")
def min_loss(spark, folder):
    orders = table(spark, folder, "orders")
    history = orders.groupBy(
        F.col("o_orderpriority").alias("run"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("epoch"),
        F.when(F.col("o_orderstatus") == "F", "Evaluation").otherwise("Training").alias("kind"),
    ).agg(F.round(F.avg("o_totalprice"), 7).alias("loss_value"))
    return min_loss_epoch(history, "run").withColumn("y", r6("y"))


@probe("zero_score_tasks", f"""WITH {S.SCORES},
sizes AS (SELECT task_id, count(*) AS size FROM hp GROUP BY 1)
SELECT model, task_id, dataset, prob, size FROM scores JOIN sizes USING (task_id)
WHERE model = 'phi4' AND score = 0 AND size <= 150""")
def zero_scores(spark, folder):
    sizes = T.task_size_high_dim(S.survey(spark, folder, *S.CELL_COLUMNS), S.HIGH)
    zero = zero_score_tasks(S.scores(spark, folder), sizes, "phi4")
    return zero.select("model", "task_id", "dataset", "prob", "size")


@probe("cut_labels", f"""WITH {S.SURVEY}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, qty_band, spend_band,
  CASE WHEN discount >= 0 AND discount < 0.02 THEN 'low' WHEN discount >= 0.02 AND discount < 0.07 THEN 'mid'
       WHEN discount >= 0.07 AND discount < 0.09 THEN 'high' END AS discount_band FROM survey""")
def cut_labels(spark, folder):
    df = S.survey(spark, folder, "qty_band", "spend_band", "discount")
    band = cut("discount", [0.0, 0.02, 0.07, 0.09], ["low", "mid", "high"], right=False)
    return df.select(*S.IDS, "qty_band", "spend_band", band.alias("discount_band"))
