"""Benchmark roll-ups (2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.operators.answers import mean_logprob
from popgauge.plans import reports as R
from popgauge.plans.scoring import eval_high_dim
from popgauge.probes import survey as S
from popgauge.probes.order import DOMAIN_CASE, DOMAIN_SQL, MODEL_CASE
from popgauge.probes.registry import probe, r6, table

SCORES = f"WITH {S.SCORES}\n"


def report(key: str, sql: str, *rounded: str):
    """Register a roll-up of the score table, its figures rounded to six places."""
    def register(build):
        @probe(key, SCORES + sql)
        def query(spark, folder):
            return build(S.scores(spark, folder)).withColumns({c: r6(c) for c in rounded})
        return query
    return register


@report("score_table", "SELECT model, task_id, task_name, dataset, dim, round(score, 6) AS score, prob FROM scores", "score")
def score_table(scores):
    return scores


@report("leaderboard", f"""SELECT model, CAST(round_even(score, 0) AS INTEGER) AS score, {MODEL_CASE} AS model_display,
  CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS rank FROM (SELECT model, avg(score) AS score FROM scores GROUP BY 1)""")
def leaderboard(scores):
    return R.leaderboard(scores)


@report("leaderboard_setting", """SELECT model, CASE WHEN dim > 1 THEN 'High-Dimensional' ELSE 'Low-Dimensional' END AS setting,
  CASE WHEN prob THEN 'Likelihood' ELSE 'QA' END AS prompting, round(avg(score), 6) AS score, CAST(round_even(avg(score), 0) AS INTEGER) AS lab FROM scores GROUP BY ALL""", "score")
def leaderboard_setting(scores):
    return R.leaderboard_setting(scores).withColumn("lab", F.coalesce("lab", F.lit(-1)))


@report("by_dataset", f"""SELECT model, {DOMAIN_CASE} AS dataset, prob, round(score, 6) AS score, dataset_rank, {MODEL_CASE} AS model_display, CASE WHEN prob THEN 'Likelihood' ELSE 'QA' END AS prompting
FROM (SELECT model, dataset, prob, avg(score) AS score FROM scores GROUP BY ALL) JOIN (SELECT dataset, CAST(row_number() OVER (ORDER BY avg(score) DESC, dataset) AS INTEGER) AS dataset_rank
  FROM (SELECT model, dataset, prob, avg(score) AS score FROM scores GROUP BY ALL) GROUP BY dataset) USING (dataset)""", "score")
def by_dataset(scores):
    return R.by_dataset(scores)


@probe("by_domain", DOMAIN_SQL + """SELECT domain, model, dataset, round(score, 6) AS score, shown || ' | ' || dataset AS x, x_pos FROM p""")
def by_domain(spark, folder):
    out = R.by_domain(S.scores(spark, folder))
    return out.select("domain", "model", "dataset", r6("score").alias("score"), "x", "x_pos")


@report("by_dimension", f"""SELECT model, dim, prob, round(avg(score), 6) AS score, {MODEL_CASE} AS model_display, 'd = ' || dim AS dimension FROM scores GROUP BY ALL""", "score")
def by_dimension(scores):
    return R.by_dimension(scores)


@report("by_size", """SELECT model, round(avg(score), 6) AS score, CASE model WHEN 'phi4' THEN 1.8::DOUBLE WHEN 'mistral_7b_instruct' THEN 7.0::DOUBLE WHEN 'llama3_8b_instruct' THEN 8.0::DOUBLE END AS size FROM scores GROUP BY 1""", "score")
def by_size(scores):
    return R.by_size(scores)


@probe("by_prompting", SCORES + f""", mb AS (SELECT task_id, avg(y) AS q FROM hd GROUP BY 1),
mr AS (SELECT task_id, sum(abs(q - p) * w) / sum(w) AS score, least(sum(p * w), sum((1 - p) * w), sum(abs(p - 0.5) * w)) / sum(w) AS worst FROM hp JOIN mb USING (task_id) GROUP BY 1),
ms AS (SELECT avg({S.bench_sql("score", "worst", "best")}) AS baseline FROM mr JOIN hfloors USING (task_id))
SELECT model, prob, round(avg(score), 6) AS score, CASE WHEN prob THEN 'Likelihood' ELSE 'QA' END AS prompting, round(any_value(baseline), 6) AS baseline
FROM scores, ms WHERE dim > 1 GROUP BY ALL""")
def by_prompting(spark, folder):
    sums = S.high_cells(spark, folder)
    truth = S.high_truth_of(sums)
    guess = S.high_mean_of(sums).join(truth.select("task_id", "cell"), "task_id").select(
        F.lit("model_mean").alias("model"), F.lit("QA").alias("prompting"), "task_id", "cell", "q"
    )
    baseline = eval_high_dim(truth, guess, S.high_floors_of(spark, folder, sums)).select(F.col("bench").alias("score"))
    out = R.by_prompting(S.scores(spark, folder, sums).where(F.col("dim") > 1), baseline)
    return out.withColumns({"score": r6("score"), "baseline": r6("baseline")})


@report("base_vs_tuned", """SELECT regexp_replace(model, '(_instruct|_chat)', '') AS family, regexp_matches(model, '(_instruct|_chat)') AS tuned, round(avg(score), 6) AS score FROM scores GROUP BY ALL""", "score")
def base_vs_tuned(scores):
    return R.base_vs_tuned(scores)


@report("fairness_split", """SELECT model, prob, task_id IN (2, 3, 101, 102, 103, 104) AS sensitive, round(avg(score), 6) AS score FROM scores GROUP BY ALL""", "score")
def fairness_split(scores):
    spark = scores.sparkSession
    variables = spark.createDataFrame([(t.task_id, list(t.variables)) for t in [*S.LOW, *S.HIGH]], "task_id int, variables array<string>")
    return R.fairness_split(scores, variables, ("segment", "region"))


@report("tuning_effect", """SELECT task_id, task_name, CASE WHEN dim > 1 THEN 'High-Dimensional' ELSE 'Low-Dimensional' END AS setting, CASE WHEN prob THEN 'Likelihood' ELSE 'Q&A' END AS prompting,
  round(max(score) FILTER (model = 'llama3_8b'), 6) AS before, round(max(score) FILTER (model = 'llama3_8b_instruct'), 6) AS after FROM scores WHERE dataset = 'brfss' GROUP BY ALL""", "before", "after")
def tuning_effect(scores):
    return R.tuning_effect(scores, "llama3_8b", "llama3_8b_instruct", "brfss")


@report("heatmap_long", """SELECT model, task_id, prob, round(score, 6) AS score, model_rank FROM scores JOIN (SELECT model, CAST(row_number() OVER (ORDER BY avg(score) DESC, model) AS INTEGER) AS model_rank FROM scores GROUP BY 1) USING (model)""", "score")
def heatmap_long(scores):
    return R.heatmap_long(scores)


@probe("memorisation_scatter", SCORES + """, t AS (SELECT model, CAST(user_id % 7 + 1 AS INTEGER) AS task_id, user_id, avg(-ln(1 + value)) AS lp FROM events JOIN (SELECT DISTINCT model FROM scores) ON TRUE GROUP BY ALL),
m AS (SELECT model, task_id, avg(lp) AS mean_logprob FROM t GROUP BY ALL),
pts AS (SELECT model, task_id, prob, dim, score, mean_logprob FROM m JOIN scores USING (model, task_id))
SELECT model, task_id, prob, round(mean_logprob, 6) AS mean_logprob, round(score, 6) AS score, CASE WHEN dim > 1 THEN 'High-Dimensional' ELSE 'Low-Dimensional' END AS kind,
  round(greatest(0, (SELECT min(score) FROM pts) - 5), 6) AS y_min, round(least(100, (SELECT max(score) FROM pts) + 5), 6) AS y_max,
  round((SELECT min(mean_logprob) FROM pts) - 0.1, 6) AS x_min, round((SELECT max(mean_logprob) FROM pts) + 0.1, 6) AS x_max FROM pts""")
def memorisation(spark, folder):
    scores = S.scores(spark, folder)
    tokens = table(spark, folder, "events").select(
        (F.col("user_id") % 7 + 1).cast("int").alias("task_id"), F.col("user_id").alias("prompt"),
        (-F.ln(1 + F.col("value"))).alias("logprob"),
    )
    means = mean_logprob(tokens, ["task_id"], "prompt", "logprob")
    names = spark.createDataFrame([(m,) for m in sorted(S.MODEL_OF_REGION.values())], "model string")
    each = means.withColumn("model", F.explode(F.array(*[F.lit(m) for m in sorted(S.MODEL_OF_REGION.values())])))
    out = R.memorisation_scatter(each.join(names, "model"), scores)
    shown = ["mean_logprob", "score", "y_min", "y_max", "x_min", "x_max"]
    return out.select("model", "task_id", "prob", "kind", *[r6(c).alias(c) for c in shown])


@report("explorer_ranking", f"""SELECT {MODEL_CASE} AS model_display, round(avg(score), 6) AS score, CAST(row_number() OVER (ORDER BY avg(score) DESC, {MODEL_CASE}) AS INTEGER) AS rank
FROM scores WHERE prob AND dataset IN ('gss', 'scf', 'meps') AND dim IN (1, 3, 4) GROUP BY {MODEL_CASE}""", "score")
def explorer_ranking(scores):
    return R.explorer_ranking(scores, True, ["gss", "scf", "meps"], [1, 3, 4])


@report("score_export", f"""SELECT model, task_id, CASE WHEN task_id > 100 THEN 'Task ' || task_id ELSE task_name END AS task_name, {DOMAIN_CASE} AS dataset, dim, round(score, 6) AS score,
  CASE WHEN prob THEN 'Likelihood' ELSE 'Q&A' END AS prob, {MODEL_CASE} AS model_display FROM scores""", "score")
def score_export(scores):
    titles = scores.where(F.col("dim") > 1).select("task_id", F.concat(F.lit("Task "), F.col("task_id")).alias("title")).distinct()
    return R.score_export(scores, titles)
