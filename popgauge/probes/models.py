"""Statistical jobs and extension points (2.8, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.functions import recode as R
from popgauge.functions.labels import cut
from popgauge.operators import boosting as B
from popgauge.operators import cells as C
from popgauge.operators import metrics as M
from popgauge.operators.answers import reference_as_model, score_batch as run_scorer
from popgauge.operators.environments import envs_dataset
from popgauge.operators.impute import impute_chained
from popgauge.operators.matching import impute_matched
from popgauge.operators.tabulate import task_cells
from popgauge.plans.scoring import eval_low_dim
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table, u_sql, uniform_sql

IDS_SQL = tuple(S.IDS)


def cell_text(column: str = "cell"):
    return F.array_join(column, "|")


@probe("cell_probability", f"""WITH {S.SURVEY}, {S.CELLS} SELECT task_id, cell, round(w, 6) AS w, n, round(p, 6) AS p FROM hp""")
def cell_probability(spark, folder):
    cells = C.cell_probability(S.survey(spark, folder, *S.CELL_COLUMNS), S.HIGH)
    return cells.select("task_id", cell_text().alias("cell"), r6("w").alias("w"), "n", r6("p").alias("p"))


FOLDED = " UNION ALL ".join(
    f"SELECT {t.task_id} AS task_id, [{', '.join(t.conditions)}] AS cell, CASE WHEN {t.outcome} = 'yes' THEN 1.0::DOUBLE ELSE 0 END AS y, weight AS w, fold FROM f"
    for t in S.HIGH
)


@probe("oof_cell_probability", f"""WITH {S.SURVEY}, f AS (SELECT *, CAST({u_sql(*IDS_SQL, stream=42)} % 5 AS INTEGER) AS fold FROM survey),
hf AS ({FOLDED}),
fine AS (SELECT task_id, cell, fold, sum(w) AS w, sum(w * y) AS wy, count(*) AS n FROM hf GROUP BY ALL),
laid AS (SELECT fine.*, d, cell[1:d] AS prefix FROM fine, LATERAL (SELECT unnest(generate_series(0, len(cell))) AS d)),
own AS (SELECT task_id, d, prefix, fold, sum(w) AS w, sum(wy) AS wy, sum(n) AS n FROM laid GROUP BY ALL),
oth AS (SELECT task_id, d, prefix, fold, sum(w) OVER g - w AS ow, sum(wy) OVER g - wy AS owy, sum(n) OVER g - n AS others FROM own WINDOW g AS (PARTITION BY task_id, d, prefix))
SELECT l.task_id, array_to_string(l.cell, '|') AS cell, l.fold, l.n, CAST(l.d AS INTEGER) AS depth, round(owy / ow, 9) AS p
FROM laid l JOIN oth ON oth.task_id = l.task_id AND oth.d = l.d AND oth.prefix = l.prefix AND oth.fold = l.fold WHERE others >= 100 AND ow > 0
QUALIFY row_number() OVER (PARTITION BY l.task_id, l.cell, l.fold ORDER BY l.d DESC) = 1""")
def oof_cells(spark, folder):
    df = S.survey(spark, folder, *S.CELL_COLUMNS)
    out = C.oof_cell_probability(df, S.HIGH, S.IDS, min_rows=100)
    return out.select("task_id", cell_text().alias("cell"), "fold", "n", "depth", F.round("p", 9).alias("p"))


GBT_SQL = f"""WITH {S.SURVEY}, {S.CELLS},
fd AS (SELECT *, CAST({u_sql(*IDS_SQL, stream=42)} % 5 AS INTEGER) AS fold FROM hd)
SELECT task_id, count(DISTINCT (cell, fold)) AS n_cells, round(sum(w), 3) AS w, round(sum(w * y) / sum(w), 6) AS share, TRUE AS near FROM fd GROUP BY 1"""


def _against_share(spark, folder, by: list[str], replicates: int):
    """Out-of-fold predictions of all tasks, fitted together, against what any calibrated estimate must give: they average
    to the task's share of positives. Tolerance: 0.02 plus four standard errors of that share."""
    df = S.survey(spark, folder, *S.CELL_COLUMNS)
    means = B.boosted(df, S.HIGH, S.IDS, replicates=replicates).groupBy("task_id", *by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("w").alias("total"), (F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("mean"))
    truth = C.cell_sums(df, S.HIGH).groupBy("task_id").agg((F.sum("wy") / F.sum("w")).alias("share"), F.sum("n").alias("n"))
    allowed = 0.02 + 4 * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n"))
    return means.join(truth, "task_id").select(
        "task_id", *by, "n_cells", F.round("total", 3).alias("w"), r6("share").alias("share"), (F.abs(F.col("mean") - F.col("share")) < allowed).alias("near"))


@probe("oof_gbt", GBT_SQL)
def oof_gbt(spark, folder):
    return _against_share(spark, folder, [], 0)


@probe("bootstrap_gbt", f"SELECT g.*, CAST(b AS INTEGER) AS b FROM ({GBT_SQL}) g, generate_series(0, 9) s(b)")
def bootstrap_gbt(spark, folder):
    return _against_share(spark, folder, ["b"], 10)


@probe("hd_noise_floor", f"WITH {S.SURVEY}, {S.HIGH_FLOORS} SELECT task_id, round(best, 6) AS best_err FROM hfloors")
def hd_noise_floor(spark, folder):
    boot = C.bootstrap_cells(S.survey(spark, folder, *S.CELL_COLUMNS), S.HIGH, S.IDS)
    return C.high_dim_floor(boot).withColumn("best_err", r6("best_err"))


def impute_sql(targets: dict[str, list[str]], fixed: list[str], rounds: int) -> str:
    """Chained draws as a chain of CTEs: one per round and column."""
    columns = ["doc_id", *fixed, *targets, *[f"gap_{t}" for t in targets]]
    names = list(targets)
    ctes = ["""w0 AS (SELECT d.doc_id, lang, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS quality, CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS toxic,
      quality IS NULL AS gap_quality, toxic IS NULL AS gap_toxic FROM documents d LEFT JOIN labels USING (doc_id))"""]
    step = 0
    for r in range(rounds + 1):
        for i, t in enumerate(names):
            by = targets[t] if r else []
            src, out = f"w{step}", f"w{step + 1}"
            keys = ", ".join(by) + ", " if by else ""
            part = f"PARTITION BY {', '.join(by)} " if by else ""
            ctes.append(f"n{step} AS (SELECT {keys}{t} AS level, count(*)::DOUBLE AS w FROM {src} WHERE NOT gap_{t} GROUP BY ALL)")
            ctes.append(f"c{step} AS (SELECT *, sum(w) OVER ({part}ORDER BY level) AS hi, sum(w) OVER ({part}ORDER BY level) - w AS lo, sum(w) OVER ({part}) AS tot FROM n{step})")
            ctes.append(f"m{step} AS (SELECT level, sum(w) AS w FROM n{step} GROUP BY 1)")
            ctes.append(f"o{step} AS (SELECT *, sum(w) OVER (ORDER BY level) AS hi, sum(w) OVER (ORDER BY level) - w AS lo, sum(w) OVER () AS tot FROM m{step})")
            ctes.append(f"u{step} AS (SELECT *, {uniform_sql('doc_id', stream=r * len(names) + i)} AS u FROM {src})")
            match = " AND ".join([f"c.{k} = s.{k}" for k in by] + ["u * c.tot >= c.lo", "u * c.tot < c.hi"])
            kept = ", ".join(f"s.{c}" for c in columns if c != t)
            ctes.append(
                f"{out} AS (SELECT {kept}, CASE WHEN gap_{t} THEN coalesce(c.level, o.level) ELSE {t} END AS {t} FROM u{step} s "
                f"LEFT JOIN c{step} c ON {match} LEFT JOIN o{step} o ON u * o.tot >= o.lo AND u * o.tot < o.hi)"
            )
            step += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, lang, quality, toxic FROM w{step}"


PREDICTORS = {"quality": ["lang", "toxic"], "toxic": ["lang", "quality"]}


@probe("impute_chained", impute_sql(PREDICTORS, ["lang"], 5))
def impute(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    df = docs.join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", "lang", R.recode_map("quality", {1: "good", 0: "bad"}).alias("quality"),
        R.recode_map("toxic", {1: "yes", 0: "no"}).alias("toxic"),
    )
    return impute_chained(df, PREDICTORS, ["doc_id"], rounds=5)


@probe("impute_matched", """WITH t AS (SELECT doc_id, lang, quality, toxic, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, lang, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'filled' END AS quality, CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' ELSE 'filled' END AS toxic,
  coalesce(n_chars, -1) AS n_chars, TRUE AS observed_value FROM t""")
def impute_with_matches(spark, folder):
    """Categorical and numeric gaps filled from all other columns: what was known stays, every fill is a value of its column."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("n_chars"))
    df = docs.join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", "lang", R.recode_map("quality", {1: "good", 0: "bad"}).alias("quality"),
        R.recode_map("toxic", {1: "yes", 0: "no"}).alias("toxic"), "n_chars")
    filled = impute_matched(df, ["lang", "quality", "toxic", "n_chars"], ["doc_id"], rounds=2)
    known = df.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("quality", "toxic", "n_chars")])
    seen = df.where("n_chars IS NOT NULL").select(F.col("n_chars").alias("_value")).distinct()
    told = filled.join(known, "doc_id").join(seen, F.col("n_chars") == F.col("_value"), "left")
    kept = lambda c, other: F.when(F.col(f"_{c}").isNull(), F.lit(other)).otherwise(F.col(c)).alias(c)
    right = F.col("_value").isNotNull() & F.col("quality").isin("good", "bad") & F.col("toxic").isin("yes", "no")
    return told.select("doc_id", "lang", kept("quality", "filled"), kept("toxic", "filled"), kept("n_chars", -1), right.alias("observed_value"))


@probe("kde_weighted", f"""WITH {S.SURVEY},
st AS (SELECT ptype, stddev_samp(spend) AS sd, (quantile_cont(spend, 0.75) - quantile_cont(spend, 0.25)) / 1.349 AS iqr, count(*) AS n, min(spend) AS lo, max(spend) AS hi, sum(weight) AS tot FROM survey GROUP BY 1),
b AS (SELECT *, 1.059 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * n ** (-0.2) AS bw FROM st),
g AS (SELECT ptype, bw, tot, i AS point, lo - 3 * bw + i * (hi - lo + 6 * bw) / 63 AS x FROM b, generate_series(0, 63) s(i)),
f AS (SELECT ptype, spend, sum(weight) AS w FROM survey GROUP BY ALL)
SELECT ptype, CAST(point AS INTEGER) AS point, round(x, 4) AS x, round(sum(w / tot * exp(-0.5 * ((x - spend) / bw) ** 2) / (bw * sqrt(2 * pi()))) * 1000, 6) AS density
FROM g JOIN f USING (ptype) GROUP BY ptype, point, x""")
def kde(spark, folder):
    density = M.kde_weighted(S.survey(spark, folder, "ptype"), ["ptype"], "spend", "weight")
    return density.select("ptype", "point", F.round("x", 4).alias("x"), r6(F.col("density") * 1000).alias("density"))


@probe("calibration_pairs", f"""WITH {S.SURVEY} SELECT brand, round(sum(discount * weight) / sum(weight), 6) AS p_true, round(sum(tax * weight) / sum(weight), 6) AS p_mod FROM survey GROUP BY 1""")
def calibration(spark, folder):
    pairs = M.calibration_pairs(S.survey(spark, folder, "brand", "discount", "tax"), ["brand"], "discount", "tax", "weight")
    return pairs.select("brand", r6("p_true").alias("p_true"), r6("p_mod").alias("p_mod"))


@probe("smooth_jitter", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_discount + ({uniform_sql(*IDS_SQL, stream=5)} * 2 - 1) * 0.001, 9) AS x FROM lineitem""")
def smooth_jitter(spark, folder):
    noisy = M.jitter(F.col("l_discount"), *S.IDS, seed=5)
    return table(spark, folder, "lineitem").select(*S.IDS, F.round(noisy, 9).alias("x"))


ENV_LEVELS = {"rebate": ["yes", "no"], "flag": ["A", "N", "R"],
              "priority": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]}
ENV_ENCODED = """CASE WHEN rebate = 'yes' THEN 1 ELSE 0 END AS rebate, CAST(CASE priority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END AS INTEGER) AS priority,
  CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS flag_A, CASE WHEN flag = 'N' THEN 1 ELSE 0 END AS flag_N, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS flag_R"""


@probe("envs_dataset", f"""WITH {S.SURVEY},
r AS (SELECT rebate, priority, flag FROM survey WHERE status = 'O' AND weight > 0 ORDER BY -ln({uniform_sql(*IDS_SQL)}) / weight, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 2000)
SELECT 1 AS env, {ENV_ENCODED} FROM survey WHERE status = 'F' UNION ALL SELECT 0, {ENV_ENCODED} FROM r""")
def envs(spark, folder):
    df = S.survey(spark, folder, "rebate", "priority", "flag", "status")
    return envs_dataset(
        df.where("status = 'F'"), df.where("status = 'O'"), ["rebate", "priority", "flag"], 2000, "weight", S.IDS,
        ENV_LEVELS, ordered=["priority"],
    )


@probe("score_batch", """SELECT doc_id, ((length(text) * 31 + doc_id) % 97) / 97.0::DOUBLE AS score FROM documents""")
def score_batch(spark, folder):
    prompts = table(spark, folder, "documents").select("doc_id", "text")

    def stub(batch):
        return ((batch["text"].str.len() * 31 + batch["doc_id"]) % 97) / 97.0

    return run_scorer(prompts, stub, "score").select("doc_id", "score")


@probe("reference_as_model", f"""WITH {S.SURVEY},
t AS (SELECT priority AS cond, spend_band AS level, sum(weight) AS w FROM survey GROUP BY ALL),
o AS (SELECT o_orderpriority AS cond, {S.band_sql("o_totalprice / 5", S.SPEND_EDGES, S.SPEND_LABELS)} AS level, count(*)::DOUBLE AS w FROM orders GROUP BY ALL),
p AS (SELECT cond, level, w / sum(w) OVER (PARTITION BY cond) AS p, sum(w) OVER (PARTITION BY cond) AS tw FROM t),
q AS (SELECT cond, level, w / sum(w) OVER (PARTITION BY cond) AS q FROM o),
e AS (SELECT cond, sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS l1, sum(abs(0.2 - coalesce(p, 0))) AS uni, max(tw) AS tw FROM p FULL JOIN q USING (cond, level) GROUP BY 1),
r AS (SELECT sum(l1 * tw) / sum(tw) AS score, sum(uni * tw) / sum(tw) AS worst FROM e)
SELECT round(score, 6) AS score, round(worst, 6) AS worst, round({S.bench_sql("score", "worst", "0::DOUBLE")}, 6) AS bench FROM r""")
def as_model(spark, folder):
    task = S.LOW[0]
    truth = task_cells(S.survey(spark, folder, "spend_band", "priority"), [task])
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.lit(1.0).alias("weight"),
        cut(F.col("o_totalprice") / 5, S.SPEND_EDGES, S.SPEND_LABELS).alias("spend_band"),
    )
    runs = eval_low_dim(truth, reference_as_model(task_cells(orders, [task]), "orders"))
    return runs.select(*[r6(c).alias(c) for c in ("score", "worst", "bench")])


@probe("recode_registry", """SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2) THEN 'Hispanic' WHEN c_nationkey = 3 THEN 'White' WHEN c_nationkey = 4 THEN 'Black' WHEN c_nationkey = 6 THEN 'Asian' WHEN c_nationkey = 7 THEN 'Other' END AS race,
  CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS purse FROM customer""")
def registry(spark, folder):
    R.register_recoder("purse", lambda x: F.when(x < 0, "owes").otherwise("has"))
    return table(spark, folder, "customer").select(
        "c_custkey", R.apply_recoder("nhanes_race", "c_nationkey").alias("race"), R.apply_recoder("purse", "c_acctbal").alias("purse")
    )
