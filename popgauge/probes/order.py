"""Window, order, limit (2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.functions.text import WHITESPACE, probability_bins
from popgauge.operators import sampling as P
from popgauge.operators.answers import budget_levels
from popgauge.operators.joins import stratified_folds
from popgauge.operators.metrics import rank_within
from popgauge.operators.reshape import order_custom, sequence_pack
from popgauge.plans import reports as R
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table, u_sql, uniform_sql

IDS_SQL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
IDS_LIST = ", ".join(IDS_SQL)


@probe("rank_models", f"""WITH {S.SURVEY}, m AS (SELECT model, avg(spend) AS score FROM survey GROUP BY 1)
SELECT model, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS rank FROM m""")
def rank_models(spark, folder):
    means = S.survey(spark, folder, "model").groupBy("model").agg(F.avg("spend").alias("score"))
    return rank_within(means, F.col("score"), ["model"]).withColumn("score", r6("score"))


@probe("order_by_group_mean", f"""WITH {S.SURVEY}, m AS (SELECT brand, model, avg(spend) AS score FROM survey GROUP BY ALL),
g AS (SELECT brand, avg(score) AS score FROM m GROUP BY 1)
SELECT brand, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, brand) AS INTEGER) AS rank FROM g""")
def order_by_mean(spark, folder):
    df = S.survey(spark, folder, "model", "brand").withColumn("score", F.col("spend"))
    return R.order_by_group_mean(df, "brand", "model").withColumn("score", r6("score"))


DOMAIN_CASE = """CASE dataset WHEN 'brfss' THEN 'BRFSS' WHEN 'nsduh' THEN 'NSDUH' WHEN 'meps' THEN 'MEPS' WHEN 'gss' THEN 'GSS'
  WHEN 'labor' THEN 'BLS' WHEN 'acs' THEN 'ACS' WHEN 'scf' THEN 'SCF' END"""
MODEL_CASE = S.case_sql("model", {
    "llama3_8b_instruct": "LLama3 8B", "llama3_8b": "LLama3 8B", "mistral_7b_instruct": "Mistral 7B",
    "mistral_7b": "Mistral 7B", "phi4": "Phi4",
})
DOMAIN_SQL = f"""WITH {S.SCORES},
m AS (SELECT model, {DOMAIN_CASE} AS dataset, {MODEL_CASE} AS shown, avg(score) AS score FROM scores GROUP BY ALL),
d AS (SELECT *, CASE WHEN dataset IN ('BRFSS', 'NSDUH', 'MEPS') THEN 'Health' WHEN dataset = 'GSS' THEN 'Social' ELSE 'Economic' END AS domain FROM m),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE domain WHEN 'Health' THEN 0 WHEN 'Social' THEN 1 ELSE 2 END, shown, dataset, model) - 1 AS INTEGER) AS x_pos FROM d)
"""


@probe("order_domain_model_dataset", DOMAIN_SQL + """SELECT model, dataset, domain, x_pos,
  min(x_pos) OVER (PARTITION BY domain) AS domain_start, max(x_pos) OVER (PARTITION BY domain) + 1 AS domain_end FROM p""")
def order_domain(spark, folder):
    return R.by_domain(S.scores(spark, folder)).select(
        "model", "dataset", "domain", "x_pos", "domain_start", "domain_end"
    )


@probe("order_custom", """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS INTEGER) AS place FROM orders""")
def custom_order(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", order_custom("o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"]).alias("place")
    )


@probe("kfold_assign", f"""WITH h AS (SELECT {IDS_LIST}, l_returnflag, {u_sql(*IDS_SQL, stream=42)} AS h FROM lineitem)
SELECT {IDS_LIST}, l_returnflag, CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY h % 1024, h, {IDS_LIST}) - 1) % 5 AS INTEGER) AS fold FROM h""")
def kfold(spark, folder):
    return stratified_folds(table(spark, folder, "lineitem").select(*S.IDS, "l_returnflag"), "l_returnflag", S.IDS)


@probe("weighted_sample", f"""SELECT {IDS_LIST}, l_quantity FROM lineitem WHERE l_quantity > 0
ORDER BY -ln({uniform_sql(*IDS_SQL)}) / l_quantity, {IDS_LIST} LIMIT 1000""")
def weighted_sample(spark, folder):
    lines = table(spark, folder, "lineitem").select(*S.IDS, "l_quantity")
    return P.weighted_sample(lines, 1000, "l_quantity", S.IDS)


@probe("weighted_sample_replace", f"""WITH r AS (SELECT {IDS_LIST}, l_quantity, l_quantity * ({2500 + 8 * 2500 ** 0.5 + 20!r}::DOUBLE / (SELECT sum(l_quantity) FROM lineitem WHERE l_quantity > 0)) AS mu,
  {uniform_sql(*IDS_SQL, "0", stream=1)} AS u FROM lineitem WHERE l_quantity > 0),
k AS (SELECT *, unnest(generate_series(0, 60)) AS k FROM r WHERE u > exp(-mu)),
f AS (SELECT {IDS_LIST}, l_quantity, u, k, sum(exp(k * ln(mu) - mu - lgamma(k + 1))) OVER (PARTITION BY {IDS_LIST} ORDER BY k) AS f FROM k),
c AS (SELECT {IDS_LIST}, l_quantity, count(*) FILTER (u > f) AS n FROM f GROUP BY ALL),
e AS (SELECT {IDS_LIST}, l_quantity, unnest(generate_series(1, n)) AS copy FROM c),
a AS (SELECT *, {uniform_sql(*IDS_SQL, "0", "copy", stream=2)} AS spot FROM e)
SELECT * FROM (SELECT row_number() OVER (ORDER BY spot, {IDS_LIST}, copy) - 1 AS draw, {IDS_LIST}, l_quantity FROM a) WHERE draw < 2500""")
def weighted_sample_replace(spark, folder):
    lines = table(spark, folder, "lineitem").select(*S.IDS, "l_quantity")
    return P.weighted_sample_replace(lines, 2500, "l_quantity", S.IDS)


@probe("train_val_split", f"""SELECT doc_id, CASE WHEN {uniform_sql("doc_id", stream=42)} < 0.8 THEN 'train' ELSE 'validation' END AS split FROM documents""")
def train_val(spark, folder):
    return P.train_val_split(table(spark, folder, "documents").select("doc_id"), "doc_id")


WORDS_SQL = "string_split_regex(trim(text, E' \\t\\n\\r\\f\\x0b'), '[ \\t\\n\\r\\f\\x0b]+')"


@probe("sequence_pack", f"""WITH w AS (SELECT doc_id // 100 AS batch, doc_id, unnest({WORDS_SQL}) AS tok, generate_subscripts({WORDS_SQL}, 1) AS i FROM documents WHERE trim(text, E' \\t\\n\\r\\f\\x0b') <> ''),
p AS (SELECT batch, tok, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS pos FROM w),
b AS (SELECT batch, pos // 512 AS block, count(*) AS n_tokens, md5(string_agg(tok, ' ' ORDER BY pos)) AS digest FROM p GROUP BY ALL)
SELECT batch, block, CAST(n_tokens AS INTEGER) AS n_tokens, digest FROM b WHERE n_tokens = 512""")
def pack(spark, folder):
    text = F.btrim("text", F.lit(WHITESPACE))
    docs = table(spark, folder, "documents").where(text != "").select(
        F.floor(F.col("doc_id") / 100).alias("batch"), "doc_id", F.split(text, r"[ \t\n\r\f\x0b]+").alias("tokens")
    )
    blocks = sequence_pack(docs, "batch", "doc_id", "tokens", 512)
    return blocks.select("batch", "block", F.size("tokens").alias("n_tokens"),
                         F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


BINS = len(probability_bins())


@probe("budget_levels", f"""WITH RECURSIVE h AS (SELECT user_id, event_type, least({BINS - 1}, CAST(floor(value / 5) AS INTEGER)) AS bin, count(*) AS n FROM events GROUP BY ALL),
kinds AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS ord, count(*) OVER (PARTITION BY user_id) AS k
  FROM (SELECT DISTINCT user_id, event_type FROM events)),
r AS (SELECT user_id, 0 AS ord, {BINS} AS remaining, 0 AS offered, 0 AS picked FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT r.user_id, r.ord + 1, r.remaining - coalesce(x.bin, 0), r.remaining, coalesce(x.bin, 0)
  FROM r JOIN kinds q ON q.user_id = r.user_id AND q.ord = r.ord + 1 AND q.ord < q.k
  LEFT JOIN LATERAL (SELECT h.bin FROM h WHERE h.user_id = q.user_id AND h.event_type = q.event_type AND h.bin < r.remaining ORDER BY h.n DESC, h.bin LIMIT 1) x ON TRUE)
SELECT user_id, CAST(ord AS INTEGER) AS question, CAST(offered AS INTEGER) AS offered, CAST(picked AS INTEGER) AS picked FROM r WHERE ord > 0""")
def budget(spark, folder):
    bin_of = F.least(F.lit(BINS - 1), F.floor(F.col("value") / 5).cast("int"))
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(
        *[F.count_if(bin_of == b).cast("double").alias(f"b{b}") for b in range(BINS)]
    )
    probs = F.array(*[f"b{b}" for b in range(BINS)])
    # One entry per question (level) of a prompt.
    asked = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", probs.alias("probs")))).alias("qs"))
    folded = asked.select("user_id", budget_levels(F.col("qs.probs")).alias("b"))
    return folded.select("user_id", F.posexplode(F.arrays_zip("b.offered", "b.picked"))).select(
        "user_id", (F.col("pos") + 1).alias("question"), F.col("col.offered").alias("offered"),
        F.coalesce("col.picked", F.lit(0)).alias("picked"),
    )
