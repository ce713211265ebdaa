"""Text and response parsing (2.7), over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgauge.functions import text as X
from popgauge.operators import tabulate as T
from popgauge.operators.answers import decode_prob_matrix, prompt_permutations
from popgauge.plans.names import DATASET_NAMES, VARIABLE_NAMES
from popgauge.functions.recode import name_or_self
from popgauge.probes import survey as S
from popgauge.probes.registry import probe, r6, table
from popgauge.spec import task_frame

SPACE = "E' \\t\\n\\r\\f\\x0b'"


def word_sql(column: str, *words: str) -> str:
    """Whole-word, case-free search that knows accented letters."""
    return f"regexp_matches({column}, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')"


@probe("parse_level", f"""WITH m AS (SELECT doc_id, {word_sql("text", "the", "that")} AS a, {word_sql("text", "le", "la")} AS b, {word_sql("text", "der", "und")} AS c FROM documents)
SELECT doc_id, CASE WHEN a::INT + b::INT + c::INT > 1 THEN 0.5::DOUBLE WHEN a THEN 0::DOUBLE WHEN b THEN 1::DOUBLE WHEN c THEN 2::DOUBLE END AS level FROM m""")
def parse_level(spark, folder):
    levels = [["the", "that"], ["le", "la"], ["der", "und"]]
    return table(spark, folder, "documents").select("doc_id", X.parse_level("text", levels).alias("level"))


@probe("parse_number", """SELECT doc_id, TRY_CAST(regexp_extract(text, '-?\\d+(?:\\.\\d+)?') AS DOUBLE) AS number FROM documents""")
def parse_number(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.parse_number("text").alias("number"))


@probe("parse_letter", f"""SELECT conv_id, turn, CASE trim(text, {SPACE})[1] WHEN 'A' THEN 'first' WHEN 'B' THEN 'second' WHEN 'C' THEN 'third' WHEN 'D' THEN 'fourth' WHEN 'E' THEN 'fifth' END AS level FROM conversations""")
def parse_letter(spark, folder):
    options = F.array(*[F.lit(x) for x in ("first", "second", "third", "fourth", "fifth")])
    return table(spark, folder, "conversations").select("conv_id", "turn", X.parse_letter("text", options).alias("level"))


BIN_SQL = """CASE WHEN b = 0 THEN '0%' WHEN b = 21 THEN '100%' ELSE ((b - 1) * 5) || '% - ' || (b * 5) || '%' END"""


@probe("parse_prob_bin", f"""WITH e AS (SELECT event_id, CAST(least(21, floor(value / 5)) AS INTEGER) AS b FROM events)
SELECT event_id, {BIN_SQL} AS answer, round(CASE WHEN b = 0 THEN 0 WHEN b = 21 THEN 1 ELSE (b - 0.5) * 0.05 END::DOUBLE, 6) AS p FROM e""")
def parse_prob_bin(spark, folder):
    bins = F.array(*[F.lit(b) for b in X.probability_bins()])
    which = F.least(F.lit(22), F.floor(F.col("value") / 5) + 1).cast("int")
    answers = table(spark, folder, "events").select("event_id", F.element_at(bins, which).alias("answer"))
    return answers.withColumn("p", r6(X.parse_prob_bin("answer")))


@probe("prob_bins", f"""WITH bins AS (SELECT b, {BIN_SQL} AS bin FROM generate_series(0, 21) s(b)),
e AS (SELECT CAST(least(21, floor(value / 5)) AS BIGINT) AS b, count(*) AS n FROM events GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n FROM bins LEFT JOIN e USING (b)""")
def prob_bins(spark, folder):
    labels = X.probability_bins()
    bins = spark.createDataFrame([(i, b) for i, b in enumerate(labels)], "b bigint, bin string")
    used = table(spark, folder, "events").groupBy(F.least(F.lit(21), F.floor(F.col("value") / 5)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(used, "b", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@probe("decode_prob_matrix", f"""WITH h AS (SELECT user_id, event_type, CAST(least(21, floor(value / 25)) AS INTEGER) AS b, count(*) AS n FROM events GROUP BY ALL),
pick AS (SELECT user_id, event_type, b FROM h QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, b) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS ord, count(*) OVER (PARTITION BY user_id) AS k FROM pick),
d AS (SELECT *, CASE WHEN ord < k THEN CASE WHEN b = 0 THEN 0 WHEN b = 21 THEN 1 ELSE (b - 0.5) * 0.05 END::DOUBLE END AS w FROM o),
s AS (SELECT *, 1 - coalesce(sum(w) OVER (PARTITION BY user_id), 0) AS rest FROM d)
SELECT user_id, event_type, round(coalesce(w, rest), 6) AS weight, round(rest, 9) >= 0 AS is_valid FROM s""")
def decode_matrix(spark, folder):
    which = F.least(F.lit(21), F.floor(F.col("value") / 25))
    asked = table(spark, folder, "events").groupBy("user_id", "event_type").agg(
        F.array(*[F.count_if(which == b).cast("double") for b in range(22)]).alias("probs")
    )
    bins = F.array(*[F.lit(b) for b in X.probability_bins()])
    out = decode_prob_matrix(asked, ["user_id"], "event_type", "probs", bins)
    return out.select("user_id", "event_type", r6("weight").alias("weight"), "is_valid")


@probe("extract_tag", f"""WITH t AS (SELECT d.doc_id, CASE WHEN quality = 1 THEN 'x <Story>' || text || '</STORY> end' WHEN toxic = 0 THEN '## Title of ' || text ELSE chr(10) || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)) END AS raw, text, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(raw, {SPACE}), '\\n\\s*\\n'), lambda x: trim(x, {SPACE})), lambda x: x <> '') AS paras FROM t WHERE quality IS DISTINCT FROM 1 AND toxic IS DISTINCT FROM 0)
SELECT t.doc_id, md5(CASE WHEN quality = 1 THEN trim(text, {SPACE}) WHEN toxic = 0 THEN '' ELSE coalesce(paras[1], '') END) AS story FROM t LEFT JOIN p USING (doc_id)""")
def extract_tag(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text").join(table(spark, folder, "labels"), "doc_id", "left")
    loose = F.concat(F.lit("\n\n"), F.replace("text", F.lit(".\n"), F.lit(".\n \n")))
    raw = F.when(F.col("quality") == 1, F.concat(F.lit("x <Story>"), "text", F.lit("</STORY> end"))).when(
        F.col("toxic") == 0, F.concat(F.lit("## Title of "), "text")).otherwise(loose)
    return df.select("doc_id", F.md5(X.extract_tag(raw).cast("binary")).alias("story"))


@probe("strip_markup_cap_words", f"""WITH s AS (SELECT page_id, regexp_replace(html, '<[^>]+>|\\{{[^}}]+\\}}', '', 'g') AS t FROM pages),
w AS (SELECT page_id, t, string_split_regex(trim(t, {SPACE}), '[ \\t\\n\\r\\f\\x0b]+') AS words FROM s)
SELECT page_id, md5(CASE WHEN len(words) > 200 THEN array_to_string(words[1:200], ' ') ELSE t END) AS story FROM w""")
def strip_markup(spark, folder):
    story = X.cap_words(X.strip_markup("html"), 200)
    return table(spark, folder, "pages").select("page_id", F.md5(story.cast("binary")).alias("story"))


@probe("negation_word", """SELECT d.doc_id, CASE WHEN toxic = 0 OR lang = 'de' THEN 'not' ELSE '' END AS word FROM documents d LEFT JOIN labels USING (doc_id)""")
def negation_word(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    answer = F.when(F.col("lang") == "de", " No ").otherwise(F.col("toxic").cast("string"))
    return df.select("doc_id", F.coalesce(X.negation_word(answer), F.lit("")).alias("word"))


@probe("normalise_names", """WITH n AS (SELECT c_custkey, trim(regexp_replace(lower(trim(c_name)), '[\\d\\-]+', '', 'g')) || ' ' || lower(c_mktsegment) AS name FROM customer)
SELECT c_custkey, CASE name WHEN 'customer# building' THEN 'builder' ELSE name END AS name FROM n WHERE name <> 'customer# household'""")
def normalise_names(spark, folder):
    raw = F.concat(F.lit("  "), "c_name", F.lit("- "), "c_mktsegment", F.lit(" "))
    name = X.normalise_name(raw, drop=r"[\d\-]+", renames={"customer# building": "builder", "customer# household": None})
    return table(spark, folder, "customer").select("c_custkey", name.alias("name")).dropna(subset=["name"])


@probe("slugify", f"""WITH a AS (SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(lower(trim(regexp_replace(t, '[^\\w\\s-]', '', 'g'), {SPACE})), '[-\\s]+', '_', 'g')) AS slug FROM a""")
def slugify(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(X.slugify("text").cast("binary")).alias("slug"))


@probe("file_to_dataset", """SELECT page_id, string_split(string_split(url, '/')[-1], '.')[1] AS dataset FROM pages""")
def file_to_dataset(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.file_to_dataset("url").alias("dataset"))


PROB_PROMPTS = " ".join(
    f"WHEN {t.task_id} THEN '{t.prompt_prob}'" for t in S.LOW if t.prompt_prob
)


@probe("prompt_render_ld", f"""WITH {S.TRUTH},
o AS (SELECT task_id, string_agg(level, ', ' ORDER BY level) AS options FROM lvls GROUP BY 1),
t AS (SELECT r.task_id, cond, level, string_split(CASE r.task_id {PROB_PROMPTS} END, '{{}}') AS parts, options FROM reality r JOIN o USING (task_id) WHERE r.task_id < 7)
SELECT task_id, cond, level, parts[1] || cond || parts[2] || level || parts[3] || ' (possible levels of ' || {S.case_sql("CAST(task_id AS VARCHAR)", {t.task_id: t.outcome for t in S.LOW})} || ' are: ' || options || ')' AS prompt FROM t""")
def render_low(spark, folder):
    truth = S.truth_cells(spark, folder)
    levels = T.task_levels(truth).groupBy("task_id").agg(F.array_sort(F.collect_list("level")).alias("levels"))
    specs = task_frame(spark, S.LOW).where("dim = 1 and size(v_cond) > 0").select("task_id", "v_out", "prompt_prob")
    asked = T.scoped(truth).join(F.broadcast(specs), "task_id").join(levels, "task_id")
    prompt = F.concat(X.fill("prompt_prob", F.col("cond"), F.col("level")), F.lit(" "), X.possible_levels("v_out", F.col("levels")))
    return asked.select("task_id", "cond", "level", prompt.alias("prompt"))


@probe("prompt_render_hd", f"""WITH {S.SURVEY}
SELECT DISTINCT priority, region, ptype, 'For a person ' || 'whose order is ' || priority || ', who lives in ' || region || ', who buys ' || ptype || ' parts, do they get a rebate?' AS prompt FROM survey""")
def render_high(spark, folder):
    cells = S.survey(spark, folder, "priority", "region", "ptype").select("priority", "region", "ptype").distinct()
    phrases = F.array(*[
        X.fill(F.lit(template), F.col(c)) for c, template in
        (("priority", "whose order is {}"), ("region", "who lives in {}"), ("ptype", "who buys {} parts"))
    ])
    return cells.withColumn("prompt", X.prompt_high_dim(phrases, F.lit("do they get a rebate?")))


RULES = X.FACT_RULES.replace("'", "''")


@probe("prompt_fact_sheet", f"""SELECT c_custkey, md5('{RULES.format(facts="segment, nation, balance")}FACTS:' || chr(10) || '- segment: ' || c_mktsegment || chr(10) || '- nation: ' || c_nationkey || chr(10) ||
 '- balance: ' || CASE WHEN c_acctbal < 0 THEN 'None' ELSE 'good' END || chr(10) || '{X.FACT_FORMAT}') AS prompt FROM customer""")
def fact_sheet(spark, folder):
    facts = {"s": "c_mktsegment", "n": "c_nationkey", "b": F.when(F.col("c_acctbal") >= 0, "good")}
    labels = {"s": "segment", "n": "nation", "b": "balance"}
    return table(spark, folder, "customer").select("c_custkey", F.md5(X.fact_sheet(facts, labels).cast("binary")).alias("prompt"))


@probe("answer_key", f"""WITH {S.TRUTH},
n AS (SELECT task_id, level, row_number() OVER (PARTITION BY task_id ORDER BY level) AS i FROM lvls),
a AS (SELECT task_id, string_agg(chr(CAST(64 + i AS INTEGER)) || '. ' || level, chr(10) ORDER BY i) AS answer_key FROM n GROUP BY 1)
SELECT task_id, cond, answer_key, md5('Input: ' || cond || '{X.ANSWER_RULE}' || answer_key || chr(10) || 'Output: ') AS prompt FROM a JOIN conds USING (task_id)""")
def answer_key(spark, folder):
    truth = S.truth_cells(spark, folder)
    levels = T.task_levels(truth).groupBy("task_id").agg(F.array_sort(F.collect_list("level")).alias("levels"))
    asked = T.scoped(truth).select("task_id", "cond").distinct().join(levels, "task_id")
    return asked.select("task_id", "cond", X.answer_key("levels").alias("answer_key"),
                        F.md5(X.option_prompt("cond", "levels").cast("binary")).alias("prompt"))


@probe("prompt_permutations", """WITH RECURSIVE k AS (SELECT DISTINCT user_id, event_type AS x FROM events),
c AS (SELECT user_id, count(*) AS k FROM k GROUP BY 1),
r AS (SELECT user_id, [x] AS seq FROM k UNION ALL SELECT r.user_id, list_append(seq, x) FROM r JOIN k USING (user_id) WHERE NOT list_contains(seq, x))
SELECT user_id, array_to_string(seq, ',') AS shown, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS permutation
FROM r JOIN c USING (user_id) WHERE len(seq) = k""")
def permutations(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type").distinct()
    prompts = events.groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("levels"))
    out = prompt_permutations(prompts, "levels", "user_id")
    return out.select("user_id", F.col("permutation").cast("bigint").alias("permutation"), F.array_join("shown", ",").alias("shown"))


TITLE = {"1-URGENT": "age_group", "2-HIGH": "race", "3-MEDIUM": "sex"}


@probe("hd_task_title", f"""WITH v AS (SELECT DISTINCT o_orderstatus, o_orderpriority,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Age' WHEN '2-HIGH' THEN 'Race' WHEN '3-MEDIUM' THEN 'Sex' ELSE o_orderpriority END AS name FROM orders)
SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'IPEDS' ELSE o_orderstatus END || ': Diabetes by ' || string_agg(name, ', ' ORDER BY o_orderpriority) AS title FROM v GROUP BY 1""")
def task_title(spark, folder):
    named = F.col("o_orderpriority")
    for value, variable in TITLE.items():
        named = F.when(F.col("o_orderpriority") == value, variable).otherwise(named)
    pairs = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderpriority", name_or_self(named, VARIABLE_NAMES).alias("name")
    ).distinct()
    grouped = pairs.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("o_orderpriority", "name"))).alias("c"))
    dataset = F.when(F.col("o_orderstatus") == "O", "edu").otherwise(F.col("o_orderstatus"))
    title = X.high_dim_title(name_or_self(dataset, DATASET_NAMES), name_or_self(F.lit("diabetes"), VARIABLE_NAMES), F.col("c.name"))
    return grouped.select("o_orderstatus", title.alias("title"))
