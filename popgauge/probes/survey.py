"""The probe survey: order lines as weighted respondents, and its tasks.

Respondents are order lines; outcomes are banded quantities and prices, the return flag and whether
there was a rebate; conditions come from the order, the customer and the part. Line quantity is the
survey weight. The "models" are the suppliers' regions and the two promptings the line
status: what lines from that region look like, weighted by price, is that model's answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgauge.functions.labels import cut, interval_scheme
from popgauge.functions.recode import recode_map
from popgauge.operators.cells import bootstrap_cells, cell_sums, high_dim_floor, share_positive
from popgauge.operators.floors import bootstrap_floor
from popgauge.operators.tabulate import CELL, fold_parts, merge_cells, task_cells
from popgauge.plans.scoring import eval_high_dim, eval_low_dim, score_table
from popgauge.probes.registry import poisson_sql, table, text_sql, uniform_sql
from popgauge.session import shared_folder
from popgauge.sources.floorstore import FloorStore, fingerprints
from popgauge.spec import AGGREGATE_DATASETS, HighDimTask, LowDimTask, Subset, task_frame

IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
MEASURES = ["l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]

QTY_EDGES, QTY_LABELS = interval_scheme([5, 20, 45], "units")
SPEND_EDGES, SPEND_LABELS = interval_scheme([2000, 10000, 30000, 90000], "$")

MODEL_OF_REGION = {
    "AFRICA": "llama3_8b_instruct", "AMERICA": "llama3_8b", "ASIA": "mistral_7b_instruct",
    "EUROPE": "mistral_7b", "MIDDLE EAST": "phi4",
}

LOW = [
    LowDimTask(1, "ACS: Spend by Priority", "acs", "spend_band", "priority",
               prompt="What is spent on an order of priority {}?",
               prompt_prob="For an order of priority {}, what is the probability that {} is spent?"),
    LowDimTask(2, "GSS: Spend by Segment", "gss", "spend_band", "segment",
               prompt="What does a {} customer spend?",
               prompt_prob="For a {} customer, what is the probability that they spend {}?"),
    LowDimTask(3, "BRFSS: Quantity by Region", "brfss", "qty_band", "region",
               subset=Subset("total", at_least=100000.0),
               prompt="How many units does a customer from {} buy?",
               prompt_prob="For a customer from {}, what is the probability that they buy {}?"),
    LowDimTask(4, "MEPS: Quantity by Size", "meps", "qty_band", "psize", cond_range=(10, 40),
               prompt="How many units of a part of size {} are bought?",
               prompt_prob="For a part of size {}, what is the probability that {} are bought?"),
    LowDimTask(5, "NSDUH: Flag by Type", "nsduh", "flag", "ptype",
               prompt="What is the return flag of a {} part?",
               prompt_prob="For a {} part, what is the probability that its flag is {}?"),
    LowDimTask(6, "SCF: Rebate by Brand", "scf", "rebate", "brand",
               subset=Subset("priority", levels=("1-URGENT", "2-HIGH")),
               prompt="Is there a rebate on parts of {}?",
               prompt_prob="For a part of {}, what is the probability that they answer {} when asked for a rebate?"),
    LowDimTask(7, "Labor: Spend", "labor", "spend_band", None, prompt="What is spent?", weight=None),
]

HIGH = [
    HighDimTask(101, "brfss", "rebate", ("priority", "segment")),
    HighDimTask(102, "nsduh", "rebate", ("segment", "ostatus")),
    HighDimTask(103, "meps", "rebate", ("priority", "region", "ptype")),
    HighDimTask(104, "scf", "rebate", ("segment", "ostatus", "region", "ptype")),
]

ORDER_COLUMNS = {"priority": "o_orderpriority", "ostatus": "o_orderstatus", "total": "o_totalprice"}
CUSTOMER_COLUMNS = {"segment": "c_mktsegment", "acctbal": "c_acctbal"}
PART_COLUMNS = {"ptype": "p_type", "psize": "p_size", "brand": "p_brand", "retail": "p_retailprice"}
RUN_COLUMNS = ["model", "prompting"]

TASK_COLUMNS = ["spend_band", "qty_band", "flag", "rebate", "priority", "segment", "region", "psize", "ptype",
                "brand", "total"]
CELL_COLUMNS = ["rebate", "priority", "segment", "region", "ostatus", "ptype"]

#: Bytes of order lines from which the survey is folded in parts, and the most parts: each reads the tables once more.
PART_BYTES, MOST_PARTS = 32 << 20, 4
#: Bytes of suppliers up to which they are broadcast, as two short columns.
BROADCAST_BYTES = 16 << 20


def survey(spark: SparkSession, folder: str, *columns: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The respondent keys, ``weight``, ``spend`` and the named columns.

    Only the tables that the columns come from are joined. ``part`` (i, n) takes the i-th of n parts of the orders.
    """
    wanted = set(columns)
    df = in_part(table(spark, folder, "lineitem"), "l_orderkey", part).select(*IDS, *MEASURES)
    needs_customer = wanted & {*CUSTOMER_COLUMNS, "region"}
    if needs_customer or wanted & set(ORDER_COLUMNS):
        orders = in_part(table(spark, folder, "orders"), "o_orderkey", part).select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
            *[F.col(c).alias(n) for n, c in ORDER_COLUMNS.items() if n in wanted],
        )
        if needs_customer:
            customers = table(spark, folder, "customer").select(
                F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                *[F.col(c).alias(n) for n, c in CUSTOMER_COLUMNS.items() if n in wanted],
            )
            if "region" in wanted:
                customers = customers.join(
                    regions(spark, folder).withColumnsRenamed({"nationkey": "c_nationkey", "r_name": "region"}),
                    "c_nationkey",
                )
            orders = orders.join(customers.drop("c_nationkey"), "o_custkey")
        df = df.join(orders.drop("o_custkey"), "l_orderkey")
    if wanted & set(PART_COLUMNS):
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"), *[F.col(c).alias(n) for n, c in PART_COLUMNS.items() if n in wanted]
        )
        df = df.join(parts, "l_partkey")
    if "model" in wanted:
        suppliers = table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nationkey")
        )
        named = regions(spark, folder).select("nationkey", recode_map("r_name", MODEL_OF_REGION).alias("model"))
        named = suppliers.join(named, "nationkey").drop("nationkey")
        df = df.join(F.broadcast(named) if table_bytes(spark, folder, "supplier") <= BROADCAST_BYTES else named, "l_suppkey")
    # Bands and names are made last, from numbers that are shorter to shuffle.
    local = {
        "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"),
        "qty": F.col("l_quantity"), "tax": F.col("l_tax"), "discount": F.col("l_discount"),
        "qty_band": cut("l_quantity", QTY_EDGES, QTY_LABELS),
        "spend_band": cut("l_extendedprice", SPEND_EDGES, SPEND_LABELS),
        "rebate": F.when(F.col("l_discount") >= 0.05, "yes").otherwise("no"),
        "prompting": F.when(F.col("l_linestatus") == "O", "QA").otherwise("Likelihood"),
    }
    return df.select(
        *[c for c in df.columns if c in IDS], F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("spend"),
        *[expr.alias(name) for name, expr in local.items() if name in wanted],
        *[c for c in df.columns if c not in IDS and c not in MEASURES],
    )


def in_part(df: DataFrame, key: str, part: tuple[int, int]) -> DataFrame:
    """Rows whose ``key`` falls into the i-th of n parts by its hash; a NULL key falls into one of them, too."""
    i, n = part
    return df if n == 1 else df.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)) == i)


def table_bytes(spark: SparkSession, folder: str, name: str) -> int:
    """Size of a table's files."""
    return int(str(table(spark, folder, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def survey_parts(spark: SparkSession, folder: str, *columns: str) -> list[DataFrame]:
    """The survey as parts that hold each respondent once, more of them the larger the order lines are, up to a few."""
    n = max(1, min(MOST_PARTS, -(-table_bytes(spark, folder, "lineitem") // PART_BYTES)))
    return [survey(spark, folder, *columns, part=(i, n)) for i in range(n)]


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """(nationkey, r_name): the two dimension tables of fixed size."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nationkey"), "r_name"
    )


def low_cells(spark: SparkSession, folder: str, tasks: list[LowDimTask] = LOW) -> DataFrame:
    """Cells of all low-dimensional tasks by run, from one pass over the parts, cut off from it.

    ``w`` weighs the truth, ``mw`` the answers. Truth, answers and floors all merge these cells.
    """
    parts = survey_parts(spark, folder, *TASK_COLUMNS, *RUN_COLUMNS)
    return fold_parts(parts, lambda rows: task_cells(rows, tasks, RUN_COLUMNS, extra={"mw": F.col("spend")}), [*RUN_COLUMNS, *CELL])


def truth_of(cells: DataFrame) -> DataFrame:
    return merge_cells(cells)


def answers_of(cells: DataFrame) -> DataFrame:
    return merge_cells(cells.where(F.col("cond").isNotNull()), *RUN_COLUMNS, weight="mw")


def floor_store(spark: SparkSession) -> FloorStore:
    return FloorStore(spark, f"{shared_folder(spark)}/floor-store")


def floors_of(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """Floors of the store; those it lacks are drawn and added."""
    truth = truth_of(cells)
    return floor_store(spark).floors(
        fingerprints(truth, ["cond", "level"], ["w", "n"], "low 100 0.975 0"),
        lambda ids: bootstrap_floor(truth.where(F.col("task_id").isin(ids)), task_frame(spark, [t for t in LOW if t.task_id in ids])))


def truth_cells(spark: SparkSession, folder: str, tasks: list[LowDimTask] = LOW) -> DataFrame:
    """Truth alone: no run columns, so neither suppliers nor line status are read."""
    return task_cells(survey(spark, folder, *TASK_COLUMNS), tasks)


def high_cells(spark: SparkSession, folder: str, tasks: list[HighDimTask] = HIGH) -> DataFrame:
    """Cells of all high-dimensional tasks by run, from one pass over the parts."""
    parts, extra = survey_parts(spark, folder, *CELL_COLUMNS, *RUN_COLUMNS), {"mw": F.col("spend"), "one": F.lit(1.0)}
    return fold_parts(parts, lambda rows: cell_sums(rows, tasks, RUN_COLUMNS, extra=extra), [*RUN_COLUMNS, "task_id", "cell"])


def high_truth_of(cells: DataFrame) -> DataFrame:
    return share_positive(cells)


def high_answers_of(cells: DataFrame) -> DataFrame:
    return share_positive(cells, *RUN_COLUMNS, weight="mw", name="q").drop("w", "n")


def high_floors_of(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    """Floors of the store; for the tasks it lacks the respondents are resampled in one more pass."""
    truth = high_truth_of(cells).withColumn("cell", F.to_json("cell"))
    return floor_store(spark).floors(
        fingerprints(truth, ["cell"], ["w", "n", "p"], "high 10 0.975 0"),
        lambda ids: high_dim_floor(bootstrap_cells(survey_parts(spark, folder, *CELL_COLUMNS), [t for t in HIGH if t.task_id in ids], IDS)))


def high_mean_of(cells: DataFrame) -> DataFrame:
    """(task_id, q): the unweighted share of positives, which a constant predictor says everywhere."""
    return cells.groupBy("task_id").agg(F.try_divide(F.sum("oney"), F.sum("one")).alias("q"))


def scores(spark: SparkSession, folder: str, sums: DataFrame | None = None) -> DataFrame:
    """The probe's score table: all models, promptings and tasks, from two passes over the survey and the floors of the store."""
    cells, sums = low_cells(spark, folder), sums or high_cells(spark, folder)
    low = eval_low_dim(truth_of(cells), answers_of(cells), floors_of(spark, cells))
    high = eval_high_dim(high_truth_of(sums), high_answers_of(sums), high_floors_of(spark, folder, sums))
    return score_table(task_frame(spark, [*LOW, *HIGH]), low, high)


# ---------------------------------------------------------------- the same in SQL

def band_sql(column: str, edges: list[float], labels: list[str]) -> str:
    arms = [f"WHEN {column} <= {hi} THEN '{label}'" for hi, label in zip(edges[1:-1], labels)]
    return f"CASE {' '.join(arms)} WHEN {column} IS NOT NULL THEN '{labels[-1]}' END"


def case_sql(column: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {arms} END"


SURVEY = f"""survey AS (
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS weight, l_quantity AS qty,
  l_extendedprice AS spend, l_tax AS tax, l_discount AS discount, l_returnflag AS flag, l_linestatus AS status,
  {band_sql("l_quantity", QTY_EDGES, QTY_LABELS)} AS qty_band,
  {band_sql("l_extendedprice", SPEND_EDGES, SPEND_LABELS)} AS spend_band,
  CASE WHEN l_discount >= 0.05 THEN 'yes' ELSE 'no' END AS rebate,
  CASE WHEN l_linestatus = 'O' THEN 'QA' ELSE 'Likelihood' END AS prompting,
  o_orderpriority AS priority, o_orderstatus AS ostatus, o_totalprice AS total,
  c_mktsegment AS segment, c_acctbal AS acctbal, cr.r_name AS region,
  p_type AS ptype, p_size AS psize, p_brand AS brand, p_retailprice AS retail,
  {case_sql("sr.r_name", MODEL_OF_REGION)} AS model
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey)"""


def _scope_sql(task: LowDimTask) -> str:
    parts = []
    if task.condition:
        parts.append(f"{task.condition} IS NOT NULL")
        if task.cond_range:
            parts.append(f"{task.condition} BETWEEN {task.cond_range[0]} AND {task.cond_range[1]}")
    if task.subset and task.subset.levels is None:
        parts.append(f"{task.subset.column} >= {task.subset.at_least}")
    elif task.subset:
        parts.append(f"{task.subset.column} IN ({', '.join(repr(v) for v in task.subset.levels)})")
    return " AND ".join(parts) or "TRUE"


def long_sql(tasks: list[LowDimTask] = LOW) -> str:
    selects = []
    for t in tasks:
        cond = f"CAST({t.condition} AS VARCHAR)" if t.condition else "'All'"
        selects.append(
            f"SELECT {t.task_id} AS task_id, CASE WHEN {_scope_sql(t)} THEN {cond} END AS cond, "
            f"{t.outcome} AS level, CASE WHEN {_scope_sql(t)} THEN {t.weight or '1.0::DOUBLE'} END AS w, "
            f"spend AS mw, model, prompting FROM survey"
        )
    return f"{SURVEY},\nlong AS ({' UNION ALL '.join(selects)})"


TRUTH = long_sql() + """,
truth AS (SELECT task_id, cond, level, sum(w) AS w, count(w) AS n FROM long GROUP BY ALL),
lvls AS (SELECT DISTINCT task_id, level FROM truth),
kk AS (SELECT task_id, count(*) AS k FROM lvls GROUP BY 1),
reality AS (SELECT task_id, cond, level, w, n, w / sum(w) OVER (PARTITION BY task_id, cond) AS p
  FROM truth WHERE cond IS NOT NULL),
conds AS (SELECT task_id, cond, sum(w) AS tw, sum(n) AS n FROM reality GROUP BY ALL)"""

ANSWERS = TRUTH + """,
ans AS (SELECT model, prompting, task_id, cond, level, sum(mw) AS w FROM long WHERE cond IS NOT NULL GROUP BY ALL),
mdl AS (SELECT model, prompting, task_id, cond, level, w / sum(w) OVER (PARTITION BY model, prompting, task_id, cond) AS q
  FROM ans),
told AS (SELECT DISTINCT model, prompting, task_id, cond, TRUE AS told FROM ans),
spine AS (SELECT DISTINCT model, prompting, task_id, conds.cond, lvls.level FROM ans JOIN conds USING (task_id) JOIN lvls USING (task_id)),
errs AS (SELECT model, prompting, task_id, cond, CASE WHEN bool_or(told) THEN sum(abs(coalesce(p, 0) - coalesce(q, 0))) END AS l1,
    sum(abs(1.0::DOUBLE / k - coalesce(p, 0))) AS uni
  FROM spine LEFT JOIN reality USING (task_id, cond, level)
  LEFT JOIN mdl USING (model, prompting, task_id, cond, level) LEFT JOIN told USING (model, prompting, task_id, cond) JOIN kk USING (task_id) GROUP BY ALL),
runs AS (SELECT model, prompting, task_id, CASE WHEN count(l1) = count(*) THEN sum(l1 * tw) / sum(tw) END AS score, sum(uni * tw) / sum(tw) AS worst
  FROM errs JOIN conds USING (task_id, cond) GROUP BY ALL)"""

_COUNTS = ", ".join(str(t.task_id) for t in LOW if t.dataset in AGGREGATE_DATASETS) or "-1"


def floors_sql(levels: int, counts: str = _COUNTS) -> str:
    """The multinomial as a chain of binomial counts, one step a level; a count is the least k whose distribution function
    reaches the uniform draw. ``levels``: the most that a question has."""
    ctes = [f"""fl AS (SELECT reality.task_id, reality.cond, level, p, row_number() OVER q AS ord, count(*) OVER (PARTITION BY reality.task_id, reality.cond) AS k
  FROM reality JOIN conds USING (task_id, cond) WHERE conds.n > 0 AND tw > 0 WINDOW q AS (PARTITION BY reality.task_id, reality.cond ORDER BY level)),
fs0 AS (SELECT task_id, cond, b, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS rest, 1.0::DOUBLE AS pr, 0.0::DOUBLE AS l1
  FROM (SELECT DISTINCT task_id, cond FROM fl) JOIN conds USING (task_id, cond), generate_series(0, 99) g(b))"""]
    u = uniform_sql("task_id", text_sql("cond"), text_sql("level"), stream="b")
    for j in range(1, levels + 1):
        ctes.append(f"""fx{j} AS (SELECT task_id, cond, b, n, rest, pr, l1, p, ord = k AS last, CASE WHEN pr > 0 THEN least(1.0::DOUBLE, p / pr) ELSE 0.0::DOUBLE END AS r, {u} AS u
  FROM fs{j - 1} JOIN fl USING (task_id, cond) WHERE ord = {j}),
fw{j} AS (SELECT task_id, cond, b, u, x, sum(exp(lgamma(rest + 1) - lgamma(x + 1) - lgamma(rest - x + 1) + x * ln(r) + (rest - x) * ln(1 - r))) OVER (PARTITION BY task_id, cond, b ORDER BY x) AS f
  FROM (SELECT task_id, cond, b, u, rest, r, unnest(generate_series(CAST(greatest(0, floor(rest * r - 8 * sqrt(rest * r * (1 - r)) - 30)) AS BIGINT),
    CAST(least(rest, ceil(rest * r + 8 * sqrt(rest * r * (1 - r)) + 30)) AS BIGINT))) AS x FROM fx{j} WHERE NOT last AND r > 0 AND r < 1 AND rest > 0)),
fc{j} AS (SELECT task_id, cond, b, coalesce(min(x) FILTER (f >= u), max(x)) AS c FROM fw{j} GROUP BY ALL),
fd{j} AS (SELECT fx{j}.*, CASE WHEN last OR r >= 1 THEN rest WHEN r <= 0 OR rest = 0 THEN 0 ELSE c END AS c FROM fx{j} LEFT JOIN fc{j} USING (task_id, cond, b)),
fs{j} AS (SELECT task_id, cond, b, n, rest - c AS rest, pr - p AS pr, l1 + abs(c / n::DOUBLE - p) AS l1 FROM fd{j}),
fe{j} AS (SELECT task_id, cond, b, l1 + abs(c / n::DOUBLE - p) AS l1 FROM fd{j} WHERE last)""")
    told = " UNION ALL ".join(f"SELECT * FROM fe{j}" for j in range(1, levels + 1))
    return ",\n" + ",\n".join(ctes) + f""",
bl AS (SELECT e.task_id, e.cond, b, l1, tw FROM ({told}) e JOIN conds USING (task_id, cond)),
bm AS (SELECT task_id, b, sum(l1 * tw) / sum(tw) AS l1 FROM bl GROUP BY ALL),
floors AS (SELECT task_id, CASE WHEN task_id IN ({counts}) THEN 0.0::DOUBLE ELSE quantile_cont(l1, 0.975) END AS best FROM bm GROUP BY 1)"""


FLOORS = floors_sql(5)


def bench_sql(score: str, worst: str, best: str) -> str:
    top = f"(CASE WHEN {worst} < {best} THEN {best} + 0.0001::DOUBLE ELSE {worst} END)"
    # greatest and least skip NULLs: a missing score has to stay missing.
    return f"CASE WHEN {score} IS NOT NULL THEN 100 * greatest(least(({score} - {top}) / ({best} - {top}), 1), 0) END"


def cells_sql(tasks: list[HighDimTask] = HIGH) -> str:
    selects = [
        f"SELECT {t.task_id} AS task_id, concat_ws('|', {', '.join(t.conditions)}) AS cell, "
        f"CASE WHEN {t.outcome} IN ('yes', 'Yes') THEN 1.0::DOUBLE ELSE 0.0 END AS y, weight AS w, "
        f"spend AS mw, model, prompting, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM survey"
        for t in tasks
    ]
    return f"hd AS ({' UNION ALL '.join(selects)})"


CELLS = cells_sql() + """,
hp AS (SELECT task_id, cell, sum(w) AS w, count(*) AS n, sum(w * y) / sum(w) AS p FROM hd GROUP BY ALL),
hq AS (SELECT model, prompting, task_id, cell, sum(mw * y) / sum(mw) AS q FROM hd GROUP BY ALL),
hruns AS (SELECT DISTINCT model, prompting, task_id FROM hq),
hall AS (SELECT r.model, r.prompting, hp.task_id, hp.cell, w, p, q FROM hp JOIN hruns r USING (task_id)
  LEFT JOIN hq ON hq.model = r.model AND hq.prompting = r.prompting AND hq.task_id = hp.task_id AND hq.cell = hp.cell),
hev AS (SELECT model, prompting, task_id,
    CASE WHEN count(q) = count(*) THEN sum(abs(p - q) * w) / sum(w) END AS score,
    least(sum(p * w), sum((1 - p) * w), sum(abs(p - 0.5) * w)) / sum(w) AS worst FROM hall GROUP BY ALL)"""

BOOT_TASKS = " UNION ALL ".join(
    f"SELECT {t.task_id} AS task_id, concat_ws('|', {', '.join(t.conditions)}) AS cell, CASE WHEN {t.outcome} = 'yes' THEN 1.0::DOUBLE ELSE 0 END AS y, weight AS w, b, c FROM pc"
    for t in HIGH
)
HIGH_FLOORS = f"""us AS (SELECT survey.*, b, {uniform_sql(*IDS, stream="b")} AS u FROM survey, generate_series(0, 9) g(b)),
pc AS (SELECT *, {poisson_sql("u")} AS c FROM us),
bt AS ({BOOT_TASKS}),
cb AS (SELECT task_id, cell, b, sum(w) AS w, sum(w * y) / sum(w) AS p, sum(w * c) AS wb, sum(w * y * c) AS wyb FROM bt GROUP BY ALL),
ov AS (SELECT task_id, b, sum(wyb) / sum(wb) AS share FROM cb GROUP BY ALL),
hl AS (SELECT task_id, b, sum(abs(coalesce(CASE WHEN wb > 0 THEN wyb / wb END, share) - p) * w) / sum(w) AS l1 FROM cb JOIN ov USING (task_id, b) GROUP BY ALL),
hfloors AS (SELECT task_id, quantile_cont(l1, 0.975) AS best FROM hl GROUP BY 1)"""

_FACTS = ", ".join(
    [f"({t.task_id}, '{t.name}', '{t.dataset}', 1)" for t in LOW]
    + [f"({t.task_id}, '{t.task_id}', '{t.dataset}', {t.dim})" for t in HIGH]
)

SCORES = ANSWERS + FLOORS + ",\n" + CELLS + ",\n" + HIGH_FLOORS + f""",
facts(task_id, task_name, dataset, dim) AS (VALUES {_FACTS}),
bench AS (SELECT model, prompting, task_id, {bench_sql("score", "worst", "best")} AS score
    FROM runs JOIN floors USING (task_id)
  UNION ALL SELECT model, prompting, task_id, {bench_sql("score", "worst", "best")} FROM hev JOIN hfloors USING (task_id)),
scores AS (SELECT model, task_id, task_name, dataset, dim, score, prompting = 'Likelihood' AS prob
  FROM bench JOIN facts USING (task_id))"""
