"""All table builders on driver tables under the sources' raw column names, and the catalog's cell tasks on what they build.

Codes run over more values than the sources know, so that unknown ones occur too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgauge.functions.labels import INF, interval_scheme
from popgauge.operators.cells import cell_sums, high_dim_floor, replicate_weights, replicated, share_positive
from popgauge.plans import builds as B
from popgauge.plans.catalog import high_dim_tasks
from popgauge.plans.scoring import eval_high_dim
from popgauge.probes import survey as S
from popgauge.probes.registry import poisson_sql, probe, r6, table, uniform_sql
from popgauge.session import cut_lineage

ID = "o_orderkey"


# ---------------------------------------------------------------- raw columns, as text that Spark and SQL both read

def code(salt: int, n: int, low: int = 0, a: str = "o_orderkey", b: str = "o_custkey") -> str:
    """One of ``n`` whole numbers from ``low``."""
    return f"(CAST(({a} * {7919 + 2 * salt} + {b} * {104729 + 6 * salt}) % 10007 % {n} AS INT) + {low})"


def number(sql: str) -> str:
    return f"CAST({sql} AS DOUBLE)"


def words(sql: str) -> str:
    return f"CAST({sql} AS STRING)"


def padded(sql: str, width: int) -> str:
    return f"lpad({words(sql)}, {width}, '0')"


def missing(salt: int, value: str, sql: str) -> str:
    return f"CASE WHEN {code(salt, 9)} = 0 THEN {value} ELSE {sql} END"


RAW: dict[str, dict[str, str]] = {
    "acs": {
        "PWGTP": words(code(1, 90, 1)), "SEX": words(code(2, 3, 1)), "AGEP": words(code(3, 99)), "RAC1P": words(code(4, 10)),
        "HISP": padded(code(5, 6, 1), 2), "NATIVITY": words(code(6, 3, 1)), "CIT": words(code(7, 6, 1)), "MAR": words(code(8, 6, 1)),
        "NPF": missing(9, "'N'", words(code(10, 8, 1))), "NOC": missing(11, "'N'", words(code(12, 5))), "ENG": missing(13, "'b'", words(code(14, 4, 1))),
        "SCHL": words(code(15, 26)), "WAGP": missing(16, "'-1'", words(code(17, 9973) + " * 25")), "WKHP": missing(18, "'N'", words(code(19, 99, 1))),
        "ESR": words(code(20, 8)), "COW": words(code(21, 10)), "OCCP": padded(code(22, 12), 4), "INDP": padded(code(23, 15, 160), 4),
        "POWSP": missing(24, "'N'", padded(code(25, 80), 3)), "state": words(code(26, 56, 1)),
    },
    "brfss": {
        "_STATE": number(code(1, 80, 1)), "_SEX": number(code(2, 3, 1)), "_IMPRACE": number(code(3, 7, 1)), "_AGE80": number(code(4, 66, 16)),
        "_EDUCAG": number(code(5, 5, 1)), "_INCOMG1": number(code(6, 8, 1)), "_BMI5": missing(7, "NULL", number(code(8, 5000, 1200))),
        **{source: missing(20 + i, "NULL", number(code(40 + i, 9, 1))) for i, (source, _, _) in enumerate(B.BRFSS_YES_NO.values())},
        "_LLCPWT": "o_totalprice / 1000",
    },
    "gss": {
        "sex": number(code(1, 3, 1)), "age": number(code(2, 70, 18)), "race": number(code(3, 4, 1)), "educ": number(code(4, 21)),
        "degree": number(code(5, 6)), "income16": number(code(6, 28)), "polviews": missing(7, "NULL", number(code(8, 9))),
        "partyid": number(code(9, 8)), "wtssnrps": missing(10, "NULL", "o_totalprice / 100000"),
    },
    "meps": {
        "SEX": code(1, 3, 1), "RACEV1X": code(2, 6, 1), "MARRY53X": code(3, 18, -7), "REGION53": code(4, 6, -1), "INSURC22": code(5, 9, 1),
        "AGE53X": code(6, 92, -1), "EDUCYR": code(7, 18), "TOTEXP22": code(8, 9973) + " * 5", "OPTOTV22": code(9, 20), "OBTOTV22": code(10, 14, -1),
        "IPDIS22": code(11, 13), "DVTOT22": code(12, 12), "PERWT22F": "o_totalprice / 100",
    },
    "nsduh": {
        **{c: missing(60 + i, "'no answer'", f"{words(code(i, n, 1))} || ' - said'") for i, (c, n) in enumerate(
            [("AGE3", 12), ("irsex", 2), ("NEWRACE2", 8), ("IREDUHIGHST2", 12), ("IRPINC3", 8)])},
        **{f"{d}{what}": missing(70 + 2 * i + j, "NULL", f"{words(code(20 + 2 * i + j, n, 1))} || ' - said'")
           for i, d in enumerate(B.NSDUH_DRUGS) for j, (what, n) in enumerate([("ever", 2), ("rec", 4)])},
        "ANALWT2_C": "o_totalprice / 10",
    },
    "scf": {
        "foodhome": "o_totalprice / 100", "foodaway": number(code(1, 9000)), "fooddelv": number(code(2, 5000)), "age": code(3, 85, 15),
        "hhsex": code(4, 3, 1), "racecl5": code(5, 6, 1), "edcl": code(6, 5, 1), "married": code(7, 3, 1), "kids": code(8, 6), "hhouses": code(9, 3),
        "income": "o_totalprice", "rent": number(code(10, 4000)), "asset": "o_totalprice * 700", "debt": "o_totalprice * 17",
        "networth": "o_totalprice * 683", "wgt": "o_totalprice / 50",
    },
}


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, "orders").select(ID, *[F.expr(sql).alias(column) for column, sql in RAW[name].items()])


# ---------------------------------------------------------------- the clean columns in SQL

def quoted(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def labels_sql(column: str, mapping: Mapping) -> str:
    key = lambda k: quoted(k) if isinstance(k, str) else str(k)
    return f"CASE {' '.join(f'WHEN {column} = {key(k)} THEN {quoted(v)}' for k, v in mapping.items() if v is not None)} END"


def place_sql(column: str, labels: Sequence[str]) -> str:
    return labels_sql(column, dict(enumerate(labels, 1)))


def cut_sql(x: str, edges: Sequence[float], labels: Sequence[str], *, right: bool = True, include_lowest: bool = True) -> str:
    low = "" if edges[0] == -INF else f"WHEN {x} {'<' if include_lowest or not right else '<='} {edges[0]} THEN NULL "
    arms = [f"WHEN {x} {'<=' if right else '<'} {hi} THEN {quoted(label)}" if hi != INF else f"WHEN {x} IS NOT NULL THEN {quoted(label)}"
            for hi, label in zip(edges[1:], labels)]
    return f"CASE {low}{' '.join(arms)} END"


def breaks_sql(x: str, breaks: Sequence[float], unit: str) -> str:
    return cut_sql(x, *interval_scheme(breaks, unit))


def yes_no_sql(source: str, yes: Sequence[int], no: Sequence[int]) -> str:
    return labels_sql(f'"{source}"', {**dict.fromkeys(yes, "Yes"), **dict.fromkeys(no, "No")})


_PLACE = "nullif(POWSP, 'N')"
_LEVEL = "nullif(TRY_CAST(SCHL AS INTEGER), 0)"
_SALARY = "nullif(TRY_CAST(WAGP AS DOUBLE), -1)"
_LEADING = "TRY_CAST(regexp_extract({}, '^([0-9]+) - ', 1) AS INTEGER)"

CLEAN: dict[str, dict[str, str]] = {
    "acs": {
        "sex": "CASE WHEN SEX = '2' THEN 'female' ELSE 'male' END", "age": "TRY_CAST(AGEP AS INTEGER)", "race": labels_sql("RAC1P", B.ACS_RACE),
        "hispanic_origin": "CASE WHEN HISP = '01' THEN 'no' ELSE 'yes' END", "citizenship": labels_sql("CIT", B.ACS_CITIZENSHIP),
        "nativity": labels_sql("NATIVITY", {"1": "native", "2": "foreign-born"}), "marital": labels_sql("MAR", B.ACS_MARITAL),
        "family_size": "TRY_CAST(NPF AS INTEGER)", "children": "TRY_CAST(NOC AS INTEGER)", "state": "state",
        "education": place_sql(_LEVEL, B.ACS_EDUCATION), "education_level": _LEVEL, "english_level": "TRY_CAST(ENG AS INTEGER)",
        "salary": _SALARY, "salary_group": breaks_sql(_SALARY, B.SALARY_BREAKS, "$"), "hours_worked": "TRY_CAST(WKHP AS DOUBLE)",
        "employment_status": labels_sql("ESR", B.ACS_EMPLOYMENT), "employer": labels_sql("COW", B.ACS_EMPLOYER), "place_of_work": _PLACE,
        "economic_region": f"CASE WHEN TRY_CAST({_PLACE} AS DOUBLE) > 56 THEN 'Abroad' " + " ".join(
            f"WHEN {_PLACE} IN ({', '.join(map(quoted, codes))}) THEN {quoted(region)}" for region, codes in reversed(B.ACS_REGIONS)) + " END",
        "weight": "TRY_CAST(PWGTP AS INTEGER)", "occp_name": "coalesce(occp_name, '')", "occp_code": "coalesce(occp_code, '')",
        "ind_name": "coalesce(ind_name, '')", "ind_code": "coalesce(ind_code, '')",
    },
    "brfss": {
        "state": labels_sql('"_STATE"', B.STATES), "sex": labels_sql('"_SEX"', {1: "Male", 2: "Female"}), "race": labels_sql('"_IMPRACE"', B.BRFSS_RACE),
        "age": '"_AGE80"', "age_group": cut_sql('"_AGE80"', [*B.BRFSS_AGE_EDGES[:-1], 81], B.BRFSS_AGE_LABELS, right=False),
        "education": labels_sql('"_EDUCAG"', B.BRFSS_EDUCATION), "income": labels_sql('"_INCOMG1"', B.BRFSS_INCOME), "bmi": '"_BMI5" / 100.0',
        **{name: yes_no_sql(*spec) for name, spec in B.BRFSS_YES_NO.items()}, "weight": '"_LLCPWT"',
    },
    "gss": {
        "wgh": "wtssnrps", "sex": labels_sql("sex", {1: "male", 2: "female"}), "age": "age", "race": labels_sql("race", {1: "white", 2: "black", 3: "other"}),
        "degree": labels_sql("degree", B.GSS_DEGREE), "edu": "educ", "house_income": labels_sql("income16", B.GSS_INCOME),
        "view": cut_sql("polviews", [1, 3, 4, 7], ["liberal", "moderate", "conservative"])[:-3] + "ELSE NULL END", "party": labels_sql("partyid", B.GSS_PARTY),
    },
    "meps": {
        "sex": labels_sql("SEX", {1: "male", 2: "female"}), "race": labels_sql("RACEV1X", B.MEPS_RACE), "marital": labels_sql("MARRY53X", B.MEPS_MARITAL),
        "region": labels_sql("REGION53", B.MEPS_REGION), "insured": labels_sql("INSURC22", B.MEPS_INSURED), "insure_type": labels_sql("INSURC22", B.MEPS_INSURE_TYPE),
        "age": "AGE53X", "education_years": "EDUCYR", "expenditure": "TOTEXP22", "outpatient_visits": "OPTOTV22", "office_visits": "OBTOTV22",
        "inpatient_visits": "IPDIS22", "dental_visits": "DVTOT22", "weight": "PERWT22F",
        "age_group": cut_sql("AGE53X", [*B.FIVE_YEAR_TOPS, INF], [*B.FIVE_YEAR_LABELS, "85+"], include_lowest=False),
        "expenditure_group": breaks_sql("TOTEXP22", B.EXPENDITURE_BREAKS, "US dollars"),
        **{f"{n}_group": cut_sql(c, B.VISIT_EDGES, B.VISIT_LABELS) for n, c in
           {"office_visits": "OBTOTV22", "inpatient_visits": "IPDIS22", "dental_visits": "DVTOT22"}.items()},
    },
    "nsduh": {
        "age": place_sql(_LEADING.format("AGE3"), B.NSDUH_AGE), "sex": f"CASE WHEN {_LEADING.format('irsex')} = 1 THEN 'male' ELSE 'female' END",
        "race": place_sql(_LEADING.format("NEWRACE2"), B.NSDUH_RACE), "edu": place_sql(_LEADING.format("IREDUHIGHST2"), B.NSDUH_EDUCATION),
        "income": place_sql(_LEADING.format("IRPINC3"), B.NSDUH_INCOME),
        **{f"{d}_{name}": f"CASE WHEN {_LEADING.format(d + what)} = 1 THEN 'yes' ELSE 'no' END"
           for name, what in (("ever", "ever"), ("monthly", "rec")) for d in B.NSDUH_DRUGS},
        "weight": "ANALWT2_C",
    },
    "scf": {
        "age": "age", "age_group": cut_sql("age", [*B.FIVE_YEAR_TOPS, 89, INF], [*B.FIVE_YEAR_LABELS, "85-89", "90+"], include_lowest=False),
        "sex": labels_sql("hhsex", {1: "Male", 2: "Female"}), "race": labels_sql("racecl5", B.SCF_RACE), "education": labels_sql("edcl", B.SCF_EDUCATION),
        "married": labels_sql("married", {1: "yes", 2: "no"}), "kids": "kids", "food": "foodhome + foodaway + fooddelv",
        "house_own": labels_sql("hhouses", {1: "yes", 0: "no"}), "income": "income", "rent": "rent",
        **{c: c for c in ("asset", "debt", "networth")}, "weight": "wgt",
        **{f"{c}_group": breaks_sql("(foodhome + foodaway + fooddelv)" if c == "food" else c, breaks, "US dollars") for c, breaks in B.SCF_BREAKS.items()},
    },
}


def raw_sql(name: str) -> str:
    return f"SELECT {ID}, " + ", ".join(f'{sql} AS "{column}"' for column, sql in RAW[name].items()) + " FROM orders"


def clean_sql(name: str, source: str = "") -> str:
    columns = ", ".join(f"{sql} AS {column}" for column, sql in CLEAN[name].items())
    return f"SELECT {ID}, {columns} FROM {source or f'({raw_sql(name)}) r'}"


OCCUPATIONS = {"row": "p_partkey", "code": "CASE WHEN p_partkey % 10 = 7 THEN 'nan' ELSE ' ' || lpad(CAST(p_partkey % 10 AS STRING), 4, '0') || ' ' END",
               "name": "p_name", "group": "p_brand"}
INDUSTRIES = {"row": "p_partkey", "code": "lpad(CAST(p_partkey % 12 + 160 AS STRING), 4, '0')", "name": "p_type", "group": "p_brand"}


def _codes_sql(columns: Mapping[str, str], prefix: str) -> str:
    return f"""SELECT trim({columns["code"]}) AS c, arg_max({columns["name"]}, p_partkey) AS {prefix}_name, arg_max({columns["group"]}, p_partkey) AS {prefix}_code
FROM part WHERE trim({columns["code"]}) NOT IN ('', 'nan') GROUP BY 1"""


@probe("build_acs", clean_sql("acs", f"""({raw_sql("acs")}) r LEFT JOIN ({_codes_sql(OCCUPATIONS, "occp")}) o ON o.c = nullif(OCCP, '0009')
LEFT JOIN ({_codes_sql(INDUSTRIES, "ind")}) i ON i.c = nullif(INDP, '0169')"""))
def build_acs(spark, folder):
    part = table(spark, folder, "part")
    lists = [part.select(*[F.expr(sql).alias(c) for c, sql in columns.items()]) for columns in (OCCUPATIONS, INDUSTRIES)]
    return B.acs(landed(spark, folder, "acs"), *lists, keep=[ID])


@probe("build_brfss", clean_sql("brfss"))
def build_brfss(spark, folder):
    return B.brfss(landed(spark, folder, "brfss"), keep=[ID])


@probe("build_gss", clean_sql("gss") + " WHERE wtssnrps IS NOT NULL")
def build_gss(spark, folder):
    return B.gss(landed(spark, folder, "gss"), keep=[ID])


@probe("build_meps", clean_sql("meps"))
def build_meps(spark, folder):
    return B.meps(landed(spark, folder, "meps"), keep=[ID])


@probe("build_nsduh", clean_sql("nsduh"))
def build_nsduh(spark, folder):
    return B.nsduh(landed(spark, folder, "nsduh"), keep=[ID])


@probe("build_scf", clean_sql("scf"))
def build_scf(spark, folder):
    return B.scf(landed(spark, folder, "scf"), keep=[ID])


# ---------------------------------------------------------------- examinations: many tables, one row or many a person

_EXAM_VALUES = {"RIDAGEYR": (80, 10), "RIAGENDR": (3, 1), "RIDRETH3": (9, 1), "WTMEC2YR": (5, 0), "BMXBMI": (30, 15)}
_EXAM_TABLES = list(dict.fromkeys(c.table for c in B.NHANES_CONCEPTS))


def _exam(name: str) -> tuple[str, dict[str, str], str]:
    """Source table, raw columns and filter of an examination table."""
    concepts = [(i, c) for i, c in enumerate(B.NHANES_CONCEPTS) if c.table == name]
    if name == "DR1IFF_L":
        eaten = {c.column: f"CASE WHEN o_orderkey % 11 = {i % 11} THEN NULL ELSE {number(code(i, 900))} END" for i, c in concepts if c.total}
        return "orders", {"SEQN": "o_custkey", **eaten, "WTDRD1": "CAST(o_custkey % 9 AS DOUBLE)"}, "TRUE"
    value = lambda i, c: number(code(i, *_EXAM_VALUES.get(c.column, (7, 1)), a="c_custkey", b="c_nationkey"))
    some = "TRUE" if name == "DEMO_L" else f"c_custkey % {3 + _EXAM_TABLES.index(name)} <> 0"
    return "customer", {"SEQN": "c_custkey", **{c.column: f"CASE WHEN c_custkey % 13 = {i % 13} THEN NULL ELSE {value(i, c)} END" for i, c in concepts}}, some


_RECODES = {
    None: "{0}", "nhanes_sex": "CASE WHEN {0} IS NOT NULL THEN CASE WHEN {0} = 1 THEN 'Male' ELSE 'Female' END END",
    "nhanes_race": "CASE WHEN {0} IN (1, 2) THEN 'Hispanic' WHEN {0} = 3 THEN 'White' WHEN {0} = 4 THEN 'Black' WHEN {0} = 6 THEN 'Asian' WHEN {0} = 7 THEN 'Other' END",
    "nhanes_diab": "CASE WHEN {0} IN (1, 3) THEN 1 WHEN {0} = 2 THEN 0 END", "nhanes_alcohol": "CASE WHEN {0} IN (1, 2, 3, 4, 5) THEN 1 ELSE 0 END",
    "nhanes_smoke": "CASE WHEN {0} = 1 THEN 1 ELSE 0 END", "nhanes_kidney": "CASE WHEN {0} IS NOT NULL THEN CASE WHEN {0} = 1 THEN 1 ELSE 0 END END",
}
_FLAGS = ("diabetes", "alcohol_weekly", "smoking", "kidney_failure")


def _exam_sql() -> str:
    parts = []
    for name in _EXAM_TABLES:
        source, columns, some = _exam(name)
        raw = f"SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {source} WHERE {some}"
        wanted = [c for c in B.NHANES_CONCEPTS if c.table == name]
        if any(c.total for c in wanted):
            said = ", ".join(f"{'sum' if c.total else 'min'}({c.column}) AS {c.name}" for c in wanted)
            parts.append(f"{name} AS (SELECT SEQN, {said} FROM ({raw}) GROUP BY 1)")
        else:
            parts.append(f"{name} AS (SELECT SEQN, {', '.join(f'{_RECODES[c.recoder].format(c.column)} AS {c.name}' for c in wanted)} FROM ({raw}))")
    joins = " ".join(f"LEFT JOIN {name} USING (SEQN)" for name in _EXAM_TABLES[1:])
    plain = [c.name for c in B.NHANES_CONCEPTS if c.name not in (*_FLAGS, "diet_wgh")]
    flags = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN {c} = 1 THEN 'yes' ELSE 'no' END END AS {c}" for c in _FLAGS)
    return f"""WITH {", ".join(parts)} SELECT SEQN, {", ".join(plain)}, coalesce(diet_wgh, 0.0::DOUBLE) AS diet_wgh, {flags},
{cut_sql("bmi", *B.NHANES_BMI)} AS bmi_bin, {cut_sql("age", *B.NHANES_AGE)} AS age_group FROM DEMO_L {joins} WHERE mec_wgh > 0 AND age >= 18"""


@probe("build_nhanes", _exam_sql())
def build_nhanes(spark, folder):
    tables = {}
    for name in _EXAM_TABLES:
        source, columns, some = _exam(name)
        tables[name] = table(spark, folder, source).where(F.expr(some)).select(*[F.expr(sql).alias(c) for c, sql in columns.items()])
    return B.nhanes_labels(B.nhanes(tables))


# ---------------------------------------------------------------- published tables of counts and shares

DEGREES = {"title": "' ' || p_name || ' ' || p_type || ' ' || CAST(p_partkey AS STRING) || ' '",
           "men": "CASE WHEN p_partkey % 23 = 0 THEN 'n/a' ELSE CAST(p_partkey % 50 + 1 AS STRING) || ',' || lpad(CAST(p_size * 7 AS STRING), 3, '0') END",
           "women": "CAST(p_partkey % 31 + 1 AS STRING) || ',' || lpad(CAST(p_size * 5 AS STRING), 3, '0')"}
_SHARE = "100 * TRY_CAST(replace(men, ',', '') AS DOUBLE) / (TRY_CAST(replace(men, ',', '') AS DOUBLE) + TRY_CAST(replace(women, ',', '') AS DOUBLE))"


def _of_part(columns: Mapping[str, str]) -> str:
    return f"(SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM part)"


def _parts(spark, folder, columns):
    return table(spark, folder, "part").select(*[F.expr(sql).alias(c) for c, sql in columns.items()])


@probe("build_education", f"""WITH d AS (SELECT trim(lower(title)) AS degree, {_SHARE} AS male FROM {_of_part(DEGREES)})
SELECT degree, 'male' AS sex, round(male, 9) AS weight FROM d UNION ALL SELECT degree, 'female', round(100 - male, 9) FROM d""")
def build_education(spark, folder):
    return B.education(_parts(spark, folder, DEGREES)).withColumn("weight", F.round("weight", 9))


OFFENSES = {"row": "-p_partkey", "offense": """CASE WHEN p_partkey = 50 THEN 'Curfew and loitering law violations50' WHEN p_partkey % 40 = 3 THEN 'All other offenses (except traffic)'
  || CAST(p_partkey AS STRING) WHEN p_partkey % 40 = 4 THEN 'Larceny-theft' || CAST(p_partkey AS STRING) ELSE p_name || ' ' || p_type || ' ' || CAST(p_partkey AS STRING) END""",
            "male": "CASE WHEN p_partkey % 19 = 0 THEN '*' ELSE CAST(40 + p_partkey % 50 AS STRING) END", "female": "CAST(60 - p_partkey % 50 AS STRING)"}
BY_RACE = {"offense": OFFENSES["offense"], **{race: f"CAST(p_size * {i + 3} AS DOUBLE)" for i, race in enumerate(B.CRIME_RACES)}}
_CRIME_CELLS = " UNION ALL ".join(
    f"SELECT name, '{sex}' AS sex, '{race}' AS race, \"{race}\" * (TRY_CAST({sex} AS DOUBLE) / 100) AS weight FROM kept JOIN {_of_part(BY_RACE)} USING (offense)"
    for sex in ("male", "female") for race in B.CRIME_RACES)


@probe("build_fbi_arrests", f"""WITH sheet AS (SELECT *, trim(regexp_replace(trim(lower(offense)), '[0-9]+', '', 'g')) AS name FROM {_of_part(OFFENSES).replace("AS row,", 'AS "row",')}),
kept AS (SELECT * FROM sheet WHERE "row" <= (SELECT min("row") FROM sheet WHERE name = {quoted(B.CRIME_LAST)}))
SELECT coalesce({labels_sql("name", B.CRIME_NAMES)}, name) AS crime_type, sex, race, round(weight, 9) AS weight FROM ({_CRIME_CELLS})
WHERE name NOT IN ({", ".join(map(quoted, B.CRIME_HEADINGS))})""")
def build_fbi_arrests(spark, folder):
    built = B.fbi_arrests(_parts(spark, folder, OFFENSES), _parts(spark, folder, BY_RACE))
    return built.withColumn("weight", F.round("weight", 9))


JOBS = {"occupation": """CASE WHEN p_partkey % 97 = 5 THEN NULL WHEN p_partkey % 50 = 7 THEN 'Military specific occupations' WHEN p_partkey % 50 = 8 THEN 'All other ' || p_name
  WHEN p_partkey % 50 = 9 THEN 'Bus drivers, transit and intercity' WHEN p_partkey % 50 = 10 THEN 'Other designers' ELSE p_name || '-workers ' || CAST(p_partkey AS STRING) END""",
        "total": "CASE WHEN p_partkey % 13 = 0 THEN '-' ELSE CAST(p_size * 10 AS STRING) END", "female": "CASE WHEN p_partkey % 17 = 0 THEN '–' ELSE CAST(p_partkey % 101 AS STRING) END",
        "white": "CAST(60 + p_size % 20 AS STRING)", "black": "CAST(p_partkey % 11 AS STRING)", "asian": "CAST(p_partkey % 7 AS STRING)"}
_JOB = "trim(regexp_replace(trim(lower(occupation)), '[0-9-]+', '', 'g'))"
_JOB_CELLS = " UNION ALL ".join(
    f"SELECT occupation, '{sex}' AS sex, '{race}' AS race, ({race} * total / 100) * {share} AS weight FROM s"
    for sex, share in (("female", "female"), ("male", "(1 - female)")) for race in ("white", "black", "asian", "other"))


@probe("build_labor", f"""WITH n AS (SELECT occupation, {", ".join(f"TRY_CAST(nullif(nullif({c}, '-'), '–') AS DOUBLE) AS {c}" for c in ("total", "white", "black", "asian"))},
  TRY_CAST(nullif(nullif(female, '-'), '–') AS DOUBLE) / 100 AS female FROM {_of_part(JOBS)} WHERE occupation IS NOT NULL),
s AS (SELECT *, 100 - white - black - asian AS other FROM n),
c AS (SELECT CASE WHEN {_JOB} IN ({", ".join(map(quoted, B.LABOR_RENAMES))}) THEN {labels_sql(_JOB, B.LABOR_RENAMES)} ELSE {_JOB} END AS occupation, sex, race, round(weight, 9) AS weight
  FROM ({_JOB_CELLS}) WHERE occupation NOT IN ({", ".join(map(quoted, B.LABOR_HEADINGS))}) AND NOT regexp_matches(occupation, '(?i)\\ball other\\b'))
SELECT * FROM c WHERE occupation IS NOT NULL AND weight IS NOT NULL""")
def build_labor(spark, folder):
    return B.labor(_parts(spark, folder, JOBS)).withColumn("weight", F.round("weight", 9))


# ---------------------------------------------------------------- the catalog's cell tasks, end to end

BUILDERS = {"brfss": B.brfss, "nsduh": B.nsduh, "meps": B.meps, "scf": B.scf}
TASKS = high_dim_tasks()
#: What each model's answers weigh a respondent with; every model answers every cell.
MODELS = {"flat": "1.0", "steep": "weight * weight"}


def _tasks_sql(task) -> str:
    cell = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in task.conditions)
    return (f"SELECT {task.task_id} AS task_id, {cell} AS cell, CASE WHEN {task.outcome} IN ('yes', 'Yes') THEN 1.0::DOUBLE ELSE 0.0 END AS y, weight AS w, "
            f"{', '.join(f'{sql}::DOUBLE AS m_{m}' for m, sql in MODELS.items())}, {ID} FROM c_{task.dataset} WHERE {task.outcome} IS NOT NULL")


@probe("catalog_cell_scores", f"""WITH {", ".join(f"c_{name} AS MATERIALIZED ({clean_sql(name)})" for name in BUILDERS)},
hd AS ({" UNION ALL ".join(map(_tasks_sql, TASKS))}),
draws AS MATERIALIZED (SELECT {ID}, b, {poisson_sql("u")} AS c FROM (SELECT {ID}, b, {uniform_sql(ID, stream="b")} AS u FROM orders, generate_series(0, 9) g(b))),
picks AS (SELECT {ID}, {", ".join(f"max(c) FILTER (b = {b}) AS c{b}" for b in range(10))} FROM draws GROUP BY 1),
cells AS MATERIALIZED (SELECT task_id, cell, sum(w) AS w, sum(w * y) / sum(w) AS p, {", ".join(f"sum(m_{m} * y) / sum(m_{m}) AS q_{m}" for m in MODELS)},
  {", ".join(f"sum(w * c{b}) AS wb{b}, sum(w * y * c{b}) AS wyb{b}" for b in range(10))} FROM hd JOIN picks USING ({ID}) GROUP BY ALL),
reps AS (SELECT task_id, cell, w, p, unnest([{", ".join(f"{{'b': {b}, 'wb': wb{b}, 'wyb': wyb{b}}}" for b in range(10))}], recursive := true) FROM cells),
ov AS (SELECT task_id, b, sum(wyb) / sum(wb) AS share FROM reps GROUP BY ALL),
l1s AS (SELECT task_id, b, sum(abs(coalesce(CASE WHEN wb > 0 THEN wyb / wb END, share) - p) * w) / sum(w) AS l1 FROM reps JOIN ov USING (task_id, b) GROUP BY ALL),
fl AS (SELECT task_id, quantile_cont(l1, 0.975) AS best FROM l1s GROUP BY 1),
said AS ({" UNION ALL ".join(f"SELECT task_id, w, p, '{m}' AS model, q_{m} AS q FROM cells" for m in MODELS)}),
ev AS (SELECT model, task_id, sum(abs(p - q) * w) / sum(w) AS score, least(sum(p * w), sum((1 - p) * w), sum(abs(p - 0.5) * w)) / sum(w) AS worst FROM said GROUP BY ALL)
SELECT model, task_id, round(score, 6) AS score, round(worst, 6) AS worst, round(best, 6) AS best, round({S.bench_sql("score", "worst", "best")}, 6) AS bench FROM ev JOIN fl USING (task_id)""")
def catalog_cell_scores(spark, folder):
    """All tasks of the catalog with several conditions: raw tables, builders, cells, floors, bench scores."""
    built = []
    for name, builder in BUILDERS.items():
        tasks = [t for t in TASKS if t.dataset == name]
        counted, replicates = replicate_weights(builder(landed(spark, folder, name), keep=[ID]), tasks, [ID])
        built.append(cell_sums(counted, tasks, extra={**replicates, **{m: F.expr(sql).cast("double") for m, sql in MODELS.items()}}))
    sums = built[0]
    for more in built[1:]:
        sums = sums.unionByName(more)
    sums = cut_lineage(sums)
    answers = [share_positive(sums, weight=m, name="q").select(F.lit(m).alias("model"), F.lit("QA").alias("prompting"), "task_id", "cell", "q") for m in MODELS]
    runs = eval_high_dim(share_positive(sums), answers[0].unionByName(answers[1]), high_dim_floor(replicated(sums)))
    return runs.select("model", "task_id", *[r6(c).alias(c) for c in ("score", "worst", "best", "bench")])
