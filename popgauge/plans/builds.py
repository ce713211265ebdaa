"""Clean survey tables from landed raw tables.

Each builder takes raw DataFrames (files already landed as Parquet or CSV) and returns the clean one. ``keep`` names raw
columns, respondent ids as a rule, to carry along: resampling and imputation need them.
The code lists are fixed values of the sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.functions.labels import INF, cut, cut_breaks
from popgauge.functions.recode import (
    coerce_numeric, null_fill, ordinal_label, recode_binary, recode_last_wins, recode_map, sentinel_to_null,
)
from popgauge.functions.text import normalise_name
from popgauge.operators.concepts import Concept, select_concepts
from popgauge.operators.filters import drop_headings, keep_until
from popgauge.operators.impute import impute_chained
from popgauge.operators.joins import lookup_default
from popgauge.operators.tabulate import split_counts

# ACS code lists.
ACS_RACE = {"1": "white", "2": "black", "3": "AIAN", "4": "AIAN", "5": "AIAN", "6": "asian", "7": "NHOPI", "8": "other", "9": "mix"}
ACS_CITIZENSHIP = {
    "1": "born in the US", "2": "born in Puerto Rico", "3": "born abroad of American parents",
    "4": "naturalized citizen", "5": "not a citizen",
}
ACS_MARITAL = {"1": "married", "2": "widowed", "3": "divorced", "4": "separated", "5": "never married"}
ACS_EDUCATION = [
    "No schooling completed",
    "Nursery school, preschool",
    "Kindergarten",
    "Grade 1",
    "Grade 2",
    "Grade 3",
    "Grade 4",
    "Grade 5",
    "Grade 6",
    "Grade 7",
    "Grade 8",
    "Grade 9",
    "Grade 10",
    "Grade 11",
    "12th grade - no diploma",
    "Regular high school diploma",
    "GED or alternative credential",
    "Some college, but less than 1 year",
    "1 or more years of college credit, no degree",
    "Associate's degree",
    "Bachelor's degree",
    "Master's degree",
    "Professional degree beyond a bachelor's degree",
    "Doctorate degree",
]
ACS_EMPLOYMENT = {
    "1": "employed", "2": "not at work", "3": "unemployed", "4": "employed", "5": "not at work", "6": "not in labor force",
}
ACS_EMPLOYER = {
    "1": "for-profit company", "2": "non-profit company", "3": "government", "4": "government", "5": "government",
    "6": "self-employed", "7": "self-employed", "8": "self-employed",
}
ACS_REGIONS = [
    ("New England", ["009", "023", "025", "033", "044", "050"]),
    ("Mideast", ["010", "011", "024", "034", "036", "042"]),
    ("Great Lakes", ["017", "018", "026", "039", "055"]),
    ("Plains", ["019", "020", "027", "029", "031", "038", "046"]),
    ("Southeast", ["001", "005", "012", "013", "021", "022", "028", "037", "045", "047", "051", "054"]),
    ("Southwest", ["004", "035", "040", "048"]),
    ("Rocky Mountain", ["008", "016", "040", "048", "030", "049", "056"]),
    ("Far West", ["002", "006", "015", "032", "041", "053"]),
]
SALARY_BREAKS = [12000, 25000, 50000, 75000, 100000, 150000, 200000]


def acs(raw: DataFrame, occupations: DataFrame, industries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``raw`` holds the survey codes as text; the code lists are (row, code, name, group)."""
    place = sentinel_to_null("POWSP", "N")
    rules = [(place.isin(*codes), region) for region, codes in ACS_REGIONS]
    rules.append((place.try_cast("double") > 56, "Abroad"))
    level = F.nullif(F.col("SCHL").try_cast("int"), F.lit(0))
    salary = sentinel_to_null(coerce_numeric("WAGP"), -1)
    clean = raw.select(
        *keep, recode_binary("SEX", "2", "female", "male").alias("sex"), F.col("AGEP").try_cast("int").alias("age"),
        recode_map("RAC1P", ACS_RACE).alias("race"), recode_binary("HISP", "01", "no", "yes").alias("hispanic_origin"),
        recode_map("CIT", ACS_CITIZENSHIP).alias("citizenship"),
        recode_map("NATIVITY", {"1": "native", "2": "foreign-born"}).alias("nativity"),
        recode_map("MAR", ACS_MARITAL).alias("marital"), F.col("NPF").try_cast("int").alias("family_size"),
        F.col("NOC").try_cast("int").alias("children"), "state",
        ordinal_label(level, ACS_EDUCATION).alias("education"), level.alias("education_level"),
        F.col("ENG").try_cast("int").alias("english_level"), salary.alias("salary"),
        cut_breaks(salary, SALARY_BREAKS, "$").alias("salary_group"), coerce_numeric("WKHP").alias("hours_worked"),
        recode_map("ESR", ACS_EMPLOYMENT).alias("employment_status"), sentinel_to_null("OCCP", "0009").alias("_occupation"),
        sentinel_to_null("INDP", "0169").alias("_industry"), recode_map("COW", ACS_EMPLOYER).alias("employer"),
        place.alias("place_of_work"), recode_last_wins(rules).alias("economic_region"),
        F.col("PWGTP").try_cast("int").alias("weight"),
    )
    occ = occupations.select("row", "code", F.col("name").alias("occp_name"), F.col("group").alias("occp_code"))
    ind = industries.select("row", "code", F.col("name").alias("ind_name"), F.col("group").alias("ind_code"))
    named = lookup_default(clean, occ, {"_occupation": "code"}, "row")
    named = lookup_default(named, ind, {"_industry": "code"}, "row")
    order = [c for c in clean.columns if not c.startswith("_")]
    at = order.index("employer")
    return named.select(*order[:at], "occp_name", "occp_code", "ind_name", "ind_code", *order[at:])


# BRFSS code lists.
STATES = {
    1: "Alabama", 2: "Alaska", 4: "Arizona", 5: "Arkansas", 6: "California", 8: "Colorado", 9: "Connecticut",
    10: "Delaware", 11: "District of Columbia", 12: "Florida", 13: "Georgia", 15: "Hawaii", 16: "Idaho", 17: "Illinois",
    18: "Indiana", 19: "Iowa", 20: "Kansas", 22: "Louisiana", 23: "Maine", 24: "Maryland", 25: "Massachusetts",
    26: "Michigan", 27: "Minnesota", 28: "Mississippi", 29: "Missouri", 30: "Montana", 31: "Nebraska", 32: "Nevada",
    33: "New Hampshire", 34: "New Jersey", 35: "New Mexico", 36: "New York", 37: "North Carolina", 38: "North Dakota",
    39: "Ohio", 40: "Oklahoma", 41: "Oregon", 44: "Rhode Island", 45: "South Carolina", 46: "South Dakota",
    47: "Tennessee", 48: "Texas", 49: "Utah", 50: "Vermont", 51: "Virginia", 53: "Washington", 54: "West Virginia",
    55: "Wisconsin", 56: "Wyoming", 66: "Guam", 72: "Puerto Rico", 78: "Virgin Islands",
}
BRFSS_RACE = {1: "White", 2: "Black", 3: "Asian", 4: "AIAN", 5: "Hispanic", 6: "Other"}
BRFSS_AGE_EDGES = [18, 25, 35, 45, 55, 65, 75, 80, 81]
BRFSS_AGE_LABELS = ["18-24 years", "25-34 years", "35-44 years", "45-54 years", "55-64 years", "65-74 years", "75-79 years", "80+ years"]
BRFSS_EDUCATION = {1: "no high school", 2: "high school", 3: "some college", 4: "college graduate"}
BRFSS_INCOME = {1: "<$15k", 2: "$15–25k", 3: "$25–35k", 4: "$35–50k", 5: "$50–100k", 6: "$100k-200k", 7: ">$200k"}
# column: (source, codes for Yes, codes for No); other codes are NULL.
BRFSS_YES_NO = {
    "smoker": ("_SMOKER3", [1, 2], [3, 4]), "exercise_monthly": ("EXERANY2", [1], [2, 7, 9]),
    "poor_mental_health": ("_MENT14D", [2, 3], [1]), "diabetes": ("DIABETE4", [1, 2], [3, 4, 7, 9]),
    "high_bp": ("BPHIGH6", [1, 2], [3, 4]), "asthma": ("ASTHMA3", [1], [2, 4, 7, 9]),
    "cholesterol": ("TOLDHI3", [1], [2, 7, 9]), "heart_attack": ("CVDINFR4", [1], [2, 7, 9]),
    "stroke": ("CVDSTRK3", [1], [2, 7, 9]), "depression": ("ADDEPEV3", [1], [2, 7, 9]),
    "deaf": ("DEAF", [1], [2, 7, 9]), "blind": ("BLIND", [1], [2, 7, 9]),
}


def yes_no(source: str, yes: Sequence[int], no: Sequence[int]) -> Column:
    return recode_map(source, {**dict.fromkeys(yes, "Yes"), **dict.fromkeys(no, "No")})


def brfss(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    flags = {name: yes_no(*spec) for name, spec in BRFSS_YES_NO.items()}
    return raw.select(
        *keep, recode_map("_STATE", STATES).alias("state"), recode_map("_SEX", {1: "Male", 2: "Female"}).alias("sex"),
        recode_map("_IMPRACE", BRFSS_RACE).alias("race"), F.col("_AGE80").alias("age"),
        cut("_AGE80", BRFSS_AGE_EDGES, BRFSS_AGE_LABELS, right=False).alias("age_group"),
        recode_map("_EDUCAG", BRFSS_EDUCATION).alias("education"), recode_map("_INCOMG1", BRFSS_INCOME).alias("income"),
        flags.pop("smoker").alias("smoker"), (F.col("_BMI5") / 100.0).alias("bmi"),
        *[c.alias(name) for name, c in flags.items()], F.col("_LLCPWT").alias("weight"),
    )


# GSS code lists.
GSS_DEGREE = {0: "no high school", 1: "high school", 2: "junior college", 3: "bachelor", 4: "graduate"}
GSS_INCOME = {
    1: "<$10k", 2: "<$10k", 3: "<$10k", 4: "<$10k", 5: "<$10k", 6: "<$10k", 7: "<$10k", 8: "<$10k",
    9: "$10k-$30k", 10: "$10k-$30k", 11: "$10k-$30k", 12: "$10k-$30k", 13: "$10k-$30k", 14: "$10k-$30k", 15: "$10k-$30k",
    16: "$30k-$50k", 17: "$30k-$50k", 18: "$30k-$50k",
    19: "$50k-$75k", 20: "$50k-$75k",
    21: "$75k-$90k",
    22: "$90k-$130k", 23: "$90k-$130k",
    24: "$130k-$170k", 25: "$130k-$170k",
    26: "$170k+",
}
GSS_PARTY = {
    0: "democrat", 1: "democrat", 2: "democrat", 3: "independent", 4: "republican", 5: "republican", 6: "republican",
}


def gss(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return raw.dropna(subset=["wtssnrps"]).select(
        *keep, F.col("wtssnrps").cast("double").alias("wgh"), recode_map("sex", {1: "male", 2: "female"}).alias("sex"),
        F.col("age").cast("double").alias("age"), recode_map("race", {1: "white", 2: "black", 3: "other"}).alias("race"),
        recode_map("degree", GSS_DEGREE).alias("degree"), F.col("educ").cast("double").alias("edu"),
        recode_map("income16", GSS_INCOME).alias("house_income"),
        cut("polviews", [1, 3, 4, 7], ["liberal", "moderate", "conservative"]).alias("view"),
        recode_map("partyid", GSS_PARTY).alias("party"),
    )


# MEPS code lists. The visit bins put 0 and 1 in "0", 2 in "1", and so on.
MEPS_RACE = {1: "white", 2: "black", 3: "AIAN", 4: "asian", 6: "multiple"}
MEPS_MARITAL = {
    1: "married", 2: "widowed", 3: "divorced", 4: "separated", 5: "never married", 6: "inapplicable", 7: "married",
    8: "widowed", 9: "divorced", 10: "separated", -7: "refused", -1: "inapplicable",
}
MEPS_REGION = {-1: "inapplicable", 1: "northeast", 2: "midwest", 3: "south", 4: "west"}
MEPS_INSURED = {1: "yes", 2: "yes", 3: "no", 4: "yes", 5: "yes", 6: "yes", 7: "no", 8: "yes"}
MEPS_INSURE_TYPE = {1: "private", 2: "public", 3: "none", 4: "medicare", 5: "private", 6: "public", 7: "none", 8: "other"}
FIVE_YEAR_TOPS = [-1, 17, 24, 29, 34, 39, 44, 49, 54, 59, 64, 69, 74, 79, 84]
FIVE_YEAR_LABELS = [
    "<18", "18-24", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54", "55-59", "60-64", "65-69", "70-74", "75-79", "80-84",
]
VISIT_EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, INF]
VISIT_LABELS = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10+"]
EXPENDITURE_BREAKS = [200, 1000, 1500, 5000, 10000, 30000]


def visits(column: str) -> Column:
    return cut(column, VISIT_EDGES, VISIT_LABELS)


def meps(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    counted = {"office_visits": "OBTOTV22", "inpatient_visits": "IPDIS22", "dental_visits": "DVTOT22"}
    return raw.select(
        *keep, recode_map("SEX", {1: "male", 2: "female"}).alias("sex"), recode_map("RACEV1X", MEPS_RACE).alias("race"),
        recode_map("MARRY53X", MEPS_MARITAL).alias("marital"), recode_map("REGION53", MEPS_REGION).alias("region"),
        recode_map("INSURC22", MEPS_INSURED).alias("insured"), recode_map("INSURC22", MEPS_INSURE_TYPE).alias("insure_type"),
        F.col("AGE53X").alias("age"), F.col("EDUCYR").alias("education_years"), F.col("TOTEXP22").alias("expenditure"),
        F.col("OPTOTV22").alias("outpatient_visits"), *[F.col(c).alias(n) for n, c in counted.items()],
        F.col("PERWT22F").alias("weight"),
        cut("AGE53X", [*FIVE_YEAR_TOPS, INF], [*FIVE_YEAR_LABELS, "85+"], include_lowest=False).alias("age_group"),
        cut_breaks("TOTEXP22", EXPENDITURE_BREAKS, "US dollars").alias("expenditure_group"),
        *[visits(c).alias(f"{n}_group") for n, c in counted.items()],
    )


# NSDUH labels, in the order of the leading number of the source labels.
NSDUH_AGE = [
    "12–13 years", "14–15 years", "16–17 years", "18–20 years", "21–23 years", "24–25 years", "26–29 years",
    "30–34 years", "35–49 years", "50-64 years", "65+ years",
]
NSDUH_RACE = ["White", "Black", "Native American", "Pacific Islander", "Asian", "Multiple", "Hispanic"]
NSDUH_EDUCATION = [
    "≤ 8th grade",
    "≤ 8th grade",
    "≤ 8th grade",
    "≤ 8th grade",
    "Some high school",
    "Some high school",
    "Some high school",
    "High school graduate",
    "Some college, no degree",
    "Associate degree",
    "Bachelor’s or higher",
]
NSDUH_INCOME = [
    "< $10,000",
    "$10,000 - $19,999",
    "$20,000 - $29,999",
    "$30,000 - $39,999",
    "$40,000 - $49,999",
    "$50,000 - $74,999",
    "> $75,000",
]
NSDUH_DRUGS = {"alc": "alc", "cig": "cig", "mj": "mj", "coc": "coc", "her": "her"}


def leading_code(label: str) -> Column:
    """Number that a source label such as "4 - ..." starts with."""
    return F.regexp_extract(F.col(label).cast("string"), r"^(\d+) - ", 1).try_cast("int")


def nsduh(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The last-month columns read recency, of which code 1 is "within the past 30 days"."""
    return raw.select(
        *keep, ordinal_label(leading_code("AGE3"), NSDUH_AGE).alias("age"),
        recode_binary(leading_code("irsex"), 1, "male", "female").alias("sex"),
        ordinal_label(leading_code("NEWRACE2"), NSDUH_RACE).alias("race"),
        ordinal_label(leading_code("IREDUHIGHST2"), NSDUH_EDUCATION).alias("edu"),
        ordinal_label(leading_code("IRPINC3"), NSDUH_INCOME).alias("income"),
        *[recode_binary(leading_code(f"{d}ever"), 1, "yes", "no").alias(f"{d}_ever") for d in NSDUH_DRUGS],
        *[recode_binary(leading_code(f"{d}rec"), 1, "yes", "no").alias(f"{d}_monthly") for d in NSDUH_DRUGS],
        F.col("ANALWT2_C").alias("weight"),
    )


# SCF code lists and breaks.
SCF_RACE = {1: "White", 2: "Black", 3: "Hispanic", 4: "Asian", 5: "Other"}
SCF_EDUCATION = {1: "no high school", 2: "high school", 3: "some college", 4: "a college degree"}
SCF_BREAKS = {
    "food": [3500, 5500, 7000, 8500, 10000, 15000, 30000], "asset": [1e5, 3e5, 1e6, 3e6, 1e7, 1e8],
    "debt": [1000, 10000, 30000, 1e6, 3e6, 1e7], "networth": [1000, 10000, 30000, 1e6, 3e6, 1e7],
}


def scf(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    total = raw.withColumn("food", F.col("foodhome") + F.col("foodaway") + F.col("fooddelv"))
    bands = {f"{c}_group": cut_breaks(c, breaks, "US dollars") for c, breaks in SCF_BREAKS.items()}
    return total.select(
        *keep, "age", cut("age", [*FIVE_YEAR_TOPS, 89, INF], [*FIVE_YEAR_LABELS, "85-89", "90+"], include_lowest=False).alias("age_group"),
        recode_map("hhsex", {1: "Male", 2: "Female"}).alias("sex"), recode_map("racecl5", SCF_RACE).alias("race"),
        recode_map("edcl", SCF_EDUCATION).alias("education"), recode_map("married", {1: "yes", 2: "no"}).alias("married"),
        "kids", "food", bands["food_group"].alias("food_group"), recode_map("hhouses", {1: "yes", 0: "no"}).alias("house_own"),
        "income", "rent", "asset", bands["asset_group"].alias("asset_group"), "debt", bands["debt_group"].alias("debt_group"),
        "networth", bands["networth_group"].alias("networth_group"), F.col("wgt").alias("weight"),
    )


# NHANES concepts (name, table, column, recode); food rows are summed per person.
NHANES_CONCEPTS = [
    Concept("mec_wgh", "DEMO_L", "WTMEC2YR"),
    Concept("age", "DEMO_L", "RIDAGEYR"),
    Concept("sex", "DEMO_L", "RIAGENDR", "nhanes_sex"),
    Concept("race", "DEMO_L", "RIDRETH3", "nhanes_race"),
    Concept("diet_wgh", "DR1IFF_L", "WTDRD1"),
    Concept("height", "BMX_L", "BMXHT"),
    Concept("weight", "BMX_L", "BMXWT"),
    Concept("waist", "BMX_L", "BMXWAIST"),
    Concept("bmi", "BMX_L", "BMXBMI"),
    Concept("diastolic_bp", "BPXO_L", "BPXODI1"),
    Concept("systolic_bp", "BPXO_L", "BPXOSY1"),
    Concept("pulse", "BPXO_L", "BPXOPLS1"),
    Concept("cholesterol", "TCHOL_L", "LBXTC"),
    Concept("hdl", "HDL_L", "LBDHDD"),
    Concept("hb_a1c", "GHB_L", "LBXGH"),
    Concept("insulin", "INS_L", "LBXIN"),
    Concept("diabetes", "DIQ_L", "DIQ010", "nhanes_diab"),
    Concept("alcohol_weekly", "ALQ_L", "ALQ121", "nhanes_alcohol"),
    Concept("smoking", "SMQ_L", "SMQ040", "nhanes_smoke"),
    Concept("sleep_hours", "SLQ_L", "SLD012"),
    Concept("kidney_failure", "KIQ_U_L", "KIQ022", "nhanes_kidney"),
    Concept("kcal", "DR1IFF_L", "DR1IKCAL", total=True),
    Concept("protein", "DR1IFF_L", "DR1IPROT", total=True),
    Concept("carbs", "DR1IFF_L", "DR1ICARB", total=True),
    Concept("sugar", "DR1IFF_L", "DR1ISUGR", total=True),
    Concept("fat", "DR1IFF_L", "DR1ITFAT", total=True),
]
NHANES_BMI = ([-INF, 18.5, 25, 30, 35, 40, INF], ["underweight", "normal", "overweight", "class I obese", "class II obese", "class III obese"])
NHANES_AGE = ([-INF, 30, 40, 50, 60, 70, INF], ["18-30 years", "30-40 years", "40-50 years", "50-60 years", "60-70 years", "70+ years"])


def nhanes(tables: Mapping[str, DataFrame], key: str = "SEQN") -> DataFrame:
    """Adults with a positive examination weight, before and without imputation."""
    merged = select_concepts(tables, NHANES_CONCEPTS, key)
    kept = merged.where((F.col("mec_wgh") > 0) & (F.col("age") >= 18)).withColumn("diet_wgh", null_fill("diet_wgh", 0.0))
    return kept


def nhanes_labels(df: DataFrame) -> DataFrame:
    """Bins and yes/no answers; run it after imputation."""
    flags = {c: F.when(F.col(c).isNotNull(), F.when(F.col(c) == 1, "yes").otherwise("no"))
             for c in ("diabetes", "alcohol_weekly", "smoking", "kidney_failure")}
    return df.withColumns({"bmi_bin": cut("bmi", *NHANES_BMI), "age_group": cut("age", *NHANES_AGE), **flags})


def education(raw: DataFrame) -> DataFrame:
    """``raw`` is (title, men, women) as text; the weight is a percentage of the degree."""
    men, women = coerce_numeric("men", strip=","), coerce_numeric("women", strip=",")
    share = 100 * men / (men + women)
    wide = raw.select(F.trim(F.lower("title")).alias("degree"), share.alias("male"), (100 - share).alias("female"))
    return wide.unpivot(["degree"], ["male", "female"], "sex", "weight")


# Crime names.
CRIME_HEADINGS = ["all other offenses (except traffic)", "because of rounding, the percentages may not add to .."]
CRIME_LAST = "curfew and loitering law violations"
CRIME_NAMES = {
    "weapons; carrying, possessing, etc.": "carrying or possessing weapons", "other assaults": "assault",
    "larceny-theft": "theft", "stolen property; buying, receiving, possessing": "buying or receiving stolen property",
    "total": "a crime",
}
CRIME_RACES = ["White", "Black", "AIAN", "NHOPI", "Asian"]


def fbi_arrests(by_sex: DataFrame, by_race: DataFrame) -> DataFrame:
    """``by_sex`` is (row, offense, male, female in %), ``by_race`` (offense, counts by race).

    The sheet ends at the curfew row, so rows are cut there by their place in the sheet, before they
    are split into cells.
    """
    name = normalise_name("offense", drop=r"\d+")
    rows = keep_until(by_sex, "row", name == CRIME_LAST).join(by_race, "offense", "inner")
    shares = rows.withColumns({s: coerce_numeric(s) / 100 for s in ("male", "female")})
    cells = split_counts(shares.dropna(subset=["offense"]), "offense", ["male", "female"], CRIME_RACES)
    named = drop_headings(cells.withColumn("offense", name), "offense", CRIME_HEADINGS)
    renamed = F.coalesce(recode_map("offense", CRIME_NAMES), F.col("offense"))
    return named.select(renamed.alias("crime_type"), "sex", "race", "weight")


# Headings of the occupation table, and occupations to rename or (None) to drop.
LABOR_HEADINGS = [
    "Total, 16 years and over",
    "Management,  professional, and related occupations",
    "Management, business, and financial operations occupations",
    "Management occupations",
    "Business and financial operations occupations",
    "Professional and related occupations",
    "Computer and mathematical occupations",
    "Architecture and engineering occupations",
    "Life, physical, and social science occupations",
    "Community and social service occupations",
    "Legal occupations",
    "Education, training, and library occupations",
    "Arts, design, entertainment, sports, and media occupations",
    "Healthcare practitioners and technical occupations",
    "Health diagnosing and treating practitioners and other technical occupations",
    "Health technologists and technicians",
    "Service occupations",
    "Protective service occupations",
    "Food preparation and serving related occupations",
    "Building and grounds cleaning and maintenance occupations",
    "Personal care and service occupations",
    "Sales and related occupations",
    "Office and administrative support occupations",
    "Farming, fishing, and forestry occupations",
    "Construction and extraction occupations",
    "Installation, maintenance, and repair occupations",
    "Production occupations",
    "Transportation and material moving occupations",
    "Military specific occupations",
    "Unemployed, last worked 5 years ago or earlier",
    "Unemployed, never worked",
    "Not in labor force",
]
LABOR_RENAMES = {
    "other drafters": None,
    "other designers": None,
    "other psychologists": None,
    "other healthcare practitioners and technical occupations": None,
    "other teachers and instructors": None,
    "other woodworkers": None,
    "other textile, apparel, and furnishings workers": None,
    "directors, religious activities and education": "religious program director",
    "agents and business managers of artists, performers, and athletes": "business manager for artists and athletes",
    "disc jockeys, except radio": "event disc jockey",
    "sailors and marine oilers": "maritime crew member",
    "credit examiners and collectors, and revenue agents": "credit examiner or collector",
    "speechlanguage pathologists": "speech-language pathologist",
    "helpersinstallation, maintenance, and repair workers": "installation, maintenance and repair helper",
    "doortodoor sales workers, news and street vendors, and related workers": "door-to-door sales worker or street vendor",
    "other community and social service specialists": None,
    "other educational instruction and library workers": None,
    "other protective service workers": None,
    "bus drivers, transit and intercity": "transit and intercity bus driver",
    "other entertainment attendants and related workers": None,
    "other production workers": None,
    "other material moving workers": None,
    "packer and packagers, hand": "hand packager",
}


def labor(raw: DataFrame, headings: Sequence[str] = LABOR_HEADINGS, renames: Mapping[str, str | None] = LABOR_RENAMES) -> DataFrame:
    """``raw`` is (occupation, total, female, white, black, asian), shares in %, dashes for none.

    ``headings`` are the group rows to leave out, ``renames`` the occupations to rename or drop.
    """
    kept = drop_headings(raw.dropna(subset=["occupation"]), "occupation", headings, r"\ball other\b")
    name = normalise_name("occupation", drop=r"[\d\-]+", renames=renames)
    named = kept.withColumn("occupation", name).dropna(subset=["occupation"])  # before each row becomes eight
    numbers = {c: coerce_numeric(sentinel_to_null(F.col(c).cast("string"), "-", "–")) for c in ("total", "female", "white", "black", "asian")}
    parsed = named.withColumns(numbers)
    shares = parsed.withColumns({
        "other": 100 - F.col("white") - F.col("black") - F.col("asian"), "female": F.col("female") / 100,
    }).withColumn("male", 1 - F.col("female"))
    races = ["white", "black", "asian", "other"]
    counted = shares.withColumns({r: F.col(r) * F.col("total") / 100 for r in races})
    return split_counts(counted, "occupation", ["female", "male"], races).dropna()


def complete(df: DataFrame, ids: Sequence[str], *, without: Sequence[str] = (), spread: int = 3, rounds: int = 5, seed: int = 0) -> DataFrame:
    """Clean table with its gaps imputed, each column from ``spread`` others; ``without`` stays as it is.

    Each column leans on the ``spread`` columns after it: many predictors would leave cells without respondents,
    whose draws then follow the whole table.
    """
    columns = [c for c in df.columns if c not in ids and c not in without]
    predictors = {
        c: [columns[(i + step) % len(columns)] for step in range(1, min(spread, len(columns) - 1) + 1)]
        for i, c in enumerate(columns)
    }
    return impute_chained(df, predictors, ids, rounds=rounds, seed=seed)
