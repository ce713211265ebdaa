"""Table builders and the task catalog on a few raw rows."""

from collections import Counter

import pytest

from popgauge.plans import builds as B
from popgauge.plans import catalog as C
from popgauge.sources import header_rows


def one(df):
    return df.first().asDict()


def test_catalog_counts():
    low, high = C.low_dim_tasks(), C.high_dim_tasks()
    assert Counter(t.dataset for t in low) == {
        "acs": 12, "brfss": 9, "edu": 1, "fbi_arrests": 2, "gss": 10, "labor": 2, "meps": 10, "nhanes": 4, "nsduh": 10, "scf": 15}
    assert Counter(t.dataset for t in high) == {"brfss": 39, "nsduh": 33, "meps": 11, "scf": 11}
    assert all(t.prompt.count("{}") == 1 and t.prompt_prob.count("{}") == 2 for t in low)
    assert {t.weight for t in low if t.dataset in ("gss", "nhanes")} == {"wgh", "mec_wgh"}
    assert all(2 <= t.dim <= 5 and len(set(t.conditions)) == t.dim for t in high)


def test_acs(spark):
    columns = "PWGTP SEX AGEP RAC1P HISP NATIVITY CIT MAR NPF NOC ENG SCHL WAGP WKHP ESR COW OCCP INDP POWSP state".split()
    codes = "12 2 40 6 02 1 1 5 3 N 1 21 75000 40 4 3 0010 0169 040 06".split()
    raw = spark.createDataFrame([codes], ", ".join(f"{c} string" for c in columns))
    occ = spark.createDataFrame([(1, "0010", "old", "A"), (2, " 0010 ", "managers", "B")], "row int, code string, name string, group string")
    ind = spark.createDataFrame([(1, "0170", "crops", "AGR")], "row int, code string, name string, group string")
    row = one(B.acs(raw, occ, ind))
    assert (row["sex"], row["race"], row["hispanic_origin"], row["education"]) == ("female", "asian", "yes", "Bachelor's degree")
    assert (row["salary_group"], row["employment_status"], row["employer"]) == ("50001–75000 $", "employed", "government")
    assert (row["occp_name"], row["occp_code"], row["ind_name"]) == ("managers", "B", "")
    assert row["economic_region"] == "Rocky Mountain" and row["children"] is None and row["weight"] == 12
    assert list(row)[-1] == "weight" and len(row) == 25


def test_brfss(spark):
    sources = [s for s, _, _ in B.BRFSS_YES_NO.values()]
    names = ["_STATE", "_SEX", "_IMPRACE", "_AGE80", "_EDUCAG", "_INCOMG1", "_BMI5", "_LLCPWT", *sources]
    raw = spark.createDataFrame([[6.0, 2.0, 5.0, 80.0, 9.0, 7.0, 2550.0, 1.5] + [2.0] * len(sources)], ", ".join(f"{c} double" for c in names))
    row = one(B.brfss(raw))
    assert (row["state"], row["age_group"], row["education"], row["income"], row["bmi"]) == ("California", "80+ years", None, ">$200k", 25.5)
    assert (row["smoker"], row["poor_mental_health"], row["diabetes"], row["asthma"]) == ("Yes", "Yes", "Yes", "No")


def test_gss(spark):
    raw = spark.createDataFrame(
        [(1.0, 30.0, 3.0, 16.0, 4.0, 21.0, 4.0, 7.0, 1.1), (1.0, 30.0, 3.0, 16.0, 4.0, 21.0, 4.0, 7.0, None)],
        "sex double, age double, race double, educ double, degree double, income16 double, polviews double, partyid double, wtssnrps double")
    out = B.gss(raw)
    assert out.count() == 1
    row = one(out)
    assert (row["race"], row["degree"], row["house_income"], row["view"], row["party"]) == ("other", "graduate", "$75k-$90k", "moderate", None)


def test_meps_visit_bins_and_ages(spark):
    names = "SEX RACEV1X MARRY53X REGION53 INSURC22 AGE53X EDUCYR TOTEXP22 OPTOTV22 OBTOTV22 IPDIS22 DVTOT22 PERWT22F".split()
    raw = spark.createDataFrame([[1, 6, 7, 3, 7, 85, 12, 200, 0, 0, 2, 11, 9], [2, 1, -7, -1, 1, -1, 12, 30001, 0, 1, 10, 0, 9]], ", ".join(f"{c} int" for c in names))
    first, second = B.meps(raw).collect()
    assert (first.race, first.marital, first.insured, first.age_group, first.expenditure_group) == ("multiple", "married", "no", "85+", "< 200 US dollars")
    assert (first.office_visits_group, first.inpatient_visits_group, first.dental_visits_group) == ("0", "1", "10+")
    assert (second.age_group, second.office_visits_group, second.inpatient_visits_group, second.expenditure_group) == (None, "0", "9", "30001+ US dollars")


def test_nsduh(spark):
    names = ["AGE3", "irsex", "NEWRACE2", "IREDUHIGHST2", "IRPINC3", "ANALWT2_C", *[f"{d}ever" for d in B.NSDUH_DRUGS], *[f"{d}rec" for d in B.NSDUH_DRUGS]]
    raw = spark.createDataFrame([["9 - x", "2 - Female", "7 - Hispanic", "7 - y", "7 - $75,000 or more", "3.5", *["1 - Yes"] * 5, *["2 - More than 30 days"] * 5]], ", ".join(f"{c} string" for c in names))
    row = one(B.nsduh(raw))
    assert (row["age"], row["sex"], row["race"], row["edu"], row["income"]) == ("35–49 years", "female", "Hispanic", "Some high school", "> $75,000")
    assert row["coc_ever"] == "yes" and row["coc_monthly"] == "no"


def test_scf(spark):
    raw = spark.createDataFrame([(89, 1, 3, 4, 1, 2, 1000., 2000., 600., 1, 5., 6., 250000., 1000., 2e7, 7.)],
        "age int, hhsex int, racecl5 int, edcl int, married int, kids int, foodhome double, foodaway double, fooddelv double, hhouses int, income double, rent double, asset double, debt double, networth double, wgt double")
    row = one(B.scf(raw))
    assert (row["age_group"], row["food"], row["food_group"], row["house_own"]) == ("85-89", 3600.0, "3501–5500 US dollars", "yes")
    assert row["debt_group"] == "< 1000 US dollars" and row["asset_group"] == "100001.0–300000.0 US dollars"


def test_nhanes(spark):
    plain = {}
    for concept in B.NHANES_CONCEPTS:
        plain.setdefault(concept.table, {})[concept.column] = 2.0
    plain["DEMO_L"].update(RIDAGEYR=45.0, RIDRETH3=6.0, RIAGENDR=1.0)
    plain["BMX_L"]["BMXBMI"] = 30.0
    tables = {t: spark.createDataFrame([[1.0, *c.values()]], ", ".join(f"{n} double" for n in ["SEQN", *c])) for t, c in plain.items()}
    food = tables["DR1IFF_L"]
    tables["DR1IFF_L"] = food.unionAll(food)
    row = one(B.nhanes_labels(B.nhanes(tables)))
    assert (row["sex"], row["race"], row["kcal"], row["diet_wgh"]) == ("Male", "Asian", 4.0, 2.0)
    assert (row["bmi_bin"], row["age_group"], row["diabetes"], row["alcohol_weekly"], row["smoking"]) == ("overweight", "40-50 years", "no", "yes", "no")


def test_education_and_labor(spark):
    edu = B.education(spark.createDataFrame([(" Biology ", "1,000", "3,000")], "title string, men string, women string"))
    assert {r.sex: (r.degree, r.weight) for r in edu.collect()} == {"male": ("biology", 25.0), "female": ("biology", 75.0)}
    raw = spark.createDataFrame([("Pilots 2-a", "100", "10", "80", "10", "5"), ("Service occupations", "1", "1", "1", "1", "1"), ("All other cooks", "1", "1", "1", "1", "1"), ("Divers", "50", "–", "1", "1", "1")],
        "occupation string, total string, female string, white string, black string, asian string")
    out = B.labor(raw, ["Service occupations"], {"pilots a": "pilot"}).collect()
    assert {r.occupation for r in out} == {"pilot"} and len(out) == 8
    assert sum(r.weight for r in out) == pytest.approx(100)


def test_fbi(spark):
    sexes = spark.createDataFrame([(1, "Total1", "70", "30"), (2, "Larceny-theft", "60", "40"), (3, "Curfew and loitering law violations", "50", "50"), (4, "Notes", "1", "1")],
        "row int, offense string, male string, female string")
    races = spark.createDataFrame([(o, 100., 50., 5., 5., 10.) for o in ("Total1", "Larceny-theft", "Curfew and loitering law violations", "Notes")],
        "offense string, White double, Black double, AIAN double, NHOPI double, Asian double")
    out = B.fbi_arrests(sexes, races).collect()
    assert {r.crime_type for r in out} == {"a crime", "theft", "curfew and loitering law violations"}
    assert len(out) == 30 and [r.weight for r in out if (r.crime_type, r.sex, r.race) == ("a crime", "male", "White")] == [70.0]


def test_header_rows_follow_the_header(spark):
    df = spark.createDataFrame([('[["B","A"],["1","x"],["2",null]]',)], "doc string")
    assert sorted(map(tuple, header_rows(df, "doc", ["A", "B", "C"]).collect()), key=str) == sorted([("x", "1", None), (None, "2", None)], key=str)
