import pytest

from tidemark.operators import labels as L

CODES = "abcdefgh"


def frame(spark, rows):
    """rows: (id, age, raised, {code: value}, closed, acquired, ipo)."""
    data = [(i, age, raised, *[codes.get(c) for c in CODES], cl, ac, ip) for i, age, raised, codes, cl, ac, ip in rows]
    f = L.FEATURE_COLUMNS
    schema = (f"keys_company_id int, {f.age_days} int, {f.raised} double, " + ", ".join(f"{f.code_prefix}{c} int" for c in CODES)
              + f", {f.closed} int, {f.acquired} int, {f.ipo} int")
    return spark.createDataFrame(data, schema)


def stages(df, **kw):
    out = L.add_stages(df, [L.FEATURE_COLUMNS], **kw).collect()
    return {r["keys_company_id"]: (r["keys_company_stage_pre"], r["keys_company_stage"], r["keys_company_stage_number"], r["keys_company_stage_group"]) for r in out}


def test_ladder(spark):
    got = stages(frame(spark, [
        (1, 900, 1.0, {"d": 1}, 0, 0, 0), (2, 900, 1.0, {"h": 1, "a": 1}, 0, 0, 0), (3, 900, 1.0, {"c": 1}, 0, 0, 0),
        (4, 900, 1.0, {"b": 1, "a": 1}, 0, 0, 0), (5, 900, 1.0, {"a": 1}, 0, 0, 0),
        (6, 100, 0.0, {}, 0, 0, 0), (7, 200, 5.0, {"a": 0}, 0, 0, 0),   # raised nothing is Seed
        (8, 150, None, {}, 0, 0, 0), (9, 500, None, {}, 0, 0, 0),       # never reported: by age
        (10, 900, 1.0, {"a": 1}, 1, 1, 1), (11, 900, 1.0, {"a": 1}, 0, 1, 1), (12, 900, 1.0, {"a": 1}, 0, 0, 1)]))
    assert [got[i][0] for i in range(1, 10)] == [
        "Series D+", "Series D+", "Series C", "Series B", "Series A", "Seed", "Seed", "Pre-Seed", "Other"]
    assert got[10] == ("Series A", "Closed", -1, "Excluded")
    assert got[11] == ("Series A", "Acquired", 8, "Excluded")
    assert got[12] == ("Series A", "IPO", 7, "Excluded")
    assert got[9][2:] == (None, "Excluded") and got[8][2:] == (1, "Included")


def test_cutoff_quantile_is_a_parameter(spark):
    df = frame(spark, [(i, 100 * i, 1.0, {}, 0, 0, 0) for i in range(1, 5)] + [(9, 340, None, {}, 0, 0, 0)])
    assert stages(df)[9][0] == "Other"               # 75 % of 100 … 400 is 325
    assert stages(df, seed_age_q=0.9)[9][0] == "Pre-Seed"
    fitted = L.fit_cutoffs(df, [L.FEATURE_COLUMNS], seed_age_q=1.0)
    assert stages(df, cutoffs=fitted)[9][0] == "Pre-Seed"


def test_labels(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 3, 4, 4, 0, 0, 0), (2, 3, -1, 4, 0, 0, 0), (3, CAST(NULL AS INT), 4, 4, CAST(NULL AS INT), 1, 0), (4, 7, 8, 3, 1, 1, 0)
        AS t(id, keys_company_stage_number, outcome_stage_number, outcome_stage_pre_number, outcome_exit_bool, outcome_acquired_bool, outcome_ipo_bool)""")
    got = {r[0]: tuple(r)[1:] for r in df.select("id", *[L.label(k) for k in L.LABEL_TYPES]).collect()}
    assert got == {1: (1, 1, 0, 0, 0), 2: (0, 1, 0, 0, 0), 3: (0, 0, 0, 1, 0), 4: (1, 0, 1, 1, 0)}
    with pytest.raises(ValueError):
        L.label("Nothing")


def test_split(spark):
    df = spark.sql("""SELECT 'x' AS name, 1.5D AS confidence_context_age_number, 2 AS keys_company_stage_number, 3 AS outcome_stage_number, 'Seed' AS keys_company_stage""")
    rows, features = L.split_features(df, stage="Seed")
    assert features == ["confidence_context_age_number"] and rows.head()["label"] == 1
    assert L.split_features(df, stage="Series A")[0].count() == 0


def sliced(spark, rows):
    """rows: (slice, id, age, raised)."""
    f = L.FEATURE_COLUMNS
    schema = (f"slice int, keys_company_id int, {f.age_days} int, {f.raised} double, " + ", ".join(f"{f.code_prefix}{c} int" for c in CODES)
              + f", {f.closed} int, {f.acquired} int, {f.ipo} int")
    return spark.createDataFrame([(s, i, age, raised, *[None] * 8, 0, 0, 0) for s, i, age, raised in rows], schema)


def test_later_slices_take_the_cutoffs_of_their_training_slice(spark):
    train = sliced(spark, [(1, i, 100 * i, 1.0) for i in range(1, 5)] + [(2, i, 1000 * i, 1.0) for i in range(1, 5)])
    cut = L.fit_cutoffs(train, [L.FEATURE_COLUMNS], ["slice"])  # 325 and 3250 days
    test = sliced(spark, [(11, 1, 300, None), (11, 2, 400, None), (12, 3, 400, None), (12, 4, 4000, None), (13, 5, 1, None), (11, 6, 1, 1.0), (None, 7, 1, None)])
    got = L.add_stages(test, [L.FEATURE_COLUMNS], ["slice"], cut, at=["slice - 10"])
    # Slice 3 was not fitted and a NULL slice is none: without cut-offs no age is young.
    assert {r["keys_company_id"]: r["keys_company_stage"] for r in got.collect()} == {
        1: "Pre-Seed", 2: "Other", 3: "Pre-Seed", 4: "Other", 5: "Other", 6: "Seed", 7: "Other"}
    assert "__cut" not in got.columns
    with pytest.raises(ValueError):
        L.attach_cutoffs(test, cut, ["slice"], ["slice", "slice"])


def test_cutoffs_of_no_rows(spark):
    none = sliced(spark, [])
    test = sliced(spark, [(1, 1, 300, None)])
    assert L.add_stages(test, [L.FEATURE_COLUMNS], ["slice"], L.fit_cutoffs(none, [L.FEATURE_COLUMNS], ["slice"])).head()["keys_company_stage"] == "Other"
    assert L.add_stages(none, [L.FEATURE_COLUMNS], ["slice"]).count() == 0


def test_rows_are_not_shuffled_on_slices(spark):
    """The only exchanges carry cut-offs; both stay as small as the number of slices."""
    test = sliced(spark, [(1, 1, 300, None), (2, 2, 5, 1.0)]).repartition(3)
    staged = L.add_stages(test, [L.FEATURE_COLUMNS], ["slice"], L.fit_cutoffs(sliced(spark, [(1, 1, 9, 1.0)]), [L.FEATURE_COLUMNS], ["slice"]))
    plan = staged._jdf.queryExecution().executedPlan().toString()
    rows, fitted = plan.split("Subquery", 1)
    assert "hashpartitioning(slice" not in rows and "Join" not in plan
