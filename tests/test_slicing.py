from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import slicing as S
from tidemark.operators.flatten import Measure, Relation, flatten_entities
from tidemark.plans import base as B
from tidemark.sources.bindings import FEATURE_DATE, Tables


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_strictly_before_and_nulls_dropped(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2000-01-01'), (2, DATE'1999-12-31'), (3, CAST(NULL AS DATE)) AS t(id, created_at)")
    out = S.slice_asof(df, date(2000, 1, 1))
    assert ids(out) == [2]
    assert out.head()["slice_date"] == date(2000, 1, 1)


@pytest.mark.parametrize("column", ["started_on", "patent_date"])
def test_other_date_columns(spark, column):
    df = spark.sql(f"SELECT * FROM VALUES (1, DATE'2001-01-01'), (2, DATE'1999-01-01') AS t(id, {column})")
    assert ids(S.slice_asof(df, date(2000, 1, 1))) == [2]


def test_undated_relation_is_kept_and_named_column_wins(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2001-01-01'), (2, DATE'1999-01-01') AS t(id, updated_at)")
    assert ids(S.slice_asof(df, date(2000, 1, 1))) == [1, 2]
    assert ids(S.slice_asof(df, date(2000, 1, 1), by="updated_at")) == [2]
    with pytest.raises(ValueError):
        S.slice_asof(df, date(2000, 1, 1), by="nothing")


def test_filter_reaches_the_scan(spark):
    df = S.slice_asof(Tables(spark, "/root/testdata/sf0.001").rounds(), FEATURE_DATE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in plan


def test_generated_slices(spark):
    rows = S.forecast_slices(spark, date(2012, 1, 1), date(2016, 1, 1), [1, 2], 5, seed=3).collect()
    assert len(rows) == 10
    for r in rows:
        assert (r["label_date"] - r["feature_date"]).days == 364 * r["window_years"]
        assert date(2012, 1, 1) <= r["feature_date"] and r["label_date"] <= date(2016, 1, 1)
    again = S.forecast_slices(spark, date(2012, 1, 1), date(2016, 1, 1), [1, 2], 5, seed=3).collect()
    assert rows == again
    assert S.explicit_slices(spark, [(date(2012, 1, 1), date(2014, 1, 1))]).count() == 1
    assert S.test_feature_date(date(2017, 4, 4), date(2012, 1, 1), date(2012, 12, 31)) == date(2016, 4, 4)


def test_window_label(spark):
    row = spark.range(1).select(S.window_label(F.lit(date(1996, 6, 1)), F.lit(date(1998, 5, 30)))).head()
    assert row[0] == "2 Years"


def test_asof_lookup_by_key(spark):
    left = spark.sql("SELECT * FROM VALUES ('a', DATE'2000-01-05'), ('a', DATE'1999-12-01'), ('b', DATE'2000-03-01') AS t(k, day)")
    right = spark.sql("SELECT * FROM VALUES ('a', DATE'2000-01-01', 1), ('a', DATE'2000-01-06', 2), ('b', DATE'2000-02-01', 9) AS t(k, on, v)")
    got = {(r["k"], r["day"]): r["v"] for r in S.asof_lookup(left, right, "day", "on", "v", ["k"]).collect()}
    assert got == {("a", date(2000, 1, 5)): 1, ("a", date(1999, 12, 1)): None, ("b", date(2000, 3, 1)): 9}


def test_asof_lookup_with_two_values_on_a_day(spark):
    left = spark.sql("SELECT * FROM VALUES (DATE'2000-01-01'), (DATE'2000-01-02'), (DATE'2000-01-03') AS t(day)")
    right = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2000-01-02 15:00:00', 11), (TIMESTAMP'2000-01-02 09:00:00', 10), (NULL, 7) AS t(on, v)")
    got = [tuple(r) for r in S.asof_lookup(left, right, "day", "on", "v").orderBy("day").collect()]
    assert got == [(date(2000, 1, 1), None), (date(2000, 1, 2), 11), (date(2000, 1, 3), 11)]


def test_future_rows_change_no_feature(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rounds = t.rounds()
    spine = t.orgs().select("org_id")
    measures = B.round_relation(t).measures

    def features(frame):
        rel = Relation(frame, "org_id", "created_at", measures, ("rounds",))
        return sorted(flatten_entities(spine, "org_id", [rel], {"": FEATURE_DATE}).collect(), key=str)

    later = rounds.where(F.col("created_at") < F.lit("1995-06-01")).withColumn("created_at", F.lit("2005-01-01").cast("timestamp_ntz"))
    assert features(rounds) == features(rounds.unionByName(later))


def test_measures(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, DATE'2000-01-01', 'a', 5.0D), (1, DATE'2000-02-01', CAST(NULL AS STRING), CAST(NULL AS DOUBLE)),
        (2, DATE'2000-01-01', 'b', 1.0D), (3, DATE'2009-01-01', 'a', 2.0D), (4, DATE'2000-01-01', NULL, 7.0D) AS t(e, created_at, code, usd)""")
    rel = Relation(df, "e", "created_at", {"n": Measure("count"), "usd": Measure("sum", "usd"), "a": Measure("flag", "code = 'a'")}, ("n",))
    spine = spark.range(1, 5).withColumnRenamed("id", "e")
    got = {r["e"]: (r["n"], r["usd"], r["a"]) for r in flatten_entities(spine, "e", [rel], {"": date(2001, 1, 1)}).collect()}
    assert got == {1: (2, 5.0, 1), 2: (1, 1.0, 0), 3: (0, None, None), 4: (1, 7.0, None)}
