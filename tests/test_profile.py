"""Column profiles of every type."""

from tidemark.operators import profile as P

TYPED = """SELECT CAST(i AS INT) AS n, i % 2 = 0 AS b, date_add(DATE'2024-01-01', CAST(i % 3 AS INT)) AS d, TIMESTAMP'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, i % 2) AS ts,
    slice(array('x', 'y', 'z'), 1, CAST(i % 4 AS INT)) AS l, map('k', i) AS m, named_struct('a', i % 2) AS s, CAST('q' AS BINARY) AS y, CAST(NULL AS STRING) AS gone,
    CASE WHEN i > 5 THEN array(1) END AS some, CAST(i AS DECIMAL(10, 2)) AS `odd name` FROM range(10) AS t(i)"""


def test_every_type_is_described(spark):
    df = spark.sql(TYPED)
    rows = {r["column"]: r for r in P.column_profile(df).collect()}
    assert set(rows) == set(df.columns) and len(rows) == len(df.columns)
    text = lambda c: (rows[c]["count"], rows[c]["missing"], rows[c]["distinct"], rows[c]["top"], rows[c]["freq"])
    assert text("b") == (10, 0, 2, "false", 5)  # ties go to the smallest text
    assert text("d") == (10, 0, 3, "2024-01-01", 4)
    assert text("ts") == (10, 0, 2, "2024-01-01 10:00:00.000000", 5)
    assert text("s") == (10, 0, 2, '{"a":0}', 5)
    assert text("y") == (10, 0, 1, "71", 10)
    assert text("gone") == (0, 10, 0, None, None)
    number = lambda c: (rows[c]["count"], rows[c]["missing"], rows[c]["min"], rows[c]["p50"], rows[c]["max"])
    assert number("n") == (10, 0, 0.0, 4.5, 9.0) and rows["n"]["mean"] == 4.5
    assert number("l") == (10, 0, 0.0, 1.0, 3.0)   # lengths
    assert number("m") == (10, 0, 1.0, 1.0, 1.0) and rows["m"]["skew"] is None
    assert number("some") == (4, 6, 1.0, 1.0, 1.0)
    assert number("odd name") == (10, 0, 0.0, 4.5, 9.0)
    assert rows["l"]["datatype"] == "array<string>" and rows["odd name"]["datatype"] == "decimal(10,2)"


def test_dictionary_of_relations_with_like_named_columns_and_an_empty_one(spark):
    full, empty = spark.sql("SELECT 1 AS a, 'x' AS t"), spark.createDataFrame([], "a int, t string, value string, relation boolean")
    rows = {(r["relation"], r["column"]): r for r in P.snapshot_dictionary({"full": full, "empty": empty}).collect()}
    assert set(rows) == {("full", "a"), ("full", "t"), ("empty", "a"), ("empty", "t"), ("empty", "value"), ("empty", "relation")}
    assert rows["full", "t"]["top"] == "x" and rows["full", "a"]["mean"] == 1.0
    for c in ("t", "value", "relation"):
        assert (rows["empty", c]["count"], rows["empty", c]["missing"], rows["empty", c]["top"]) == (0, 0, None)
    assert (rows["empty", "a"]["count"], rows["empty", "a"]["missing"], rows["empty", "a"]["p50"]) == (0, 0, None)
