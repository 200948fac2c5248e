from pyspark.sql import functions as F

from tidemark.functions import letters
from tidemark.functions import text as X
from tidemark.naming import cleaning_of, factor_of, plain_name
from tidemark.operators import encode as E
from tidemark.operators import relate as R


def test_naming():
    assert cleaning_of("a_b_c_codes_list") == "codes" and cleaning_of("x_list") == "top_list"
    assert cleaning_of("x_date_pair") == "pair_dates" and cleaning_of("x_pair") == "pair_sum"
    assert cleaning_of("keys_x") == "keep" and cleaning_of("remark") == "drop"
    assert factor_of("confidence_context_economy_age_number") == "economy"
    assert plain_name(" Médias sociaux ") == "Medias-sociaux"


def test_list_null_and_empty(spark):
    df = spark.createDataFrame([(1, "A;b"), (2, ""), (3, None), (4, "z")], "id int, l string")
    got = {r["id"]: (r["l_a"], r["l_b"]) for r in E.with_parsed(df, ["l"]).selectExpr("id", *E.list_dummies_sql("l", ["a", "b"])).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (None, None), 4: (0, 0)}


def test_top_vocabulary_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b;a"), (2, "a;c"), (3, "c;b"), (4, "d")], "id int, l string")
    assert E.fit_vocabulary(df, "l", 2) == ["a", "b"]
    got = {r["id"]: (r["l_a"], r["l_b"]) for r in E.with_parsed(df, ["l"]).selectExpr("id", *E.top_dummies_sql("l", ["a", "b"])).collect()}
    assert got[4] == (None, None) and got[3] == (0, 1)
    assert {r["token"] for r in E.vocabulary(df, "l", exclude="a|b").collect()} == {"c", "d"}
    assert {r["token"] for r in E.vocabulary(df, "l", include="[ab]").collect()} == {"a", "b"}


def test_fixed_vocabulary_has_null_columns(spark):
    df = spark.createDataFrame([(1, "a;zz"), (2, None)], "id int, l string")
    rows = {r["id"]: r for r in E.with_parsed(df, ["l"]).selectExpr("id", *E.fixed_dummies_sql(df, "l", ["a", "b"])).collect()}
    assert (rows[1]["l_a"], rows[1]["l_b"], rows[2]["l_a"]) == (1, None, None)


def test_pairs(spark):
    df = spark.createDataFrame([(1, "a 1;a 2.5;b x;c"), (2, None)], "id int, m_pair string")
    got = {r["id"]: tuple(r)[1:] for r in E.with_parsed(df, pairs=["m_pair"]).selectExpr("id", *E.pair_sums_sql("m_pair", ["a", "b", "c"])).collect()}
    assert got == {1: (3.5, None, None), 2: (None, None, None)}
    dates = spark.createDataFrame([(1, "a 9;a 3;a 5")], "id int, d_date_pair string")
    row = E.with_parsed(dates, pairs=["d_date_pair"]).selectExpr(
        *E.pair_dates_sql("d_date_pair", ["a"], 4), *E.pair_dates_sql("d_date_pair", ["a"], 1, last=True)).head()
    assert tuple(row) == (3, 5, 9, None, 5)


def test_clean_takes_pair_keys_and_occurrences_from_rows(spark):
    df = spark.createDataFrame([(1, "a 1;q 4", "s 3;s 1;s 2"), (2, None, "t 5")], "keys_id int, m_pair string, d_date_pair string")
    out = E.clean_features(df, {"m_pair": ("z",)}).orderBy("keys_id")
    assert out.columns == ["keys_id", "m_pair_z_pair", "m_pair_a_pair", "m_pair_q_pair", *[f"d_date_pair_s_{i}_pair" for i in range(3)], "d_date_pair_t_0_pair"]
    assert [tuple(r) for r in out.collect()] == [(1, None, 1.0, 4.0, 1, 2, 3, None), (2, None, None, None, None, None, None, 5)]


def test_bins_of_a_constant_column(spark):
    for value in (5.0, 0.0, -2.0):
        rows = E.equal_width_bins(spark.range(4).selectExpr(f"{value}D AS x"), "x", 3).collect()
        assert [r["n"] for r in rows] == [4] and rows[0]["bin_from"] < value < rows[0]["bin_to"]


def test_fold_spelt_apart_and_extended(spark):
    row = spark.createDataFrame([("Cafe\u0301 \u1e02ar",)], "a string").select(X.ascii_fold(F.col("a"))).head()
    assert row[0] == "Cafe Bar"


def test_feature_matrix_fills_empty_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None, "x")], "keys_id int, b_number double, a_number double, c string")
    out = E.feature_matrix(df)
    assert out.columns == ["a_number", "b_number"] and tuple(out.head()) == (0.0, 2.0)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, None)], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in R.latest_per_key(df, ["k"], ["at"]).collect()} == {"k": "new", "j": None}


def test_all_are_pending_for_an_empty_store(spark):
    df = spark.createDataFrame([("a-1", "2016-01-01 00:00:00")], "id string, updated_at string")
    empty = spark.createDataFrame([], "sid string, at bigint")
    assert R.stale_or_missing(df, empty, "id", "updated_at", "sid", "at").count() == 1
    stored = spark.createDataFrame([("a1", 1_500_000_000)], "sid string, at bigint")
    assert R.stale_or_missing(df, stored, "id", "updated_at", "sid", "at").count() == 0


def test_names(spark):
    df = spark.createDataFrame([(" Société Générale S.A.",), ("ACME, Inc.",), ("Co",), ("Straße GmbH",), ("",)], "n string")
    got = [r[0] for r in df.select(X.standardize_name(F.col("n"))).collect()]
    assert got == ["societe generale sa", "acme", "co", "strasse", ""]
    assert spark.range(1).select(X.ascii_fold_any(F.lit("ｆｕｌｌ Ñ"))).head()[0] == "full N"


def test_levenshtein_edges(spark):
    row = spark.sql("SELECT '' AS a, '' AS b, CAST(NULL AS STRING) AS c, 'abcd' AS d, 'abce' AS e").select(
        X.normalized_levenshtein(F.col("a"), F.col("b")), X.normalized_levenshtein(F.col("a"), F.col("c")), X.normalized_levenshtein(F.col("d"), F.col("e"))).head()
    assert tuple(row) == (0.0, None, 0.25)
    assert spark.sql("SELECT 'a' AS a, CAST(NULL AS STRING) AS b").select(R.names_similar(F.col("a"), F.col("b"))).head()[0] is False


def test_fuzzy_match_equals_all_pairs(spark):
    words = ["international", "internationale", "alpha", "global"]
    tails = ["", " x", " xy", " xyz", " group", " groups", " holding"]
    left = spark.createDataFrame([(w + s,) for w in words for s in tails], "a string")
    right = spark.createDataFrame([(w + s,) for w in words for s in tails[::-1]] + [("other",), ("???",)], "b string")
    assert R.fuzzy_match(spark.createDataFrame([("!!!",)], "a string"), right, "a", "b").collect() == [("", "")]
    right = right.where("b <> '???'")
    got = {tuple(r) for r in R.fuzzy_match(left, right, "a", "b").collect()}
    pairs = left.crossJoin(right).where(X.first_token(F.col("a")) == X.first_token(F.col("b"))).where(R.names_similar(F.col("a"), F.col("b")))
    assert got == {tuple(r) for r in pairs.collect()} and got


def test_side_output_and_samples(spark):
    df = spark.range(100).selectExpr("id AS keys_id", "1 AS outcome_bool", "2.0D AS x_number")
    assert E.keys_and_outcomes(df).columns == ["keys_id", "outcome_bool"]
    assert E.fixed_sample(df, 10, seed=1).count() == 10 and E.fixed_sample(df, 1000).count() == 100
    nested = E.fraction_rows(df, "keys_id * 10", [0.1, 0.5]).groupBy("fraction").count().collect()
    assert {r["fraction"]: r["count"] for r in nested} == {0.1: 10, 0.5: 50}


SPELT = {"Ωμέγα Ψυχή": "Omega Psychi", "Θήβα ΐς": "Thiva is", "Щука Объём": "Shchuka Obem", "Київ": "Kiiv", "Љубљана": "Ljubljana",
         "ひらがな": "hiragana", "カタカナ": "katakana", "서울 한국": "seoul hangug", "Straße Æ é": "Strasse AE e", "中文 עב": "中文 עב", "": "", "plain": "plain"}


def test_letters_of_other_scripts(spark):
    """The expression and the names on the driver use one table."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SPELT)] + [(99, None)], "i int, s string")
    got = {r["i"]: r["f"] for r in df.select("i", X.ascii_fold(F.col("s")).alias("f")).collect()}
    assert got == {**dict(enumerate(SPELT.values())), 99: None}
    assert [letters.fold(s) for s in SPELT] == list(SPELT.values())
    assert plain_name(" Ωμέγα Café ") == "Omega-Cafe"
    assert [r[0] for r in df.where("i < 2").orderBy("i").select(X.standardize_name(F.concat("s", F.lit(" Ltd")))).collect()] == ["omega psychi", "thiva is"]


def test_all_syllables_and_letters_fold_alike(spark):
    rows = [(chr(c),) for c in range(0xAC00, 0xD7A4)] + [(ch,) for ch in letters.TABLE]
    folded = spark.createDataFrame(rows, "s string").select("s", X.ascii_fold(F.col("s")).alias("f")).collect()
    assert all(r["f"] == letters.fold(r["s"]) for r in folded) and len(folded) == len(rows)


def test_tokens_of_one_name_share_a_column(spark):
    df = spark.createDataFrame([(1, "café;tea"), (2, "cafe"), (3, "tea"), (4, None), (5, "milk")], "id int, l string")
    parsed = E.with_parsed(df, ["l"])
    words = ["café", "cafe", "tea"]
    got = {r["id"]: (r["l_cafe"], r["l_tea"]) for r in parsed.selectExpr("id", *E.list_dummies_sql("l", words)).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (0, 1), 4: (None, None), 5: (0, 0)}
    top = {r["id"]: (r["l_cafe"], r["l_tea"]) for r in parsed.selectExpr("id", *E.top_dummies_sql("l", words)).collect()}
    assert top == {**got, 5: (None, None)}
    one = {r["id"]: (r["l_cafe"], r["l_tea"]) for r in df.selectExpr("id", *E.onehot_sql("l", words)).collect()}
    assert one == {1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_letters_are_replaced_once_and_many_kinds_fold_alike(spark):
    rows = [("".join(chr(c) for c in range(0xAC00, 0xAC00 + n)) + "Ångström ß中😀 æß ́",) for n in (0, 40, 90)] + [("中文ß",), ("😀",)]
    df = spark.createDataFrame(rows, "s string").select("s", X.ascii_fold(F.col("s")).alias("f"))
    assert all(r["f"] == letters.fold(r["s"]) for r in df.collect())
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
