from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as N
from tidemark.operators.relate import append_evolving
from tidemark.session import materialize, scratch_dir
from tidemark.sources import files as S


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_csv_edge_cases(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('id,name,at,flag\n1, "a ""b"", c",2016-08-01,true\n2,"line\nbreak",1-08-16,false\n3,short\n4,x,2016-08-02,true,extra\n')
    schema = schema_of(spark, "id int, name string, at date, flag boolean")
    rows = {r["id"]: r for r in S.read_csv(spark, str(path), schema, keep_corrupt=True).collect()}
    assert rows[1]["name"] == 'a "b", c' and rows[1]["flag"] == 1
    assert rows[2]["name"] == "line\nbreak" and rows[2]["at"] is None       # date out of range
    assert rows[3]["at"] is None and rows[3]["_corrupt_record"] is not None  # ragged
    assert rows[4]["_corrupt_record"] is not None
    assert all(f.nullable for f in S.loaded_schema(schema).fields)
    assert S.loaded_schema(schema)["flag"].dataType.simpleString() == "int"


def test_csv_without_header_and_inference(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1,true\n2,false\n")
    df = S.read_csv(spark, str(tmp_path / "n.csv"), header="false")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1), (2, 0)]


def test_snapshot_roundtrip_and_modes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    S.write_snapshot({"t": df}, str(tmp_path), "parquet")
    S.write_snapshot({"t": df}, str(tmp_path), "parquet", mode="append")
    back = S.read_snapshot(spark, str(tmp_path), {"t": None}, "parquet")["t"]
    assert back.count() == 2
    S.write_snapshot({"t": df}, str(tmp_path), "parquet", mode="overwrite")
    assert S.read_snapshot(spark, str(tmp_path), {"t": None}, "parquet")["t"].count() == 1
    assert S.register_snapshot({"t": df}, "snap_") == ["snap_t"] and "snap_t" in S.list_relations(spark)


def test_jdbc_options():
    got = S.jdbc_options("jdbc:postgresql://h/d", "jobs", "id", (0, 100), 8)
    assert got["numPartitions"] == "8" and got["lowerBound"] == "0" and got["dbtable"] == "jobs"
    with pytest.raises(ValueError):
        S.jdbc_options("u", "t", "id")


def test_slice_store_builds_once(spark, tmp_path):
    store, calls = S.SliceStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.get("feature", date(2014, 4, 1), build).count() == 3
    assert len(calls) == 1
    store.get("feature", date(2014, 4, 1), build, reuse=False)
    assert len(calls) == 2


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"uuid": "u1", "p": {"name": "n", "extra": 1}, "rel": [{"item": {"v": 1}, "tags": ["x", "y"]}, {"item": {"v": null}}]}}')
    (tmp_path / "b.json").write_text('{"data": {"permalink": "perma", "p": {"name": null}, "rel": []}}')
    ddl = "data struct<uuid:string,permalink:string,p:struct<name:string>,rel:array<struct<item:struct<v:int>,tags:array<string>>>>"
    docs = S.read_json_documents(spark, str(tmp_path), schema_of(spark, ddl)).select(F.struct("*").alias("doc"))
    mapping = {"p.name": ["orgs.name", "names.text"], "rel": {"item.v": "links.v", True: "links.is_rel", "tags": "tags.tag"}, "gone.away": "orgs.x"}
    keys = {"uuid": ["orgs.uuid", "links.org", "tags.org", "names.org"], "permalink": ["orgs.uuid", "links.org", "tags.org", "names.org"]}
    out = N.normalize_documents(docs, "doc", mapping, keys)
    assert sorted(out) == ["links", "names", "orgs", "tags"]
    assert [tuple(r) for r in out["orgs"].collect()] == [("u1", "n")]      # the other has one value only
    assert {(r["org"], r["v"], r["is_rel"]) for r in out["links"].collect()} == {("u1", "1", "true"), ("u1", None, "true")}
    assert {(r["org"], r["tag"]) for r in out["tags"].collect()} == {("u1", "x"), ("u1", "y")}


def test_evolving_append(spark):
    a, b = spark.sql("SELECT 1 AS id, 'x' AS old"), spark.sql("SELECT 2 AS id, 5 AS new")
    out = append_evolving([a, b])
    assert out.columns == ["id", "old", "new"] and out.count() == 2


def test_scratch_is_under_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path.startswith(root or spark.conf.get("spark.checkpoint.dir"))
    assert materialize(spark.range(4), "m").count() == 4


def test_typed_paths_through_lists(spark):
    kind = ("struct<uuid:string,permalink:string,a:struct<b:array<struct<c:int,d:array<array<double>>>>>,m:map<string,bigint>,"
            "one:struct<v:int>,other:struct<v:double>,text:string>")
    body = '{"uuid":null,"permalink":"p","a":{"b":[{"c":1,"d":[[1.5,2.5],[3.5]]},{"c":null,"d":[]}]},"m":{"k":7},"one":{"v":3},"other":{"v":0.5},"text":"t"}'
    docs = spark.createDataFrame([(body,)], "s string").select(F.from_json("s", kind).alias("doc"))
    keys = {"uuid": ["cs.id", "ds.id", "vs.id"], "permalink": ["cs.id", "ds.id", "vs.id"], "absent": ["cs.id"]}
    mapping = {"a.b.c": "cs.c", "a.b": {"d": "ds.d"}, "m.k": "vs.k", "m.gone": "vs.gone", "one.v": "vs.v", "other": {"v": "vs.v2"}, "a.b.d": "mixed.x", "text": "mixed.x"}
    out = N.normalize_documents(docs, "doc", mapping, {**keys, "uuid": [*keys["uuid"], "mixed.id"]}, typed=True)
    assert out["cs"].dtypes == [("id", "string"), ("c", "int")] and [tuple(r) for r in out["cs"].collect()] == [("p", 1)]
    assert sorted(tuple(r) for r in out["ds"].collect()) == [("p", 1.5), ("p", 2.5), ("p", 3.5)]
    assert out["vs"].select("k", "gone", "v", "v2").collect()[0] == (7, None, 3, 0.5)
    assert sorted(r["x"] for r in out["mixed"].collect()) == ["1.5", "2.5", "3.5", "t"]
    with pytest.raises(ValueError, match="no path 'a.b.z'"):
        N.normalize_documents(docs, "doc", {"a.b.z": "cs.z"}, keys, strict=True)


def test_typed_documents_are_parsed_once(spark):
    """All relations read the written documents; each parsed them anew before."""
    from tidemark.plans.registry import QUERIES

    plan = QUERIES["doc_normalize_typed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "lineitem" not in plan
