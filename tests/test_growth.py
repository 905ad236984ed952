import json
import random

import pytest
from pyspark.sql import types as T

from coldhaul import ArchiveTable, JsonColumn, Ledger, RunScope, archive, archived
from coldhaul.operators.growth import grown, merged_type, shared, with_growth
from coldhaul.sinks import tables as lake


def ddl(text):
    return T.StructType.fromDDL(text)


def test_types(spark):
    known = ddl("a struct<x:int>, l array<struct<p:int>>, m map<string,struct<v:int>>, s string, n array<int>")
    more = ddl("a struct<x:bigint,y:struct<z:int>>, l array<struct<q:int>>, m map<string,struct<v:int,w:int>>, s struct<t:int>, n array<string>, new int")
    assert grown(more, known) == ddl("a struct<y:struct<z:int>>, l array<struct<q:int>>, m map<string,struct<w:int>>, new int")
    assert shared(more, known) == ddl("a struct<x:bigint>, m map<string,struct<v:int>>, s struct<t:int>, n array<string>")
    assert merged_type(known, grown(more, known)) == ddl(
        "a struct<x:int,y:struct<z:int>>, l array<struct<p:int,q:int>>, m map<string,struct<v:int,w:int>>, s string, n array<int>, new int"
    )
    assert grown(known, known) is None and shared(known, known) == known


def bare(value):
    """Without nulls in structs, which JSON text does not tell from missing fields."""
    if isinstance(value, dict):
        return {k: bare(v) for k, v in value.items() if bare(v) is not None} or None
    return [bare(v) for v in value] if isinstance(value, list) else value


def random_document(rng, depth, fields):
    """Each name has one kind, so that only fields are new: numbers, structs, and arrays of structs above the last level."""
    out = {}
    for i, name in enumerate(fields):
        if i and rng.random() < 0.3:
            continue
        if i % 3 == 0:
            out[name] = rng.randint(0, 9)
        elif depth and i % 3 == 1:
            out[name] = random_document(rng, depth - 1, fields) or None
        elif depth:
            out[name] = [random_document(rng, depth - 1, fields) or None for _ in range(rng.randint(1, 2))]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_that_bring_new_nested_fields(spark, table, seed):
    """Three appends, each with more fields at every level; all values come back."""
    rng = random.Random(seed)
    name, location = table("growth")
    want = {}
    for run in range(3):
        fields = list("abcdefgh")[: 4 + 2 * run]
        documents = [{"id": 100 * run + i, **random_document(rng, 2, fields)} for i in range(15)]
        want |= {d["id"]: bare(d) for d in documents}
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps(d) for d in documents]))
        if run:
            lake.evolve_append(df, name)
        else:
            lake.append_or_create(df, name, location=location)
    raw = spark.read.table(name)
    merged = with_growth(raw)
    assert any("+" in c for c in raw.columns) and not any("+" in c for c in merged.columns)
    assert "lost_values" not in raw.columns
    got = {r["id"]: bare(r.asDict(recursive=True)) for r in merged.collect()}
    empty = (None, {}, [])
    clean = lambda d: {k: v for k, v in d.items() if v not in empty}
    assert {i: clean(d) for i, d in got.items()} == {i: clean(d) for i, d in want.items()}


def test_nulls_lengths_and_maps(spark, table):
    name, location = table("growth")
    first = spark.sql("SELECT 1 AS id, array(named_struct('x', 1), null) AS l, map('k', named_struct('v', 1)) AS m UNION ALL SELECT 2, null, null")
    lake.append_or_create(first, name, location=location)
    second = spark.sql(
        """SELECT 3 AS id, array(null, named_struct('x', 2, 'y', 'b')) AS l, map('a', named_struct('v', 2, 'w', 5), 'b', null) AS m
        UNION ALL SELECT 4, array(), map() UNION ALL SELECT 5, null, null"""
    )
    lake.evolve_append(second, name)
    got = {r["id"]: (r["l"], r["m"]) for r in with_growth(spark.read.table(name)).collect()}
    assert got[1] == ([(1, None), None], {"k": (1, None)}) and got[2] == (None, None) == got[5]
    assert got[3] == ([None, (2, "b")], {"a": (2, 5), "b": None}) and got[4] == ([], {})


def test_drift_beside_growth_is_still_reported(spark, table):
    name, location = table("growth")
    lake.append_or_create(spark.sql("SELECT 1 AS id, named_struct('x', 1) AS o"), name, location=location)
    lake.evolve_append(spark.sql("SELECT 2 AS id, named_struct('x', 'no number', 'y', 7) AS o"), name)
    row = with_growth(spark.read.table(name)).where("id = 2").first()
    assert row["o"] == (None, 7) and "no number" in row["lost_values"]


def test_reserved_names_are_refused(spark, table):
    name, location = table("growth")
    lake.append_or_create(spark.sql("SELECT named_struct('x', 1) AS o"), name, location=location)
    with pytest.raises(ValueError, match=r"o\+1"):
        lake.evolve_append(spark.sql("SELECT named_struct('x', 1) AS o, 1 AS `o+1`"), name)


def test_archived_documents_are_not_lossy(spark, table):
    prefix, location = table("growth")
    ledger = Ledger(prefix, location)
    runs = {"r1": '{"o":{"x":1},"l":[{"p":1}]}', "r2": '{"o":{"x":2,"n":{"d":3}},"l":[{"p":1,"q":[1]}]}', "r3": '{"o":{"n":{"d":4,"e":5},"z":6}}'}
    for i, (run, text) in enumerate(runs.items()):
        rows = spark.createDataFrame([(i, text, "1999-01-01")], "k long, doc string, ts string").selectExpr("k", "doc", "CAST(ts AS TIMESTAMP) AS ts")
        docs = ArchiveTable("docs", rows.drop("ts"), "k", f"{prefix}_docs", JsonColumn("doc"), f"{location}/docs")
        archive(spark, run, RunScope(rows, "k", "ts", "2000-01-01 00:00:00"), [docs], ledger)
    got = {r["k"]: r for r in archived(spark, f"{prefix}_docs", ledger).collect()}
    assert {r["parse_status"] for r in got.values()} == {"ok"}
    assert [bare(got[i]["o"].asDict(recursive=True)) for i in range(3)] == [json.loads(t)["o"] for t in runs.values()]
    assert got[1]["l"][0].asDict() == {"p": 1, "q": [1]} and got[2]["l"] is None
