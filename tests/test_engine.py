import json

import pytest

from spanisle import queries as base
from spanisle.engine import Engine, relation_schema
from spanisle.operators import array as ops
from spanisle.operators import kv
from spanisle.plans import telemetry
from spanisle.plans.afl import UnsupportedFunction
from spanisle.plans.tokens import QuerySyntaxError
from spanisle.sources import api, files
from spanisle.sources.catalog import CatalogError


@pytest.fixture(scope="module")
def engine(spark, sf):
    return base.engine(spark, sf)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_text_and_json_results(engine):
    q = "bdrel(select 1 as a, cast(null as string) as b, '007' as c)"
    assert engine.text(q) == "a\tb\tc\n1\tnull\t007\n"
    assert json.loads(engine.json(q)) == [{"a": 1, "b": None, "c": "007"}]


def test_literals_are_never_altered(engine):
    assert engine.query("bdrel(select 'A)b' as a, 'bdcast(' as b from region where r_regionkey = 0)").collect()[0] == ("A)b", "bdcast(")


def test_views_tables_and_names(engine):
    engine.query("bdrel(create view tops (k, n) as select n_regionkey, count(*) from nation group by n_regionkey)")
    assert engine.query("bdrel(select sum(n) as s from tops)").collect()[0][0] == 25
    engine.query("bdrel(select n_name, n_nationkey into s1.copy from nation where n_nationkey < 3)")
    assert engine.query("bdrel(select c.n_name from s1.copy as c)").count() == 3
    assert engine.query("bdrel(select copy.n_name from s1.copy)").count() == 3
    assert engine.catalog.has("s1___copy")
    engine.query("bdrel(drop view tops)")
    with pytest.raises(CatalogError):
        engine.query("bdrel(drop view tops)")


def test_array_schema_round_trip():
    s = ops.parse_schema("<a:int32 NOT NULL, b:string>[i=0:*,1000000,0, j=-2:7,5,1]")
    assert s.dims == ["i", "j"] and s.attrs == ["a", "b"] and s.dimensions[1] == ops.Dimension("j", -2, 7, 5, 1) and not s.attributes[0].nullable
    assert ops.parse_schema(str(s)) == s


def test_collisions_and_ranges(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "i long, v int")
    with pytest.raises(Exception, match="meet in one cell"):
        ops.to_array(df, "<v:int32>[i=0:*,10,0]").df.collect()
    assert rows(ops.to_array(df, "<v:int32>[i=0:*,10,0]", "max").df) == [(1, 7), (2, 1)]
    assert rows(ops.to_array(df, "<v:int32>[i=0:*,10,0]", "synthetic").df.select("i", "synthetic", "v")) == [(1, 0, 5), (1, 1, 7), (2, 0, 1)]
    with pytest.raises(Exception, match="out of range"):
        ops.to_array(df, "<v:int32>[i=2:9,10,0]", "min").df.collect()
    with pytest.raises(ops.ArrayError):
        ops.to_array(df, "<w:int32>[i=0:*,10,0]")


def test_flat_array_is_dense(spark):
    a = ops.flat(spark.range(1000).selectExpr("(id * 7919) % 1009 AS v").repartition(7))
    got = sorted((r["i"], r["v"]) for r in a.df.collect())
    assert [i for i, _ in got] == list(range(1000)) and [v for _, v in got] == sorted(v for _, v in got)


def test_unsupported_array_function(engine):
    with pytest.raises(UnsupportedFunction):
        engine.query("bdarray(limit(region, 3))")
    with pytest.raises(QuerySyntaxError):
        engine.array("bdrel(select 1)")


def test_store_and_scan(engine):
    engine.query("bdarray(store(filter(region, r_regionkey > 2), few))")
    assert engine.query("bdarray(scan(few))").count() == 2


def test_kv_round_trip(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 1.0)], "id int, s string, d double")
    back = kv.from_kv(kv.to_kv(df, ["id"]), {"id": "int", "s": "string", "d": "double"})
    assert rows(back.select("id", "d")) == rows(df.select("id", "d")) and back.where("id = 2").collect()[0]["s"] is None
    with pytest.raises(Exception, match="no column for"):
        kv.from_kv(kv.to_kv(df, ["id"]), {"id": "int"}).collect()
    assert kv.to_kv(df).where("row = '000000000000'").count() == 3


def test_kv_scan_bounds_and_rendering(spark):
    df = spark.createDataFrame([("a", "", "", "1"), ("a", "x", "y", "2"), ("b", "", "q", "3")], "row string, cf string, cq string, value string")
    assert [r["value"] for r in kv.scan(df, ["a", "x", None]).collect()] == ["2", "3"]
    assert [r["value"] for r in kv.scan(df, None, ["b", "", "q"]).collect()] == ["1", "2"]
    assert kv.scan(df, None, ["b", "", "q"], end_inclusive=True).count() == 3
    assert rows(kv.rendered(df).where("row = 'b'")) == [("b", ":q", "3")] and kv.rendered(df).where("column IS NULL").count() == 1
    assert kv.parse_scan("{ 'op':'scan', 'table':'t', 'range':{ 'end':['S0100','',''] } }")["range"]["end"][0] == "S0100"


def test_api_inference(spark, engine):
    assert api.infer([{"a": 1, "b": None}, {"a": 2.5, "c": True}]) == [("a", "json", False), ("b", "json", True), ("c", "boolean", True)]
    assert api.infer([{"a": 1}, {"a": 2**40}]) == [("a", "bigint", False)]
    assert [tuple(r) for r in api.flatten(spark, '{"d": [[1, "x"], [2, "y"]]}', "d").collect()] == [(1, "x"), (2, "y")]
    assert api.flatten(spark, "[3, 4]").columns == ["col1"] and api.flatten(spark, '{"a": {"b": 1}}').collect()[0][0] == '{"b": 1}'
    with pytest.raises(QuerySyntaxError):
        api.parse_call("{'name': 'n', 'endpoint': 'e', 'query': {}, 'query-raw': 'x'}")
    with pytest.raises(KeyError):
        engine.query("bdapi({'name': 'n', 'endpoint': 'e'})")


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("0|AFRICA|'a|b'\n1|ASIA|c\n")
    assert rows(files.read_csv(spark, str(tmp_path / "r.csv"), "k long, n string, c string")) == [(0, "AFRICA", "a|b"), (1, "ASIA", "c")]
    (tmp_path / "r.scidb").write_text('{0}[\n(0,"AFRICA","x, (y)"),\n(1,"A\\"B",null)\n]')
    got = files.read_array_text(spark, str(tmp_path / "r.scidb"), "<k:int64,n:string,c:string>[i=0:*,1000000,0]")
    assert rows(got.fillna("-")) == [(0, 0, "AFRICA", "x, (y)"), (1, 1, 'A"B', "-")]
    assert [r[0] for r in files.array_text(got, "i").collect()][0] == '(0,"AFRICA","x, (y)")'
    a = ops.to_array(got, "<n:string>[i=0:*,10,0]")
    files.write_array(a, str(tmp_path / "arr"))
    assert files.read_array(spark, str(tmp_path / "arr")).schema == a.schema


@pytest.mark.parametrize(("name", "kind"), [("tinyint(1)", "boolean"), ("int(11) unsigned", "bigint"), ("decimal(15,2)", "decimal(15,2)"), ("character varying(10)", "string"), ("timestamp with time zone", "timestamp"), ("datetime", "timestamp_ntz"), ("double precision", "double"), ("blob", "binary")])
def test_foreign_types(name, kind):
    assert files.sql_type(name) == kind


def test_relation_schema():
    assert relation_schema("(a int not null, b varchar(10), c double precision, primary key (a))") == [("a", "int"), ("b", "string"), ("c", "double")]


def test_catalog_commands(spark):
    e = Engine(spark)
    assert e.query("bdcatalog(islands)").count() == 5
    e.query("bdcatalog(insert into catalog.engines (name, host, port) values ('pg', 'h', 5432), ('x', 'y', 1); update engines set host = 'z' where name = 'x'; delete from engines where name = 'pg')")
    assert rows(e.query("bdcatalog(select name, host from catalog.engines where host = 'z')")) == [("x", "z")]
    assert e.catalog.casts_from(1) == [1] and e.catalog.engine_of(1)["name"] == "spark"
    with pytest.raises(CatalogError):
        e.query("bdcatalog(nothing)")
    with pytest.raises(CatalogError):
        e.query("bdtext({'op':'scan','table':'none'})")


def test_telemetry(engine):
    engine.run("bdrel(select count(*) as n from orders where o_custkey = 1)")
    s = engine.monitor.entries[0][0]
    assert s.distance(s) == 0 and telemetry.Signature.loads(s.dumps()) == s
    assert engine.monitor.lookup(s) is not None and engine.monitor.closest(s)[2] == 0
    a, b = telemetry.parse_tree("{a{b}{c{d}}}"), telemetry.parse_tree("{a{b}{d}}")
    assert telemetry.text_of(a) == "{a{b}{c{d}}}" and telemetry.edit_distance(a, b) == 1 and telemetry.edit_distance(a, a) == 0
    assert telemetry.set_difference([], []) == 0 and telemetry.set_difference(["x"], ["x", "y"]) == 0.5
    engine.monitor.remove(s)
    assert not engine.monitor.entries
