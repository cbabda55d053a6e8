"""Binary files, calls of APIs, and what the engine keeps and tells."""

import datetime
import json
import math
import struct
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from spanisle.engine import Engine
from spanisle.operators import array as ops
from spanisle.operators import kv
from spanisle.plans import afl, dialect, telemetry
from spanisle.sources import api, binary, files

ROW = [("a", "boolean", False), ("b", "boolean", True), ("c", "int", False), ("d", "int", True), ("e", "double", False), ("f", "double", True), ("g", "string", False), ("h", "string", True)]
KINDS = [(k, n) for _, k, n in ROW]
ROWS = [(True, None, 1, None, 1.0, None, "ann", "lee"), (False, None, 4, 5, 2.1, -2.3, "bo", None), (True, False, -1, 2, 1.2, 1.3, "", "é\n")]


def test_copy_format_bytes():
    got = binary.copy_file([(True, None, 1, "ab")], [("boolean", True), ("double", True), ("int", True), ("string", True)])
    assert got == b"PGCOPY\n\xff\r\n\0" + b"\0" * 8 + b"\0\4" + b"\0\0\0\1\1" + b"\xff\xff\xff\xff" + b"\0\0\0\4\0\0\0\1" + b"\0\0\0\2ab" + b"\xff\xff"
    stamp = binary.copy_file([(datetime.date(2000, 1, 2), datetime.datetime(1999, 12, 31, 23, 59, 59))], [("date", True), ("timestamp_ntz", True)])
    assert stamp.endswith(struct.pack(">hiiiq", 2, 4, 1, 8, -1_000_000) + b"\xff\xff")
    assert binary.cells_file([(None, 7, "ab")], [("boolean", True), ("int", False), ("string", False)]) == b"\0\0" + b"\7\0\0\0" + b"\3\0\0\0ab\0"


@pytest.mark.parametrize("form", ["copy", "cells"])
def test_binary_round_trip(form):
    write, read = binary.FORMATS[form]
    assert list(read(write(ROWS, KINDS), KINDS)) == ROWS and list(read(write([], KINDS), KINDS)) == []
    with pytest.raises((ValueError, struct.error)):
        list(read(write(ROWS, KINDS)[:-9], KINDS))


def test_binary_tables(spark):
    schema = "a boolean, n bigint, s string, x float, y binary, d date, t timestamp_ntz, i smallint, j tinyint"
    df = spark.createDataFrame([(True, 2**40, "x\ty", 1.5, b"\0\1", datetime.date(1969, 7, 20), datetime.datetime(2024, 2, 29, 1, 2, 3, 4), -5, 7), (None,) * 9], schema)
    for a, b in (("copy", "cells"), ("cells", "copy")):
        files = binary.to_binary(df, a)
        assert sorted(map(str, binary.from_binary(binary.transformed(files, df.schema, a, b), schema, b).collect())) == sorted(map(str, df.collect()))
    assert binary.from_binary(binary.to_binary(df.where("false"), "copy"), schema, "copy").count() == 0
    with pytest.raises(TypeError):
        binary.to_binary(spark.sql("select array(1) as a"), "copy")


def test_oauth1_signature():
    """The example of the protocol's first specification."""
    auth = {"consumer_key": "dpf43f3p2l4k3l03", "consumer_secret": "kd94hf93k423kf44", "access_token": "nnch734d00sl2jdk", "access_secret": "pfkkdhi9sl3r4s00"}
    got = api.oauth1_header(auth, "GET", "http://photos.example.net/photos", [("file", "vacation.jpg"), ("size", "original")], "kllo9940pd9333jh", 1191242096)
    assert f'oauth_signature="{urllib.parse.quote("tR3+Ty81lMeYAr/Fid0kMTYa/WM=", safe="")}"' in got


class _Server(BaseHTTPRequestHandler):
    def _answer(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        what = {"access_token": "tok"} if self.path == "/token" else {"list": [{"path": self.path, "auth": (self.headers.get("Authorization") or "")[:12], "body": body}]}
        data = json.dumps(what).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = _answer

    def log_message(self, *a):
        pass


def test_fetch(spark):
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url, e = f"http://127.0.0.1:{server.server_port}", Engine(spark)
        e.apis.add("a", "none", api.Endpoint(f"{url}/x?y=1"))
        e.apis.add("a", "basic", api.Endpoint(f"{url}/x", auth={"user": "u", "password": "p"}))
        e.apis.add("a", "token", api.Endpoint(f"{url}/x", method="POST", body="json", auth={"token": "t"}))
        e.apis.add("a", "one", api.Endpoint(f"{url}/x", method="POST", auth={"consumer_key": "k", "consumer_secret": "s"}))
        e.apis.add("a", "two", api.Endpoint(f"{url}/x", auth={"client_id": "i", "client_secret": "s", "token_url": f"{url}/token"}))
        call = lambda name: e.query(f"bdapi({{'name': 'a', 'endpoint': '{name}', 'query': {{'q': 'x y'}}, 'result-key': 'list'}})").collect()[0]
        assert call("none")["path"] == "/x?y=1&q=x+y" and call("none")["auth"] == ""
        assert call("basic")["auth"].startswith("Basic ") and json.loads(call("token")["body"]) == {"q": "x y"}
        assert call("one")["auth"].startswith("OAuth oauth_") and call("one")["body"] == "q=x+y" and call("two")["auth"] == "Bearer tok"
    finally:
        server.shutdown()


def test_scan_requests_with_apostrophes():
    q = kv.parse_scan("{ 'op':'scan', 'table':\"t\", 'range':{ 'end':[\"O'Brien\", 'it\\'s', 'say \"x\"'] } }")
    assert q["range"]["end"] == ["O'Brien", "it's", 'say "x"']


def test_tables_views_and_temp_names(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(i, i % 3) for i in range(10)], "a int, b int"))
    before = {t.name for t in spark.catalog.listTables()}
    assert e.query("bdrel(select b, count(*) as n into small from t where a > 1 group by b)").count() == 3
    e.query("bdrel(create table made as select a / 2 as h from t)")
    e.query("bdrel(create view seen as select a from t)")
    assert [r[0] for r in e.query("bdrel(select h from made order by h)").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert "Scan parquet" in e.query("bdrel(select * from small)")._jdf.queryExecution().simpleString().replace("FileScan", "Scan")
    assert e.query("bdrel(select count(*) as n from seen)").first()[0] == 10
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [c[2:5:2] for c in e.monitor.casts] == [("small", 3), ("made", 10)] and e.monitor.cast_table(spark).count() == 2


@pytest.mark.parametrize(("text", "value"), [("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("7.0 / 2", 3.5), ("8 / 3 / 2", 1), ("11 / 2 / 2", 2), ("(11 / 2 + 2) / 2 / 2.0", 1.5), ("(7 + 2) / (1 + 1)", 4), ("cast(7 as double precision) / 2", 3.5), ("7 / cast(2 as double precision)", 3.5), ("10 * 7 / 4", 17), ("cast(7 as real) / 2", 3.5), ("7::float8 / 2", 3.5), ("7.6::int8 / 3", 2), ("cast('12' as text)::int / 5", 2), ("7 / -2", -3), ("abs(-9) / length('ab')", 4), ("(9 / 2) / (3 / 2)", 4), ("count(*) / 2", 0)])
def test_division(spark, text, value):
    assert float(Engine(spark).query(f"bdrel(select {text} as v)").first()[0]) == value


def test_dialect_calls():
    assert dialect._date_pattern("YYYY-MM-DD HH24:MI") == "yyyy-MM-dd HH:mm" and dialect._date_pattern("999.99") is None
    assert dialect._similar("a%(b|c)_.") == r"^(?s:a.*(b|c).\.)$"
    assert dialect._words_match("a & !(b | c) d", "t").count("AND") == 2


def test_uniq_and_wide_windows(spark, monkeypatch):
    """Runs of a dimension are dealt to tasks, with the rows beside them; neighbours are compared, not values."""
    monkeypatch.setattr(ops, "RUN", 7)
    values = [(i * 2, [1, 2, 1, 1, 3][i % 5]) for i in range(60)]
    a = ops.to_array(spark.createDataFrame(values, "i long, v int"), "<v:int32>[i=0:*,100,0]")
    runs = [v for n, (_, v) in enumerate(values) if n == 0 or values[n - 1][1] != v]
    assert [r["v"] for r in ops.uniq(a).df.orderBy("i").collect()] == runs
    flat = [v for _, v in values]
    got = {r["i"]: r["s"] for r in ops.window(a, [(5, 3)], [("sum", "v", "s")]).df.collect()}
    assert got == {i: sum(v for j, v in values if i - 5 <= j <= i + 3) for i, _ in values}
    got = {r["i"]: r["s"] for r in ops.variable_window(a, "i", 4, 9, [("sum", "v", "s")]).df.collect()}
    assert got == {i: sum(flat[max(0, n - 4) : n + 10]) for n, (i, _) in enumerate(values)}
    got = {r["i"]: (r["s"], r["m"]) for r in ops.cumulate(a, [("sum", "v", "s"), ("max", "v", "m")]).df.collect()}
    assert got == {i: (sum(flat[: n + 1]), max(flat[: n + 1])) for n, (i, _) in enumerate(values)}
    with pytest.raises(ops.ArrayError):
        ops.cumulate(a, [("median", "v", "x")])


def test_array_language_words(spark):
    built = afl.Compiler(lambda n: None).compile("build(<w:int64>[x=0:2,3,0,y=0:1,2,0], x + y)")
    assert built.df.count() == 6 and built.schema.attrs == ["w"]
    with pytest.raises(afl.UnsupportedFunction):
        afl.Compiler(lambda n: None).compile("unfold(build(<w:int64>[x=0:2,3,0], x))")


def test_training_and_store_of_timings(spark, tmp_path):
    e = Engine(spark)
    e.register("t", spark.range(5))
    e.run("bdrel(select count(*) from t)")
    e.run("bdrel(select id from t where id > 2)")
    first = e.monitor.stalest()
    ran = []
    assert e.monitor.retime(ran.append, load=0.9) is None and ran == []
    assert e.monitor.retime(ran.append, load=0.1) == first and ran == [first.query] and e.monitor.stalest() != first
    e.monitor.save(spark, str(tmp_path / "timings"))
    other = telemetry.Monitor()
    other.load(spark, str(tmp_path / "timings"))
    assert len(other.entries) == 2 and other.lookup(first) is not None


def test_export(spark, tmp_path):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))
    e.export("bdrel(select * from t)", str(tmp_path / "j"), "json")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    e.export("bdrel(select * from t)", str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError, match="form"):
        e.export("bdrel(select * from t)", str(tmp_path / "x"), "xml")


def test_windows_of_several_dimensions(spark):
    """Sparse cells, uneven bounds and nulls; framed aggregates and those that see all values agree with plain loops."""
    cells = {(i, j, k): None if (i + j + k) % 5 == 0 else i * 7 + j * 3 + k for i in range(5) for j in range(6) for k in range(4) if (i * j + k) % 3}
    a = ops.to_array(spark.createDataFrame([(*at, v) for at, v in cells.items()], "i long, j long, k long, v int"), "<v:int32>[i=0:*,100,0,j=0:*,100,0,k=0:*,100,0]")
    bounds = [(1, 0), (2, 1), (0, 1)]
    reach = lambda at: [v for c, v in cells.items() if all(x - lo <= y <= x + hi for x, y, (lo, hi) in zip(at, c, bounds, strict=True))]
    got = ops.window(a, bounds, [("sum", "v", "s"), ("count", "*", "n"), ("count", "v", "c"), ("max", "v", "m")]).df.collect()
    assert len(got) == len(cells)
    for r in got:
        near = reach((r["i"], r["j"], r["k"]))
        some = [v for v in near if v is not None]
        assert (r["s"], r["n"], r["c"], r["m"]) == (sum(some) if some else None, len(near), len(some), max(some, default=None))
    for r in ops.window(a, bounds, [("median", "v", "m")]).df.collect():
        some = sorted(v for v in reach((r["i"], r["j"], r["k"])) if v is not None)
        assert r["m"] == (None if not some else (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2)


def test_quantiles_and_distinct_counts_are_exact(spark):
    """As SQL has them, to the last bit; for groups, for all cells, and where all values are null."""
    rows = [(i, j, 900 + ((i * 7919 + j * 104729) % 1999) / 10, (i * 31 + j * j) % 97) for i in range(40) for j in range(50)] + [(40, 0, None, None)]
    a = ops.to_array(spark.createDataFrame(rows, "i long, j long, v double, n long"), "<v:double,n:int64>[i=0:*,100,0,j=0:*,100,0]")
    got = {r["i"]: (r["q"], r["d"], r["h"]) for r in ops.aggregate(a, [("quantile", "v, 0.25", "q"), ("approxdc", "n", "d"), ("quantile", "n", "h")], ["i"]).df.collect()}

    def by_hand(values, p):
        at = (len(values) - 1) * p
        low, high = sorted(values)[math.floor(at)], sorted(values)[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    for i in range(40):
        v, n = ([r[c] for r in rows if r[0] == i] for c in (2, 3))
        assert got[i] == (by_hand(v, 0.25), len(set(n)), by_hand(n, 0.5))
    assert got[40] == (None, 0, None)
    whole = ops.aggregate(a, [("quantile", "v, 0.3", "q")], []).df.first()
    assert (whole["i"], whole["q"]) == (0, by_hand([r[2] for r in rows[:-1]], 0.3))
    with pytest.raises(ops.ArrayError, match="0 to 1"):
        ops.aggregate(a, [("quantile", "v, 2", "q")], [])


def test_jdbc(spark):
    """Types and nulls through an embedded engine; appending adds rows; a query may stand for a table."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:spanisletest;create=true"
    df = spark.createDataFrame([(1, "a'b", 1.5, True, datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, None, None, None, None)], "k int, s string, x double, b boolean, t timestamp")
    files.write_jdbc(df, url, "t", "overwrite")
    files.write_jdbc(df.withColumn("k", df["k"] + 10), url, "t")
    back = files.read_jdbc(spark, url, "t", "K", 0, 20, 4)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect()), key=str) == sorted([*map(tuple, df.collect()), *((k + 10, *r) for k, *r in df.collect())], key=str)
    assert files.read_jdbc(spark, url, "(select count(*) as n from t) q").first()[0] == 4
    assert [files.sql_type(t) for t in ("int unsigned", "tinyint(1)", "varchar(10)", "numeric(10, 2)", "datetime", "double precision", "timestamp with time zone")] == ["bigint", "boolean", "string", "decimal(10,2)", "timestamp_ntz", "double", "timestamp"]


def test_jdbc_where_only_the_driver_reaches_the_engine(spark, monkeypatch):
    """As on a cluster, whose executors would each make an empty embedded engine of their own."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    monkeypatch.setattr(files, "_own", lambda *_: True)
    monkeypatch.setattr(files, "HELD", 3)
    url = "jdbc:derby:memory:spanisleown;create=true"
    df = spark.createDataFrame([(i, "a'b", 1.5, True, datetime.datetime(2024, 1, 2, 3, 4, 5)) for i in range(8)] + [(9, None, None, None, None)], "k int, s string, x double, b boolean, t timestamp")
    files.write_jdbc(df.repartition(3), url, "t", "overwrite")
    back = files.read_jdbc(spark, url, "t", "K", 0, 20, 4)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.write_jdbc(df, url, "t")
    assert files.read_jdbc(spark, url, "t").count() == 18 and files.read_jdbc(spark, url, "(select \"k\" from t where \"k\" > 100) q").count() == 0
