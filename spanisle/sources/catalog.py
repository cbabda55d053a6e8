"""The catalog: islands, engines, shims, casts, databases and objects, and the objects' data as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.array import Array, flat
from ..plans.tokens import QuerySyntaxError, join, split, tokenize, unquote

#: The tables of the catalog, with their columns; the first is the key where it is an id.
TABLES = {
    "islands": "iid int, scope_name string, access_method string",
    "engines": "eid int, name string, host string, port int, connection_properties string",
    "shims": "shim_id int, island_id int, engine_id int, access_method string",
    "casts": "src_eid int, dst_eid int, access_method string",
    "databases": "dbid int, engine_id int, name string, userid string, password string",
    "objects": "oid int, name string, fields string, logical_db int, physical_db int",
}
_ISLANDS = ("RELATIONAL", "ARRAY", "TEXT", "API", "STREAM")


class CatalogError(ValueError):
    """A name is unknown or taken."""


@dataclass
class Catalog:
    spark: SparkSession
    rows: dict[str, list[tuple]] = field(default_factory=lambda: {t: [] for t in TABLES})
    data: dict[str, Callable[[], DataFrame | Array]] = field(default_factory=dict)
    procedures: dict[str, tuple[list[str], Callable]] = field(default_factory=dict)

    def __post_init__(self):
        for name in _ISLANDS:
            self.add("islands", scope_name=name, access_method="spark")
        e = self.add("engines", name="spark", host="local", port=0, connection_properties="")
        for i in range(len(_ISLANDS)):
            self.add("shims", island_id=i + 1, engine_id=e, access_method="dataframe")
        self.add("casts", src_eid=e, dst_eid=e, access_method="lineage")
        self.default_db = self.add("databases", engine_id=e, name="default", userid="", password="")

    # writing

    def _columns(self, table: str) -> list[str]:
        if table not in TABLES:
            raise CatalogError(f"no catalog table is named {table}")
        return [c.strip().split()[0] for c in TABLES[table].split(",")]

    def add(self, table: str, **values) -> int:
        """Adds a row and gives its id."""
        cols = self._columns(table)
        if unknown := set(values) - set(cols):
            raise CatalogError(f"{table} has no {', '.join(sorted(unknown))}")
        if table != "casts" and cols[0] not in values:
            values[cols[0]] = 1 + max((r[0] for r in self.rows[table]), default=0)
        self.rows[table].append(tuple(values.get(c) for c in cols))
        return values[cols[0]]

    def register(self, name: str, data: DataFrame | Array | Callable[[], DataFrame | Array], fields: list[str] | None = None) -> None:
        """An object; a callable is asked when the object is used, so registering many tables opens none."""
        key = self.key(name)
        self.unregister(name, missing_ok=True)
        if fields is None:
            fields = [] if callable(data) else (data.schema.dims + data.schema.attrs if isinstance(data, Array) else data.columns)
        self.add("objects", name=key, fields=",".join(fields), logical_db=self.default_db, physical_db=self.default_db)
        self.data[key] = data if callable(data) else lambda: data

    def unregister(self, name: str, missing_ok: bool = False) -> None:
        key = self.key(name)
        if key not in self.data and not missing_ok:
            raise CatalogError(f"no object is named {name}")
        self.data.pop(key, None)
        self.rows["objects"] = [r for r in self.rows["objects"] if r[1] != key]

    # reading

    @staticmethod
    def key(name: str) -> str:
        """Names are case-insensitive, and a.b may be written a___b, as arrays need."""
        return name.strip().strip('"`').replace("___", ".").lower()

    def has(self, name: str) -> bool:
        return self.key(name) in self.data

    def get(self, name: str) -> DataFrame | Array:
        if not self.has(name):
            raise CatalogError(f"no object is named {name}")
        return self.data[self.key(name)]()

    def relation(self, name: str) -> DataFrame:
        found = self.get(name)
        return found.df if isinstance(found, Array) else found

    def array(self, name: str) -> Array:
        found = self.get(name)
        return found if isinstance(found, Array) else flat(found)

    def table(self, name: str) -> DataFrame:
        self._columns(name)
        return self.spark.createDataFrame(self.rows[name], TABLES[name])

    def find(self, table: str, **values) -> list[dict]:
        cols = self._columns(table)
        return [d for r in self.rows[table] if all((d := dict(zip(cols, r, strict=True))).get(k) == v for k, v in values.items())] if values else [dict(zip(cols, r, strict=True)) for r in self.rows[table]]

    def engine_of(self, dbid: int) -> dict:
        db = self.find("databases", dbid=dbid)
        if not db:
            raise CatalogError(f"no database {dbid}")
        return self.find("engines", eid=db[0]["engine_id"])[0]

    def casts_from(self, eid: int) -> list[int]:
        return [c["dst_eid"] for c in self.find("casts", src_eid=eid)]

    def objects_like(self, pattern: str) -> list[str]:
        return sorted(r[1] for r in self.rows["objects"] if re.search(pattern, r[1]))

    # the command language

    def command(self, text: str) -> DataFrame:
        """`table [(columns)]`, or SQL statements between semicolons; the last one's result is returned."""
        statements = [s for s in split(tokenize(text), ";") if s]
        out = None
        for s in statements:
            out = self._select(text, s) if s[0].word("select", "with") else self._dml(s) if s[0].word("insert", "update", "delete") else self._view(s)
        if out is None:
            raise QuerySyntaxError("a catalog command is empty")
        return out

    def _view(self, tokens) -> DataFrame:
        name = tokens[0].text.lower()
        df = self.table(name)
        rest = [t for t in tokens[1:] if not t.op("(", ")", "[", "]", ",")]
        return df.select(*(unquote(t.text) for t in rest)) if rest else df

    def _select(self, text: str, tokens) -> DataFrame:
        views = {t: self.table(t) for t in TABLES}
        for t, df in views.items():
            df.createOrReplaceTempView(f"_catalog_{t}")
        out, skip = [], 0
        for i, t in enumerate(tokens):
            if skip:
                skip -= 1
                continue
            if t.word("catalog") and i + 1 < len(tokens) and tokens[i + 1].op("."):
                skip = 1
                continue
            named = t.kind == "word" and t.text.lower() in TABLES and i and (tokens[i - 1].word("from", "join") or tokens[i - 1].op(",", "."))
            out.append(type(t)(t.kind, f"_catalog_{t.text.lower()} AS {t.text}" if named and not (i + 1 < len(tokens) and tokens[i + 1].word("as")) else f"_catalog_{t.text.lower()}" if named else t.text, -1 if named else t.start))
        return self.spark.sql(join(out))

    def _dml(self, tokens) -> DataFrame:
        """INSERT INTO t (cols) VALUES (...), ...; UPDATE t SET c = v [WHERE c = v AND ...]; DELETE FROM t [WHERE ...]."""
        words = [t for t in tokens if not (t.word("catalog") or t.op("."))]
        kind = words[0].text.lower()
        value = lambda t: unquote(t.text) if t.kind == "string" else None if t.word("null") else int(t.text) if t.text.lstrip("-").isdigit() else float(t.text)

        def pairs(part):
            out = {}
            for p in part:
                if len(p) != 3 or not p[1].op("="):
                    raise QuerySyntaxError(f"expected column = literal, not {join(p)}")
                out[p[0].text.lower()] = value(p[2])
            return out

        if kind == "insert":
            table, at = words[2].text.lower(), 3
            cols = self._columns(table)
            if words[at].op("("):
                end = next(i for i in range(at, len(words)) if words[i].op(")"))
                cols, at = [t.text.lower() for t in words[at + 1 : end] if not t.op(",")], end + 1
            n = 0
            for group in split(words[at + 1 :]):
                self.add(table, **dict(zip(cols, (value(t) for t in group if not t.op("(", ")", ",")), strict=True)))
                n += 1
            return self.spark.createDataFrame([(n,)], "changed int")
        table = words[1 if kind == "update" else 2].text.lower()
        cols = self._columns(table)
        where = next((i for i, t in enumerate(words) if t.word("where")), len(words))
        cond, part = [], []
        for t in words[where + 1 :]:
            if t.word("and"):
                cond.append(part)
                part = []
            else:
                part.append(t)
        match = pairs(cond + [part] if part else cond)
        hit = lambda r: all(dict(zip(cols, r, strict=True))[k] == v for k, v in match.items())
        n = sum(map(hit, self.rows[table]))
        if kind == "delete":
            self.rows[table] = [r for r in self.rows[table] if not hit(r)]
        else:
            new = pairs(split(words[3:where]))
            self.rows[table] = [tuple((dict(zip(cols, r, strict=True)) | new)[c] for c in cols) if hit(r) else r for r in self.rows[table]]
        return self.spark.createDataFrame([(n,)], "changed int")
