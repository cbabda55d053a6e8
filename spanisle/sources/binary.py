"""Binary table files: PostgreSQL's COPY format, and the row format of arrays; a file is a binary value, as `binaryFile` reads it.

Rows are coded by executors, a file for each batch of rows, so no file outgrows a batch.  Types are those of `sql_type`: booleans,
integers, floating-point numbers, text, bytes, dates and timestamps.  An empty table gives no file, and a file without rows no row;
bytes that do not fit the schema raise ValueError."""

from __future__ import annotations

import datetime
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: What a COPY file starts with, and the day its dates and timestamps count from.
SIGNATURE, FIRST_DAY = b"PGCOPY\n\xff\r\n\x00", datetime.date(2000, 1, 1)
_START = datetime.datetime(2000, 1, 1)
_MICRO = datetime.timedelta(microseconds=1)
#: Struct codes of types of fixed width.
_CODES = {"boolean": "?", "tinyint": "b", "smallint": "h", "int": "i", "bigint": "q", "float": "f", "double": "d", "date": "i", "timestamp_ntz": "q"}


def _number(v, kind: str):
    return (v - FIRST_DAY).days if kind == "date" else (v - _START) // _MICRO if kind == "timestamp_ntz" else v


def _value(v, kind: str):
    return FIRST_DAY + datetime.timedelta(days=v) if kind == "date" else _START + v * _MICRO if kind == "timestamp_ntz" else v


def _kinds(schema: StructType) -> list[tuple[str, bool]]:
    out = [(f.dataType.simpleString(), f.nullable) for f in schema.fields]
    if bad := [k for k, _ in out if k not in _CODES and k not in ("string", "binary")]:
        raise TypeError(f"no binary form for {', '.join(bad)}")
    return out


def copy_file(rows: list[tuple], kinds: list[tuple[str, bool]]) -> bytes:
    """Rows in PostgreSQL's COPY format."""
    out = [SIGNATURE, struct.pack(">ii", 0, 0)]
    for row in rows:
        out.append(struct.pack(">h", len(kinds)))
        for v, (kind, _) in zip(row, kinds, strict=True):
            if v is None:
                out.append(b"\xff\xff\xff\xff")
                continue
            code = "h" if kind == "tinyint" else _CODES.get(kind)  # PostgreSQL's least integer has two bytes
            data = struct.pack(">" + code, _number(v, kind)) if code else v.encode() if kind == "string" else bytes(v)
            out += [struct.pack(">i", len(data)), data]
    return b"".join([*out, b"\xff\xff"])


def copy_rows(data: bytes, kinds: list[tuple[str, bool]]) -> Iterator[tuple]:
    if data[:11] != SIGNATURE:
        raise ValueError("not a COPY file")
    at = 19 + struct.unpack_from(">i", data, 15)[0]
    while (n := struct.unpack_from(">h", data, at)[0]) >= 0:
        if n != len(kinds):
            raise ValueError(f"a row has {n} fields, the schema {len(kinds)}")
        at, row = at + 2, []
        for kind, _ in kinds:
            size = struct.unpack_from(">i", data, at)[0]
            at += 4
            if size < 0:
                row.append(None)
                continue
            part, code = data[at : at + size], "h" if kind == "tinyint" else _CODES.get(kind)
            at += size
            if len(part) < size or (code and struct.calcsize(">" + code) != size):
                raise ValueError(f"a field of {size} bytes is no {kind}")
            row.append(_value(struct.unpack(">" + code, part)[0], kind) if code else part.decode() if kind == "string" else part)
        yield tuple(row)


def cells_file(rows: list[tuple], kinds: list[tuple[str, bool]]) -> bytes:
    """Rows in the format of arrays: little-endian, a byte before each value that may be missing, text with its size and a zero."""
    out = []
    for row in rows:
        for v, (kind, may) in zip(row, kinds, strict=True):
            if v is None and not may:
                raise ValueError("a value that may not be missing is null")
            if may:
                out.append(b"\x00" if v is None else b"\xff")
            if code := _CODES.get(kind):
                out.append(struct.pack("<" + code, 0 if v is None else _number(v, kind)))
            else:
                data = b"" if v is None else v.encode() + b"\x00" if kind == "string" else bytes(v)
                out += [struct.pack("<I", len(data)), data]
    return b"".join(out)


def cells_rows(data: bytes, kinds: list[tuple[str, bool]]) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        row = []
        for kind, may in kinds:
            try:
                there = not may or data[at] == 0xFF
                at += may
                if code := _CODES.get(kind):
                    v = _value(struct.unpack_from("<" + code, data, at)[0], kind)
                    at += struct.calcsize("<" + code)
                else:
                    size = struct.unpack_from("<I", data, at)[0]
                    part, at = data[at + 4 : at + 4 + size], at + 4 + size
                    if len(part) < size:
                        raise IndexError
                    v = part[:-1].decode() if kind == "string" else part
            except (IndexError, struct.error):
                raise ValueError("a file ends within a row") from None
            row.append(v if there else None)
        yield tuple(row)


FORMATS = {"copy": (copy_file, copy_rows), "cells": (cells_file, cells_rows)}


def to_binary(df: DataFrame, format: str) -> DataFrame:
    """(content): the rows of df as files of the format "copy" or "cells"."""
    code, kinds = FORMATS[format][0], _kinds(df.schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([code(rows, kinds)], pa.binary())], ["content"])

    return df.mapInArrow(run, "content binary")


def from_binary(files: DataFrame, schema: StructType | str, format: str, column: str = "content") -> DataFrame:
    """The rows of files of a format; `files` may come from `spark.read.format("binaryFile")`."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parse, kinds = FORMATS[format][1], _kinds(schema)
    types = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for b in batches:
            column = b.column(0)
            del b
            for i in range(len(column)):
                rows = parse(column[i].as_py(), kinds)
                while part := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (k, _) in zip(zip(*part, strict=True), kinds, strict=True)], schema.fieldNames())
            del column  # a batch holds many files, and goes before the next one comes

    return files.select(column).mapInArrow(run, schema)


def transformed(files: DataFrame, schema: StructType | str, source: str, target: str) -> DataFrame:
    """Files of one format as files of another."""
    return to_binary(from_binary(files, schema, source), target)
