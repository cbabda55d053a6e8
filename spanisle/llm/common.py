"""What the operators share: tables, partition counts, exchanges by a given partition, and tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files for each partition; beyond MANY partitions they grow instead.
PART_BYTES, MANY = 10 << 20, 20_000


def parts(df: DataFrame) -> int:
    """How many partitions a table is dealt to: by the size of its files as the planner knows it, at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # unknown
        return least
    return max(least, min(-(-size // PART_BYTES), MANY), -(-size // (PART_BYTES * 25)))


def integer(df: DataFrame, key: str) -> None:
    """Raises TypeError if a key column does not hold integers."""
    if not isinstance(kind := df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}, not of integers")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local one under a local master, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanisle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The application's own part of the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/spanisle/{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _scratch.add(path)
        atexit.register(remove, spark, path)
    return path


_scratch: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this module has made."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is then the cluster's to clean
        pass


class Saved:
    """Written tables that replace one another: `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(path := f"{scratch(self.spark)}/{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Removes all tables but the last `keep`."""
        cut = len(self.paths) - keep
        for path in self.paths[:cut]:
            remove(self.spark, path)
        self.paths = self.paths[cut:]


def saved(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    return Saved(df.sparkSession)(df)


def wide(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster has cores, at least, so that a table of few row groups keeps all of them busy.

    Only a scan of fewer partitions is dealt anew; a table of many files never is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def dealt(df: DataFrame, n: int, by: str) -> DataFrame:
    """Rows dealt to partitions 0..n-1 by the integer column `by`, without hashing."""
    return df.repartitionById(n, F.col(by).cast("int"))


def sharded(df: DataFrame, n: int, by: str, each: int = 2) -> DataFrame:
    """df with `shard`, one of n * each integers by the hash of a column; Spark's hash partitioning deals `each` of them to each
    of n partitions, so partitions are even, and a task works on one shard at a time."""
    ids = F.col("id").cast("int")
    found = df.sparkSession.range(n * 40 * each + 400).select(ids.alias("i"), F.pmod(F.hash(ids), F.lit(n)).alias("p"))
    rows = found.groupBy("p").agg(F.slice(F.sort_array(F.collect_list("i")), 1, each).alias("i")).collect()  # a row for each partition
    names = sorted(i for r in rows for i in r["i"])
    return df.withColumn("shard", F.element_at(F.lit(names), (F.pmod(F.xxhash64(by), F.lit(len(names))) + 1).cast("int")))


_caches: dict[str, list] = {}


def cache(owner: str, held: dict) -> dict:
    """held, which an operator's worker processes keep from task to task; see `enter`."""
    _caches.setdefault(owner, []).append(held)
    return held


def enter(owner: str) -> None:
    """At the start of a task: what other operators have kept in this worker process goes, as executors outlive operators."""
    for name, kept in _caches.items():
        if name != owner:
            for held in kept:
                held.clear()
    trim()


def trim() -> None:
    """Gives memory that a worker process no longer uses back to the system; workers live on from task to task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


#: Bits of the filter that `split_by` broadcasts (4 MB), in rows of FILTER_ROW bits.
FILTER_BITS, FILTER_ROW = 1 << 25, 1 << 19


def split_by(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their key in ids, rows that surely have not).

    A bit set of FILTER_BITS bits marks the hashes of the ids; it is broadcast packed, as FILTER_BITS / 8 bytes at most, whatever the
    number of ids, so large columns of rows that have no partner need no shuffle.  ids is a table of one column; with very many
    ids the set fills up and every row may have its key in ids, which costs time and changes no result."""
    cols = df.columns
    bit, row, words = (free(df, x) for x in ("bit", "row", "words"))
    size = FILTER_ROW // 64

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r, x in zip(b.column("r").to_pylist(), b.column("x"), strict=True):
                out = np.zeros(size, np.int64)
                found = x.values
                out[found.field("w").to_numpy()] = found.field("m").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(out))], ["r", "words"])

    own = ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS)).alias("bit"))
    marks = own.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("m"))
    lists = marks.groupBy(F.expr(f"word DIV {size}").alias("r")).agg(F.collect_list(F.struct((F.col("word") % size).cast("int").alias("w"), "m")).alias("x"))
    table = lists.mapInArrow(pack, "r long, words array<long>").select(F.col("r").alias(row), F.col("words").alias(words))
    marked = df.withColumn(bit, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(FILTER_BITS)))
    marked = marked.join(F.broadcast(table), F.expr(f"{bit} DIV {FILTER_ROW} = {row}"), "left")
    may = F.coalesce(F.expr(f"{words}[CAST(({bit} % {FILTER_ROW}) DIV 64 AS INT)] & shiftleft(1L, CAST({bit} & 63 AS INT))") != 0, F.lit(False))
    return tuple(marked.where(w).select(*(F.col(f"`{c}`") for c in cols)) for w in (may, ~may))


def free(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_spanisle_{name}") in taken:
        pass
    return name


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is not in ids; only rows that the bit set can't rule out are shuffled."""
    may, rest = split_by(df, key, ids)
    other = free(df, "other")
    return may.join(ids.select(F.col(ids.columns[0]).alias(other)), F.col(f"`{key}`") == F.col(other), "left_anti").union(rest)
