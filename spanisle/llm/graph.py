"""Connected components of a graph given as edges, by repeated contraction.

In each round every node takes its least neighbour as label, labels are followed twice, and edges are rewritten to labels;
edges inside a label vanish.  The number of rounds is logarithmic in the longest path.  A node with very many edges is met
in joins on spread keys only, so no task gets all of them; nothing is collected.  Each round's tables replace those before.
Once LOCAL_EDGES edges or fewer are left (a few megabytes, counted first), one task joins them in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved

SALTS, LOCAL_EDGES = 16, 200_000
#: A table is broadcast if it has no more rows than this (a few numbers each).
BROADCAST_ROWS = 20_000


def spread(left: DataFrame, right: DataFrame, on: str, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """left joined with right, which has a row for each key at most.

    right is broadcast where it is known to have few rows; else both are shuffled, and rows of a frequent key go to SALTS tasks."""
    if rows is not None and rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), left[on] == right[key], how)
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))  # noqa: E741
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return l.join(r.hint("merge"), (l[on] == r[key]) & (l["_salt"] == r["_salt"]), how).drop("_salt")


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that links reach) of edges between a and b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (up := new[new]).tolist() != new.tolist():
            new = up
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _joined(batches):
    found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if found:
        nodes, label = labels_of(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node that links reach.

    Null ends and loops are left out; repeated edges count once; no edges give an empty table.  Nodes are whole numbers."""
    spark = edges.sparkSession
    links, labels, found = Saved(spark), Saved(spark), Saved(spark)
    e = links(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b").distinct())
    out = None
    while True:
        left = e.count()
        if left <= LOCAL_EDGES:
            p = labels(e.coalesce(1).mapInArrow(_joined, "node long, label long"))
            if out is None or not left:
                return p.select("node", F.col("label").alias("component")) if out is None else out
            to = p.select(F.col("node").alias("_n"), F.col("label").alias("_to"))
            return spread(out, to, "component", "_n", rows=2 * left).select("node", F.coalesce("_to", "component").alias("component"))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
        p = labels(p)
        n = p.count()
        for _ in range(2):
            up = p.select(F.col("node").alias("_n"), F.col("label").alias("_up")).where("_n <> _up")
            p = spread(p, up, "label", "_n", rows=n).select("node", F.coalesce("_up", "label").alias("label"))
        p = labels(p)
        to = p.select(F.col("node").alias("_n"), F.col("label").alias("_to"))
        e = spread(e, to, "a", "_n", "inner", n).select(F.col("_to").alias("a"), "b")
        e = spread(e, to, "b", "_n", "inner", n).select("a", F.col("_to").alias("b"))
        e = links(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        p = p.select("node", F.col("label").alias("component"))
        out = p if out is None else found(spread(out, to, "component", "_n", rows=n).select("node", F.coalesce("_to", "component").alias("component")))
        links.drop(keep=1)
        if len(found.paths):
            labels.drop(keep=1)
        found.drop(keep=1)
