"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree of domain, language and source.  At each node the children get shares by weight; a child
that cannot use its share (all tokens below it, each at most `epochs` times) is filled, and the shortage goes to its siblings by
their weights; only what a whole node cannot use is left to the node's own siblings, one level up.  Each leaf then takes a
prefix of exactly its budget from its epochs: every epoch is a seeded permutation of the leaf's documents.

Prefix sums run in two steps, by buckets of the permutation and within a bucket, so a leaf that holds a third of all rows is
spread over many tasks.  Only DataFrame operations are used.  The tree itself is small (a row for each leaf).

A token is a run of characters other than blank, tab, line feed and carriage return.  Weights are whole numbers from 0 to 1000.

Cases: a null or empty text has no tokens and is never selected; a null domain, language or source counts as "none"; a child of
weight 0 gets nothing; repeated rows are selected each; an empty table or no budget gives an empty table; what integer division
leaves over (less than a token for each child) is not spent; extra columns pass through `select` and are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import free, saved

BUCKET_DOCS, LEAVES_MOST = 2000, 20_000
NONE = "none"


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, w in sorted(weights.items()):
        out = F.when(F.col(column) == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def _filled(df: DataFrame, parent: list[str], child: str, budget: str) -> DataFrame:
    """df with `got`: the child's part of its parent's `budget` by weight `w` under capacity `cap`; integers throughout.

    In the order of capacity for each unit of weight, a child is full if its even share of what is left covers its capacity."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy((F.col("cap") / F.col("w")).asc(), F.col(child).asc())
    df = df.withColumn("_left", F.col(budget) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("_full", F.col("cap") * F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)) <= F.col("_left") * F.col("w"))
    df = df.withColumn("_used", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(by)).withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(by))
    return df.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr(f"({budget} - _used) * w DIV greatest(_open, 1)"))).drop("_left", "_full", "_used", "_open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], default: int, share: float, epochs: int) -> DataFrame:
    """leaves (domain, language, source, n_docs, n_tokens) with `got`, the tokens to take from each."""
    base = leaves.where("n_tokens > 0").withColumn("cap", F.col("n_tokens") * epochs)
    for c in ("domain", "language", "source"):
        base = base.withColumn(f"w_{c}", _weight(c, weights.get(c, {}), default))
    base = base.where("w_domain > 0 AND w_language > 0 AND w_source > 0")
    total = leaves.agg(F.floor(F.sum("n_tokens") * F.lit(share)).cast("long")).first()[0] or 0  # a number
    top = base.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("w_domain").alias("w"))
    top = _filled(top.withColumn("budget", F.lit(total).cast("long")), [], "domain", "budget").select("domain", F.col("got").alias("budget"))
    mid = base.groupBy("domain", "language").agg(F.sum("cap").alias("cap"), F.first("w_language").alias("w")).join(top, "domain")
    mid = _filled(mid, ["domain"], "language", "budget").select("domain", "language", F.col("got").alias("budget"))
    low = base.withColumn("w", F.col("w_source")).join(mid, ["domain", "language"])
    return _filled(low, ["domain", "language"], "source", "budget").select("domain", "language", "source", "n_docs", "n_tokens", "got")


def mix(df: DataFrame, domain: Column, weights: dict[str, dict[str, int]], default: int = 10, share: float = 0.5, epochs: int = 4, seed: str = "0", key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, domain, language, source, epoch, n_tokens, token_start, take_tokens): a row for each document and epoch selected.

    token_start counts within the leaf; of the last document of a leaf take_tokens may be less than n_tokens."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    docs = df.select(F.col(f"`{key}`").alias("key"), name(domain).alias("domain"), name(F.col(f"`{lang}`")).alias("language"), name(F.col(f"`{source}`")).alias("source"), tokens(text).alias("n_tokens"))
    docs = saved(docs)  # texts are read once
    leaf = ["domain", "language", "source"]
    leaves = saved(budgets(docs.groupBy(*leaf).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), weights, default, share, epochs))
    plan = leaves.where("got > 0").select(F.struct(*leaf).alias("_leaf"), "got", F.col("n_tokens").alias("per_epoch"), (1 + F.expr(f"n_docs DIV {BUCKET_DOCS}")).alias("buckets"))
    rows = docs.where("n_tokens > 0").withColumn("leaf", F.struct(*leaf))
    if leaves.count() <= LEAVES_MOST:
        rows = rows.join(F.broadcast(plan), rows["leaf"] == plan["_leaf"])
    else:
        rows = graph.spread(rows, plan, "leaf", "_leaf", "inner")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (got - 1) DIV per_epoch)")))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col("key"))), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("order", order).withColumn("bucket", F.shiftright(F.shiftright("order", 28) * F.col("buckets"), 32))
    rows = rows.select("key", *leaf, "n_tokens", "got", "per_epoch", "epoch", "order", "bucket")
    at = [*leaf, "epoch", "bucket"]
    before = Window.partitionBy(*leaf, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*at).agg(F.sum("n_tokens").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*at).orderBy("order", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(sums, at).withColumn("token_start", F.col("epoch") * F.col("per_epoch") + F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = out.where("token_start < got").withColumn("take_tokens", F.least("n_tokens", F.col("got") - F.col("token_start")))
    return out.select(F.col("key").alias(key), *leaf, "epoch", "n_tokens", "token_start", "take_tokens")


def select(df: DataFrame, key: str = "doc_id", **kind) -> DataFrame:
    """The documents of df that are selected, whole and with all their columns, once for each epoch that selects them.

    Rows that share a key are selected together, each as often as the most often selected one."""
    k, e = free(df, "k"), free(df, "e")
    chosen = mix(df, key=key, **kind).groupBy(F.col(f"`{key}`").alias(k)).agg(F.max("epoch").alias(e))
    rows = df.join(chosen, df[f"`{key}`"].eqNullSafe(chosen[k]))
    return rows.withColumn(e, F.explode(F.sequence(F.lit(0).cast("long"), e))).drop(k, e)


def oracle(weights: dict[str, dict[str, int]], default: int, share: float, epochs: int, seed: str, domain_sql: str) -> str:
    """The same in DuckDB SQL over `documents`."""

    def weight(c: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {w}" for k, w in sorted(weights.get(c, {}).items())) + f" ELSE {default} END" if weights.get(c) else str(default)

    def filled(src: str, parent: str, child: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"{by} ORDER BY cap / w, {child}"
        return f"""(SELECT * EXCLUDE (lft, w_from, is_full, used, open_w), CASE WHEN is_full THEN cap ELSE ((budget - used) * w) // greatest(open_w, 1) END AS got FROM
          (SELECT *, CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS BIGINT) AS used, CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS BIGINT) AS open_w FROM
            (SELECT *, cap * w_from <= lft * w AS is_full FROM
              (SELECT *, budget - CAST(coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
                CAST(sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_from FROM {src}))))"""

    return f"""WITH docs AS (SELECT doc_id, coalesce({domain_sql}, '{NONE}') AS "domain", coalesce(lang, '{NONE}') AS "language", coalesce(source, '{NONE}') AS "source",
        CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens FROM documents),
      leaves AS (SELECT "domain", "language", "source", CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM docs GROUP BY ALL),
      base AS (SELECT *, n_tokens * {epochs} AS cap, {weight("domain")} AS w_d, {weight("language")} AS w_l, {weight("source")} AS w_s FROM leaves WHERE n_tokens > 0),
      usable AS (SELECT * FROM base WHERE w_d > 0 AND w_l > 0 AND w_s > 0),
      total AS (SELECT CAST(floor(sum(n_tokens) * {share}) AS BIGINT) AS budget FROM leaves),
      top AS (SELECT "domain", CAST(sum(cap) AS BIGINT) AS cap, first(w_d) AS w, (SELECT budget FROM total) AS budget FROM usable GROUP BY 1),
      topf AS (SELECT "domain", got AS budget FROM {filled("top", "", '"domain"')}),
      mid AS (SELECT s."domain", "language", CAST(sum(cap) AS BIGINT) AS cap, first(w_l) AS w, first(budget) AS budget FROM usable s JOIN topf USING ("domain") GROUP BY 1, 2),
      midf AS (SELECT "domain", "language", got AS budget FROM {filled("mid", '"domain"', '"language"')}),
      low AS (SELECT s."domain", s."language", "source", n_tokens AS per_epoch, cap, w_s AS w, budget FROM usable s JOIN midf m ON s."domain" = m."domain" AND s."language" = m."language"),
      plan AS (SELECT * FROM {filled("low", '"domain", "language"', '"source"')} WHERE got > 0),
      rep AS (SELECT d.*, p.got, p.per_epoch, unnest(range(0, (p.got - 1) // p.per_epoch + 1)) AS epoch FROM docs d JOIN plan p USING ("domain", "language", "source") WHERE d.n_tokens > 0),
      ord AS (SELECT *, md5(concat_ws(':', '{seed}', epoch, doc_id))[1:15] AS o FROM rep),
      pre AS (SELECT *, epoch * per_epoch + CAST(coalesce(sum(n_tokens) OVER (PARTITION BY "domain", "language", "source", epoch ORDER BY o, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_start FROM ord)
      SELECT doc_id, "domain", "language", "source", epoch, n_tokens, token_start, least(n_tokens, got - token_start) AS take_tokens FROM pre WHERE token_start < got"""
