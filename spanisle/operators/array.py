"""N-dimensional arrays as DataFrames: a row for each cell that is not empty, dimensions as BIGINT columns without nulls."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions
from ..plans.tokens import QuerySyntaxError, join, split, tokenize

#: Array types and the SQL types they stand for.
TYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float": "float", "double": "double", "string": "string", "char": "string", "datetime": "timestamp_ntz", "datetimetz": "timestamp"}
CELLS_MOST = 10_000


class ArrayError(ValueError):
    """A schema or cell doesn't fit."""


@dataclass(frozen=True)
class Dimension:
    name: str
    low: int = 0
    high: int | None = None
    chunk: int | None = None
    overlap: int = 0


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class ArraySchema:
    attributes: tuple[Attribute, ...]
    dimensions: tuple[Dimension, ...]

    @property
    def dims(self) -> list[str]:
        return [d.name for d in self.dimensions]

    @property
    def attrs(self) -> list[str]:
        return [a.name for a in self.attributes]

    def __str__(self) -> str:
        dims = ",".join(f"{d.name}={d.low}:{'*' if d.high is None else d.high},{d.chunk or 1000000},{d.overlap}" for d in self.dimensions)
        return f"<{','.join(f'{a.name}:{a.type}' + ('' if a.nullable else ' NOT NULL') for a in self.attributes)}>[{dims}]"


def parse_schema(text: str) -> ArraySchema:
    """`<name:type [NULL | NOT NULL], ...>[name=low:high,chunk,overlap, ...]`; high may be *."""
    t = text.strip()
    if not (t.startswith("<") and ">" in t and t.endswith("]")):
        raise QuerySyntaxError(f"not an array schema: {text}")
    head, tail = t[1:].split(">", 1)
    attrs = []
    for item in split(tokenize(head)):
        words = [x.text for x in item]
        if len(words) < 3 or words[1] != ":":
            raise QuerySyntaxError(f"not an attribute: {join(item)}")
        rest = [w.lower() for w in words[3:]]
        attrs.append(Attribute(words[0], words[2].lower(), "not" not in rest))
    dims, fields = [], [f.strip() for f in tail.strip()[1:-1].split(",") if f.strip()]
    for f in fields:
        if "=" in f:
            name, span = f.split("=")
            low, high = (span.split(":") + ["*"])[:2]
            dims.append(Dimension(name.strip(), int(low), None if high.strip() == "*" else int(high)))
        elif not dims:
            dims.append(Dimension(f))
        elif dims[-1].chunk is None and f.lstrip("-").isdigit():
            dims[-1] = replace(dims[-1], chunk=int(f))
        elif f.lstrip("-").isdigit():
            dims[-1] = replace(dims[-1], overlap=int(f))
        else:
            dims.append(Dimension(f))
    if not dims or not attrs and not dims:
        raise QuerySyntaxError("an array has a dimension at least")
    return ArraySchema(tuple(attrs), tuple(dims))


@dataclass(frozen=True)
class Array:
    df: DataFrame
    schema: ArraySchema

    def renamed(self, dims: list[Dimension], attrs: list[Attribute], df: DataFrame) -> Array:
        schema = ArraySchema(tuple(attrs), tuple(dims))
        return Array(df.select(*(F.col(f"`{c}`") for c in schema.dims + schema.attrs)), schema)


def _type_of(kind: str) -> str:
    back = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "timestamp_ntz": "datetime", "timestamp": "datetimetz", "date": "datetime"}
    return back.get(kind, "double" if kind.startswith("decimal") else "string")


def flat(df: DataFrame, name: str = "i") -> Array:
    """A relation as a one-dimensional array; rows are numbered from 0 in the order of their columns."""
    attrs = tuple(Attribute(f.name, _type_of(f.dataType.simpleString()), f.nullable) for f in df.schema.fields)
    return Array(numbered(df, name, []), ArraySchema(attrs, (Dimension(name),)))


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """df with a dense number from 0 in the given order, or in that of its columns, without a sort in one task.

    Rows are dealt by ranges of the order and checkpointed once, since range bounds are sampled anew in each run; then they are
    counted for each partition, and the counts, a row for each partition, make offsets."""
    cols = df.columns
    plain = all(f.dataType.typeName() not in ("map", "variant") for f in df.schema.fields)
    order = order or ([F.col(f"`{c}`").asc_nulls_last() for c in cols] if plain else [F.xxhash64(F.to_json(F.struct("*")))])
    df = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    marked = cut(df.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    counts = marked.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = marked.join(F.broadcast(counts.select("_p", "_m0", before.alias("_before"))), "_p")
    out = out.withColumn(name, (F.col("_m") - F.col("_m0") + F.col("_before")).cast("bigint"))
    return out.select(name, *(F.col(f"`{c}`") for c in cols))


def to_array(df: DataFrame, schema: ArraySchema | str, collisions: str = "error") -> Array:
    """A relation as an array: columns are matched by name, cast, and range-checked.

    Cells that meet are an error, or give the row with the least or greatest attributes ("min", "max"), or get a last
    dimension that numbers them ("synthetic")."""
    schema = parse_schema(schema) if isinstance(schema, str) else schema
    have = {c.lower(): c for c in df.columns}
    if len(schema.dims) == 1 and schema.dims[0].lower() not in have:
        df = numbered(df, schema.dims[0], [])
        have = {c.lower(): c for c in df.columns}
    missing = [n for n in schema.dims + schema.attrs if n.lower() not in have]
    if missing:
        raise ArrayError(f"no column for {', '.join(missing)}")
    cols = []
    for d in schema.dimensions:
        c = F.col(f"`{have[d.name.lower()]}`").cast("bigint")
        bad = c.isNull() | (c < d.low) | (c > d.high if d.high is not None else F.lit(False))
        # in the projection: as a filter it would be inferred for the other side of a join on the dimension
        cols.append(F.when(bad, F.raise_error(F.concat(F.lit(f"dimension {d.name} is null or out of range: "), F.coalesce(c.cast("string"), F.lit("null"))))).otherwise(c).alias(d.name))
    for a in schema.attributes:
        c = F.col(f"`{have[a.name.lower()]}`")
        kind = TYPES.get(a.type, a.type)
        c = F.date_trunc("second", c.cast("timestamp_ntz")).cast(kind) if a.type.startswith("datetime") else c.cast(kind)
        cols.append(c.alias(a.name))
    df = df.select(*cols)
    if collisions == "synthetic":
        w = Window.partitionBy(*schema.dims).orderBy(*schema.attrs)
        df = df.withColumn("synthetic", (F.row_number().over(w) - 1).cast("bigint"))
        return Array(df, ArraySchema(schema.attributes, (*schema.dimensions, Dimension("synthetic"))))
    if collisions == "error":
        # one value each, so numbers stay in a hash aggregate
        one = df.groupBy(*schema.dims).agg(F.count("*").alias("_n"), *(F.first(F.col(f"`{a}`")).alias(a) for a in schema.attrs))
        alone = F.when(F.col("_n") > 1, F.raise_error(F.lit("two rows meet in one cell"))).otherwise(F.lit(True))
        return Array(one.where(alone).drop("_n"), schema)
    if collisions not in ("min", "max"):
        raise ArrayError(f"no rule is named {collisions}")
    pick = F.struct(*schema.attrs) if schema.attrs else F.struct(F.lit(1).alias("_one"))
    df = df.groupBy(*schema.dims).agg((F.min if collisions == "min" else F.max)(pick).alias("_cell"))
    return Array(df.select(*schema.dims, *(F.col(f"_cell.`{a}`").alias(a) for a in schema.attrs)), schema)


def from_array(a: Array, mode: str = "full") -> DataFrame:
    """The relation of an array: dimensions then attributes, or attributes alone ("flat")."""
    names = a.schema.attrs if mode == "flat" else a.schema.dims + a.schema.attrs
    return a.df.select(*(F.col(f"`{n}`") for n in names))


def project(a: Array, *attrs: str) -> Array:
    keep = [x for n in attrs for x in a.schema.attributes if x.name.lower() == n.lower()]
    if len(keep) < len(attrs):
        raise ArrayError("project takes attributes of the array")
    return a.renamed(list(a.schema.dimensions), keep, a.df)


def filter_(a: Array, condition: str) -> Array:
    return Array(a.df.where(condition), a.schema)


def apply(a: Array, *pairs: tuple[str, str]) -> Array:
    df, attrs = a.df, list(a.schema.attributes)
    for name, text in pairs:
        df = df.withColumn(name, F.expr(text))
        attrs.append(Attribute(name, _type_of(df.schema[name].dataType.simpleString())))
    return a.renamed(list(a.schema.dimensions), attrs, df)


def redimension(a: Array, schema: ArraySchema | str, collisions: str = "error") -> Array:
    return to_array(a.df, schema, collisions)


#: Array aggregates as SQL over a column.
AGGREGATES = {
    "count": "count({})", "sum": "sum({})", "avg": "avg({})", "min": "min({})", "max": "max({})", "var": "var_samp({})", "stdev": "stddev_samp({})",
    "median": "median({})", "prod": "product({})", "approxdc": "approx_count_distinct({})", "first_value": "min_by({}, {order})", "last_value": "max_by({}, {order})",
    "mad": "median(abs({} - {median}))", "quantile": "percentile({}, {p})",
}


def _aggregate_column(fn: str, arg: str, order: list[str]) -> Column:
    fn = fn.lower()
    if fn not in AGGREGATES or fn == "mad":
        raise ArrayError(f"no aggregate is named {fn}")
    if fn == "quantile":
        arg, _, p = arg.partition(",")
        return F.percentile(F.col(f"`{arg.strip()}`"), float(p or 0.5))
    if fn == "prod":
        return F.product(F.col(f"`{arg}`"))
    return F.expr(AGGREGATES[fn].format(arg if arg == "*" else f"`{arg}`", order=f"struct({', '.join(order)})"))


def _quantiles(df: DataFrame, names: list[str], arg: str, name: str) -> DataFrame:
    """The quantile of an attribute for each group, low + (high - low) * fraction between the two values about its place, as SQL has
    it; `percentile` weighs the two and rounds otherwise."""
    arg, _, p = arg.partition(",")
    p = float(p or 0.5)
    if not 0 <= p <= 1:
        raise ArrayError("a quantile is from 0 to 1")
    counts = df.select(*names, F.col(f"`{arg.strip()}`").cast("double").alias("_v")).where("_v is not null").groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*names)
    at = (F.sum("_n").over(group) - 1) * F.lit(p)
    placed = counts.select(*names, "_v", "_n", F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), at.alias("_at"))
    value = lambda place: F.max(F.when((place >= F.col("_upto") - F.col("_n")) & (place < F.col("_upto")), F.col("_v")))
    found = placed.groupBy(*names).agg(value(F.floor("_at")).alias("_low"), value(F.ceil("_at")).alias("_high"), F.max(F.col("_at") - F.floor("_at")).alias("_part"))
    q = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
    return found.select(*names, q.alias(name))


def aggregate(a: Array, calls: list[tuple[str, str, str]], by: list[str]) -> Array:
    """calls of (function, attribute or *, name), grouped by dimensions; without dimensions one cell at i = 0.  approxdc counts exactly."""
    dims = [d for n in by for d in a.schema.dimensions if d.name.lower() == n.lower()]
    if len(dims) < len(by):
        raise ArrayError("aggregate groups by dimensions of the array")
    names = [d.name for d in dims]
    df = a.df
    for fn, arg, _ in calls:
        if fn.lower() == "mad":  # the median of distances from the median needs the median first
            w = df.groupBy(*names).agg(F.median(F.col(f"`{arg}`")).alias(f"_median_{arg}"))
            df = df.join(w, names) if names else df.crossJoin(F.broadcast(w))  # one row
    def column(fn: str, arg: str) -> Column:
        if fn.lower() == "mad":
            return F.median(F.abs(F.col(f"`{arg}`") - F.col(f"`_median_{arg}`")))
        return F.count_distinct(F.col(f"`{arg}`")) if fn.lower() == "approxdc" else _aggregate_column(fn, arg, a.schema.dims)

    apart = [_quantiles(df, names, arg, name) for fn, arg, name in calls if fn.lower() == "quantile"]
    cols = [column(fn, arg).alias(name) for fn, arg, name in calls if fn.lower() != "quantile"]
    df = df.groupBy(*names).agg(*cols) if cols else df.groupBy(*names).agg(F.lit(0).alias("_none"))
    for q in apart:  # a group whose values are all null has none
        df = df.join(q, names, "left") if names else df.crossJoin(F.broadcast(q))  # one row
    df = df.select(*names, *(f"`{name}`" for _, _, name in calls))
    if not dims:
        dims, df = [Dimension("i", 0, 0)], df.withColumn("i", F.lit(0).cast("bigint"))
    attrs = [Attribute(name, _type_of(df.schema[name].dataType.simpleString())) for _, _, name in calls]
    return a.renamed(dims, attrs, df)


def cross_join(a: Array, b: Array, left: str, right: str, pairs: list[tuple[str, str]]) -> Array:
    """Cells that agree on pairs of dimensions (a.d, b.d); all of a's dimensions, then b's others.  Names that clash get the alias."""
    taken = {n.lower() for n in a.schema.dims + a.schema.attrs}
    matched = {y.lower() for _, y in pairs}
    name = lambda n: f"{right}_{n}" if n.lower() in taken else n
    r = b.df.select(*(F.col(f"`{n}`").alias(f"_r_{n}") for n in b.schema.dims + b.schema.attrs))
    on = [F.col(f"`{x}`") == F.col(f"`_r_{next(d for d in b.schema.dims if d.lower() == y.lower())}`") for x, y in pairs]
    df = a.df.join(r, on, "inner") if on else a.df.crossJoin(r)
    dims = [d for d in b.schema.dimensions if d.name.lower() not in matched]
    df = df.select("*", *(F.col(f"`_r_{n}`").alias(name(n)) for n in [d.name for d in dims] + b.schema.attrs))
    return a.renamed([*a.schema.dimensions, *(replace(d, name=name(d.name)) for d in dims)], [*a.schema.attributes, *(replace(x, name=name(x.name)) for x in b.schema.attributes)], df)


#: Aggregates that pass over nulls and can be framed.
_FRAMED = ("sum", "count", "avg", "min", "max", "var", "stdev")


def window(a: Array, bounds: list[tuple[int, int]], calls: list[tuple[str, str, str]]) -> Array:
    """For each cell the aggregate of its neighbourhood: `low` cells before to `high` cells after, for each dimension.

    With one dimension bounded it is a range frame.  With more, each cell goes to all centres it can reach along all of them but
    the widest, along which a range frame over cells and centres does the rest.  Aggregates that need the cells' order or all their
    values take each cell to all centres, a product of the bounds that is limited to CELLS_MOST.  Centres that hold no cell are dropped."""
    dims = a.schema.dims
    if len(bounds) != len(dims):
        raise ArrayError("window takes two bounds for each dimension")
    wide = [i for i, b in enumerate(bounds) if b != (0, 0)]
    attrs = []
    if len(wide) <= 1:
        i = wide[0] if wide else 0
        df, by, own = _along(a.df, [d for j, d in enumerate(dims) if j != i], dims[i], *bounds[i])
        w = Window.partitionBy(*by).orderBy(dims[i]).rangeBetween(-bounds[i][0], bounds[i][1])
        df = df.select("*", *(_aggregate_column(fn, arg, dims).over(w).alias(name) for fn, arg, name in calls)).where(own)
    elif all(fn.lower() in _FRAMED for fn, _, _ in calls):
        last = max(wide, key=lambda i: sum(bounds[i]))
        cells, one = a.df.withColumn("_cell", F.lit(1)), F.col("_cell")
        for i in wide:
            if i != last:
                cells = cells.withColumn(dims[i], F.explode(F.sequence(F.col(f"`{dims[i]}`") - bounds[i][1], F.col(f"`{dims[i]}`") + bounds[i][0])))
        need = sorted({arg for _, arg, _ in calls if arg != "*"})
        cells = cells.select(*dims, *need, "_cell").unionByName(a.df.select(*dims), allowMissingColumns=True)
        w = Window.partitionBy(*(d for i, d in enumerate(dims) if i != last)).orderBy(dims[last]).rangeBetween(-bounds[last][0], bounds[last][1])
        df = cells.select("*", *(_aggregate_column(fn, "_cell" if arg == "*" else arg, dims).over(w).alias(name) for fn, arg, name in calls)).where(one.isNull())
    else:
        size = 1
        for low, high in bounds:
            size *= low + high + 1
        if size > CELLS_MOST:
            raise ArrayError(f"a neighbourhood of {size} cells is more than {CELLS_MOST}")
        need = sorted({arg.partition(",")[0].strip() for _, arg, _ in calls if arg != "*"})
        cells = a.df.select(*dims, *need)
        for d, (low, high) in zip(dims, bounds, strict=True):
            if (low, high) != (0, 0):
                cells = cells.withColumn(d, F.explode(F.sequence(F.col(d) - high, F.col(d) + low)))
        df = cells.groupBy(*dims).agg(*(_aggregate_column(fn, arg, dims).alias(name) for fn, arg, name in calls))
        df = df.join(a.df.select(*dims), dims, "left_semi")
    for _, _, name in calls:
        attrs.append(Attribute(name, _type_of(df.schema[name].dataType.simpleString())))
    return a.renamed(list(a.schema.dimensions), attrs, df)


#: Cells along one dimension that one task takes where an array has no other dimension to be dealt by.
RUN = 1_000_000


def _along(df: DataFrame, by: list[str], place: str, low: int, high: int) -> tuple[DataFrame, list[str], Column]:
    """(df, columns to deal it by, rows that are results) for frames from `low` before to `high` after along a column.

    Without other columns to deal by, runs of the column are dealt, and rows near the ends of a run go to its neighbours too."""
    if by:
        return df, by, F.lit(True)
    size = max(RUN, low + high + 1)
    run = lambda shift: F.floor((F.col(f"`{place}`") + shift) / size)
    df = df.withColumn("_run", F.explode(F.array_distinct(F.array(run(-high), run(0), run(low)))))
    return df, ["_run"], F.col("_run") == run(0)


#: How running values of a run continue those of all runs before.
_CARRIED = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}


def cumulate(a: Array, calls: list[tuple[str, str, str]], dim: str | None = None) -> Array:
    """Running sums, counts, minima or maxima along a dimension (the first, if none is named), runs of it side by side."""
    dim = next((d for d in a.schema.dims if d.lower() == (dim or a.schema.dims[0]).lower()), None)
    if dim is None:
        raise ArrayError("cumulate goes along a dimension of the array")
    if bad := [fn for fn, _, _ in calls if fn.lower() not in _CARRIED]:
        raise ArrayError(f"cumulate knows no {bad[0]}")
    by = [d for d in a.schema.dims if d != dim]
    cells = a.df.withColumn("_run", F.floor(F.col(f"`{dim}`") / RUN))
    whole = cells.groupBy(*by, "_run").agg(*(_aggregate_column(fn, arg, [dim]).alias(f"_c{n}") for n, (fn, arg, _) in enumerate(calls)))
    before = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*by, "_run", *({"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[fn.lower()](f"_c{n}").over(before).alias(f"_b{n}") for n, (fn, _, _) in enumerate(calls)))
    within = Window.partitionBy(*by, "_run").orderBy(dim).rowsBetween(Window.unboundedPreceding, 0)
    df = cells.select("*", *(_aggregate_column(fn, arg, [dim]).over(within).alias(f"_c{n}") for n, (fn, arg, _) in enumerate(calls)))
    df = df.join(carry, [*by, "_run"])
    for n, (fn, _, name) in enumerate(calls):
        df = df.withColumn(name, _CARRIED[fn.lower()](F.col(f"_c{n}"), F.col(f"_b{n}")))
    return a.renamed(list(a.schema.dimensions), [Attribute(name, _type_of(df.schema[name].dataType.simpleString())) for _, _, name in calls], df)


def variable_window(a: Array, dim: str, left: int, right: int, calls: list[tuple[str, str, str]]) -> Array:
    """For each cell the aggregate of `left` cells that are not empty before it to `right` after it along a dimension."""
    by = [d for d in a.schema.dims if d.lower() != dim.lower()]
    if len(by) == len(a.schema.dims):
        raise ArrayError("variable_window goes along a dimension of the array")
    df, place = (a.df, dim) if by else (numbered(a.df, "_at", [F.col(f"`{dim}`")]), "_at")
    df, by, own = _along(df, by, place, left, right)
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(-left, right)
    df = df.select("*", *(_aggregate_column(fn, arg, a.schema.dims).over(w).alias(name) for fn, arg, name in calls)).where(own)
    return a.renamed(list(a.schema.dimensions), [Attribute(name, _type_of(df.schema[name].dataType.simpleString())) for _, _, name in calls], df)


def rank(a: Array, attr: str, by: list[str]) -> Array:
    """The attribute with its rank, from 1, among the cells that agree on the named dimensions; equal values share the least rank."""
    x = F.col(f"`{attr}`")
    if by:
        df = a.df.withColumn(f"{attr}_rank", F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last())).cast("bigint"))
    else:
        at = numbered(a.df.select(x.alias("_x")), "_at", [F.col("_x").asc_nulls_last()]).groupBy("_x").agg((F.min("_at") + 1).alias(f"{attr}_rank"))
        df = a.df.join(at, x.eqNullSafe(F.col("_x")))
    kind = next(t for t in a.schema.attributes if t.name.lower() == attr.lower())
    return a.renamed(list(a.schema.dimensions), [kind, Attribute(f"{attr}_rank", "int64", False)], df)


def substitute(a: Array, b: Array, attrs: list[str]) -> Array:
    """Nulls of the attributes (all, if none is named) become the first attribute of b's cell at 0."""
    one = b.df.where(F.col(f"`{b.schema.dims[0]}`") == 0).agg(F.first(F.col(f"`{b.schema.attrs[0]}`")).alias("_new"))  # one row
    df = a.df.crossJoin(F.broadcast(one))
    for x in attrs or a.schema.attrs:
        df = df.withColumn(x, F.coalesce(F.col(f"`{x}`"), F.col("_new").cast(a.df.schema[x].dataType)))
    return Array(df.drop("_new"), a.schema)


def thin(a: Array, steps: list[tuple[int, int]]) -> Array:
    """Every step-th cell from a start along each dimension, numbered from 0."""
    if len(steps) != len(a.schema.dims):
        raise ArrayError("thin takes a start and a step for each dimension")
    df = a.df
    for d, (start, step) in zip(a.schema.dims, steps, strict=True):
        at = F.col(f"`{d}`") - start
        df = df.where((at >= 0) & (at % step == 0)).withColumn(d, F.expr(f"(`{d}` - {start}) DIV {step}"))
    high = [None if d.high is None else (d.high - start) // step for d, (start, step) in zip(a.schema.dimensions, steps, strict=True)]
    return a.renamed([replace(d, low=0, high=h) for d, h in zip(a.schema.dimensions, high, strict=True)], list(a.schema.attributes), df)


def xgrid(a: Array, times: list[int]) -> Array:
    """Each cell repeated that often along each dimension."""
    if len(times) != len(a.schema.dims):
        raise ArrayError("xgrid takes a number for each dimension")
    df, dims = a.df, []
    for d, n in zip(a.schema.dimensions, times, strict=True):
        first = (F.col(f"`{d.name}`") - d.low) * n + d.low
        df = df.withColumn(d.name, F.explode(F.sequence(first, first + n - 1)))
        dims.append(replace(d, high=None if d.high is None else (d.high - d.low + 1) * n + d.low - 1))
    return a.renamed(dims, list(a.schema.attributes), df)


def reshape(a: Array, schema: ArraySchema | str) -> Array:
    """The cells under other dimensions, of as many cells in all, in the same order by the last dimension first."""
    schema = parse_schema(schema) if isinstance(schema, str) else schema
    size = lambda dims: [d.high - d.low + 1 for d in dims]
    if any(d.high is None for d in (*a.schema.dimensions[1:], *schema.dimensions[1:])):
        raise ArrayError("reshape needs bounds of all dimensions but the first")
    at = F.lit(0).cast("bigint")
    for d in a.schema.dimensions:
        at = at * (1 if d is a.schema.dimensions[0] else size([d])[0]) + F.col(f"`{d.name}`") - d.low
    df, rest = a.df.withColumn("_at", at), F.col("_at")
    for d in reversed(schema.dimensions[1:]):
        n = size([d])[0]
        df = df.withColumn(f"_d_{d.name}", rest % n + d.low).withColumn("_at", F.expr(f"_at DIV {n}"))
    df = df.withColumn(f"_d_{schema.dims[0]}", F.col("_at") + schema.dimensions[0].low)
    df = df.select(*(F.col(f"`_d_{d}`").alias(d) for d in schema.dims), *(F.col(f"`{x}`").alias(y) for x, y in zip(a.schema.attrs, schema.attrs, strict=True)))
    return Array(df, ArraySchema(a.schema.attributes, schema.dimensions))


def build(spark, schema: ArraySchema | str, expression: str) -> Array:
    """An array of bounded dimensions with one attribute, an expression of them."""
    schema = parse_schema(schema) if isinstance(schema, str) else schema
    if any(d.high is None for d in schema.dimensions) or len(schema.attrs) != 1:
        raise ArrayError("build takes one attribute and bounds of all dimensions")
    df = None
    for d in schema.dimensions:
        one = spark.range(d.low, d.high + 1).withColumnRenamed("id", d.name)
        df = one if df is None else df.crossJoin(one)
    kind = TYPES.get(schema.attributes[0].type, schema.attributes[0].type)
    return Array(df.select(*schema.dims, F.expr(expression).cast(kind).alias(schema.attrs[0])), schema)


def sort(a: Array, *attrs: str) -> Array:
    """Attributes in ascending order along a new dimension n from 0; ties follow the old dimensions."""
    df = numbered(a.df, "n", [F.col(f"`{x}`").asc_nulls_last() for x in attrs] + [F.col(f"`{d}`") for d in a.schema.dims])
    return a.renamed([Dimension("n")], list(a.schema.attributes), df)


def between(a: Array, low: list[int], high: list[int]) -> Array:
    if len(low) != len(a.schema.dims) or len(high) != len(low):
        raise ArrayError("between takes a low and a high bound for each dimension")
    cond = F.lit(True)
    for d, x, y in zip(a.schema.dims, low, high, strict=True):
        cond = cond & F.col(f"`{d}`").between(x, y)
    return Array(a.df.where(cond), a.schema)


def subarray(a: Array, low: list[int], high: list[int]) -> Array:
    out = between(a, low, high)
    df = out.df
    for d, x in zip(a.schema.dims, low, strict=True):
        df = df.withColumn(d, F.col(f"`{d}`") - x)
    return a.renamed([replace(d, low=0, high=y - x) for d, x, y in zip(a.schema.dimensions, low, high, strict=True)], list(a.schema.attributes), df)


def slice_(a: Array, at: list[tuple[str, int]]) -> Array:
    df, gone = a.df, {d.lower() for d, _ in at}
    for d, v in at:
        df = df.where(F.col(f"`{d}`") == v)
    return a.renamed([d for d in a.schema.dimensions if d.name.lower() not in gone], list(a.schema.attributes), df)


def regrid(a: Array, blocks: list[int], calls: list[tuple[str, str, str]]) -> Array:
    df = a.df
    for d, n in zip(a.schema.dimensions, blocks, strict=True):
        df = df.withColumn(d.name, F.expr(f"CAST(floor((`{d.name}` - {d.low}) / {n}) AS BIGINT) + {d.low}"))
    return aggregate(Array(df, a.schema), calls, a.schema.dims)


def merge(a: Array, b: Array) -> Array:
    """All cells of a, and those of b where a has none."""
    names = a.schema.dims + a.schema.attrs
    other = b.df.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(b.schema.dims + b.schema.attrs, names, strict=True)))
    return Array(a.df.select(*names).union(other.join(a.df.select(*a.schema.dims), a.schema.dims, "left_anti").select(*names)), a.schema)


def distinct(a: Array) -> Array:
    return flat(a.df.select(*(F.col(f"`{x}`") for x in a.schema.attrs)).distinct())


def uniq(a: Array) -> Array:
    """A one-dimensional array without cells whose first attribute equals that of the cell before; 1, 2, 1 keeps all three."""
    if len(a.schema.dims) != 1:
        raise ArrayError("uniq takes an array of one dimension")
    x = a.schema.attrs[0]
    df = numbered(a.df.select(*a.schema.dims, x), "_at", [F.col(f"`{a.schema.dims[0]}`")])
    before = df.select((F.col("_at") + 1).alias("_next"), F.col(f"`{x}`").alias("_before"))
    df = df.join(before, F.col("_at") == F.col("_next"), "left").where(F.col("_next").isNull() | ~F.col(f"`{x}`").eqNullSafe(F.col("_before")))
    return a.renamed([Dimension("i")], [a.schema.attributes[0]], numbered(df.select("_at", x), "i", [F.col("_at")]))


def transpose(a: Array) -> Array:
    return a.renamed(list(reversed(a.schema.dimensions)), list(a.schema.attributes), a.df)


def unpack(a: Array, name: str) -> Array:
    """One dimension of that name; the old dimensions become attributes."""
    df = numbered(a.df, name, [F.col(f"`{d}`") for d in a.schema.dims])
    return a.renamed([Dimension(name)], [*(Attribute(d, "int64", False) for d in a.schema.dims), *a.schema.attributes], df)
