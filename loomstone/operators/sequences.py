"""Order-dependent operators: carry-forward, as-of, gaps, buffers, segments and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def _by(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The latest non-null value up to each row."""
    w = _by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """Each left row with the latest right value at or before it: a union, sorted once, and a carry-forward.

    Of right rows at the same place the one with the greatest `tie` counts. Left rows before the
    first right row get null.
    """
    a = left.withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_tie", F.lit(None).cast(dict(right.dtypes)[tie]))
    b = right.select(*keys, at, F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.col(tie).alias("_tie"))
    both = carried(a.unionByName(b, allowMissingColumns=True), keys, [at, "_kind", "_tie"], "_v", "_asof")
    return both.where("_kind = 1").drop("_kind", "_v", "_tie").withColumnRenamed("_asof", value)


def gap_groups(rows: DataFrame, keys: list[str], order: list[str], value: str, gap: float, out: str = "grp") -> DataFrame:
    """Number runs of sorted values whose neighbours are at most `gap` apart, from 0."""
    w = _by(keys, order)
    new = F.when(F.abs(F.col(value) - F.lag(value).over(w)) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def buffered(rows: DataFrame, keys: list[str], order: list[str], text: str, around: int, out: str = "context") -> DataFrame:
    """Texts of the rows around each row, joined with blanks."""
    w = _by(keys, order).rowsBetween(-around, around)
    return rows.withColumn(out, F.concat_ws(" ", F.collect_list(text).over(w)))


def thresholds(distances: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Breakpoint thresholds of each group: percentile 95, mean + 3 deviations, mean + 1.5 interquartile ranges."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    got = distances.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.95)).alias("by_percentile"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"), quartiles.alias("q")
    )
    return got.select(*keys, "by_percentile", (F.col("mean") + 3 * F.col("dev")).alias("by_deviation"), (F.col("mean") + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("by_range"))


#: The usual amount of each kind of breakpoint threshold.
BREAKPOINTS = {"percentile": 95.0, "standard_deviation": 3.0, "interquartile": 1.5, "gradient": 95.0}


def threshold_of(distances: DataFrame, keys: list[str], order: list[str], value: str, kind: str = "percentile", amount: float | None = None) -> DataFrame:
    """`(*keys, limit)`: a group's breakpoint threshold of one of the kinds; an unknown kind is an error.

    Of the gradients' percentile the threshold is compared with the gradients, of the others with
    the distances. A group of one distance has no gradient and no threshold.
    """
    if kind not in BREAKPOINTS:
        raise ValueError(f"unknown kind of threshold: {kind!r}")
    a, x = BREAKPOINTS[kind] if amount is None else amount, F.col(value)
    rows = distances.where(x.isNotNull())
    if kind == "gradient":
        rows, x = gradient(rows, keys, order, value, "_g"), F.col("_g")
    limit = {
        "percentile": lambda: F.percentile(x, F.lit(a / 100)), "gradient": lambda: F.percentile(x, F.lit(a / 100)),
        "standard_deviation": lambda: F.avg(x) + a * F.stddev_pop(x), "interquartile": lambda: F.avg(x) + a * (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))),
    }[kind]()
    return rows.groupBy(*keys).agg(limit.alias("limit"))


def gradient(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends; null for a single row."""
    w = _by(keys, order)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)
    return rows.withColumn(out, g)


def interpolated(sorted_values: Column, share: Column) -> Column:
    """Linear percentile at a share that may differ by row."""
    h = share * (F.size(sorted_values) - 1)
    low = F.get(sorted_values, F.floor(h).cast("int"))
    return low + (h - F.floor(h)) * (F.get(sorted_values, F.ceil(h).cast("int")) - low)


def threshold_for_count(distances: DataFrame, keys: list[str], value: str, n_chunks: int) -> DataFrame:
    """The threshold that leaves about `n_chunks` chunks: the share falls linearly from 1 at one chunk to 0 at as many as distances."""
    got = distances.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"))
    n = F.size("v")
    wanted = F.greatest(F.least(F.lit(float(n_chunks)), n.cast("double")), F.lit(1.0))
    share = F.when(n <= 1, F.lit(1.0)).otherwise(1 - (wanted - 1) / (n - 1))
    return got.select(*keys, interpolated(F.col("v"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("by_count"))


def segments(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, out: str = "segment") -> DataFrame:
    """Number segments from 0; a break closes the segment after its row."""
    w = _by(keys, order).rowsBetween(*_BEFORE)
    return rows.withColumn("_b", F.when(breaks, 1).otherwise(0)).withColumn(out, F.coalesce(F.sum("_b").over(w), F.lit(0)).cast("int")).drop("_b")


def offsets(rows: DataFrame, keys: list[str], order: list[str], text: str, out: str = "start_index") -> DataFrame:
    """Sum of the lengths of the rows before."""
    w = _by(keys, order).rowsBetween(*_BEFORE)
    return rows.withColumn(out, F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))


def nearest_centre(x: Column, centres: list[float]) -> Column:
    """Index of the nearest centre, the first of equal ones."""
    options = F.array(*[F.struct(F.abs(x - F.lit(float(c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(options)["i"]


def last_wins(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Per key the value that was written last."""
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def batch_of(rows: DataFrame, order: list[str], size: int, index: int) -> DataFrame:
    """The batch of a 1-based number of the ordered rows; a number outside 1..ceil(n/size) is an error."""
    n = rows.count()
    if not 1 <= index <= max(1, -(-n // size)):
        raise ValueError(f"batch {index} is outside 1..{-(-n // size)}")
    return rows.orderBy(*order).offset((index - 1) * size).limit(size)


def window_of_history(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The latest rows of each key, at most so many."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")
