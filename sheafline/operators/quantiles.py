"""Exact quantiles that no single task has to hold.

The target ranks are located by counting, at every size alike:

1. count rows per bin of a fixed, order-preserving bin function, and find the bin of each rank;
2. cut those bins into 65,536 equal parts, count again, and find the part of each rank;
3. count the distinct values that are left and read the ranks off.

Every step is a partial aggregate over bins, so a value, or a group, that holds a third of the
table costs no more than any other, and no row is shuffled as itself. The result is exact: bins
only decide which rows are looked at next. A step is one scan for all metrics and all probabilities: the metrics of a row
become rows of ``(metric, value)`` that are counted where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.columns import column
from sheafline.session import cut_lineage

# Located bins are broadcast up to this many rows; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
BINS_PER_OCTAVE = 1024
# Above every finite number's bin; infinities go here.
TOP_BIN = 2_000_000
PARTS = 65_536


def _between(low: Column, high: Column, fraction: Column) -> Column:
    """Linear interpolation; equal neighbours, infinities included, give themselves."""
    return F.when(low == high, low).otherwise(low * (1 - fraction) + high * fraction)


def _bin(value: Column) -> Column:
    size = F.log2(F.lit(1.0) + F.abs(value)) * BINS_PER_OCTAVE
    bin_of_size = F.when(size < TOP_BIN, F.floor(size)).otherwise(F.lit(TOP_BIN)).cast("long")
    return F.when(value < 0, -bin_of_size - 1).otherwise(bin_of_size)


def _part(value: Column, low: Column, high: Column) -> Column:
    width = high - low
    inside = F.floor((value - low) / width * F.lit(float(PARTS - 1)))
    ends = F.when(value == low, F.lit(0)).otherwise(F.lit(PARTS - 1))
    return F.when((width > 0) & (width < F.lit(float("inf"))), inside).otherwise(ends).cast("long")


def _targets(total: Column, probabilities: Sequence[float]) -> Column:
    """Both neighbours of each wanted position, as (rank, slot)."""
    wanted = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (total - 1)
        for side, rank in enumerate((F.floor(position), F.ceil(position))):
            wanted.append(F.struct(rank.cast("long").alias("rank"), F.lit(2 * i + side).alias("slot")))
    return F.array(*wanted)


def _locate(counted: DataFrame, groups: list[str], order: str) -> DataFrame:
    """The rows of ``counted`` (``rows``, ``_targets``) that hold a target rank, ranks made relative."""
    running = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counted.withColumn("_before", F.sum("rows").over(running) - F.col("rows"))
    inside = F.filter(
        "_targets", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("rows"))
    )
    located = reached.withColumn("_targets", inside).filter(F.size("_targets") > 0)
    relative = F.transform(
        "_targets", lambda t: F.struct((t["rank"] - F.col("_before")).alias("rank"), t["slot"].alias("slot"))
    )
    return located.withColumn("_targets", relative).drop("_before").withColumnRenamed("rows", "_rows")


def _same(keys: Sequence[str], right: DataFrame) -> Column:
    """Equality of group keys, NULL keys included."""
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _settled(located: DataFrame, grouped: bool) -> tuple[DataFrame, list]:
    """Located intervals, computed once. Without groups they are a few per metric and probability and come to the driver, as rows too."""
    if grouped:
        return cut_lineage(located), []
    rows = located.collect()
    return located.sparkSession.createDataFrame(rows, located.schema), rows


def exact_quantiles(
    df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles with linear interpolation: rows ``(*by, metric, total, quantiles ARRAY<DOUBLE>)``, one for each group and metric
    that has values."""
    names = [f"_k{i}" for i in range(len(by))]
    keys = [column(b).alias(n) for b, n in zip(by, names)]
    if len(values) == 1:
        base = df.select(*keys, F.lit(0).alias("_metric"), *[v.alias("value") for v in values.values()])
    else:
        cells = [F.struct(F.lit(i).alias("_metric"), v.alias("value")) for i, v in enumerate(values.values())]
        base = df.select(*keys, F.inline(F.array(*cells)))
    base = base.filter(F.col("value").isNotNull())
    groups = ["_metric", *names]

    def narrowed(located: DataFrame, held: list, low: str, high: str, carried: list[str]) -> DataFrame:
        """The values inside the located intervals beside the interval's columns."""
        if not names:
            # A few intervals per metric: constants of the scan's filter.
            return _inside(base, held, low, high, carried)
        rows = base.withColumn("_weight", F.lit(1).cast("long")).withColumn("_bin", _bin(F.col("value")))
        broadcast = located.count() <= BROADCAST_ROWS
        if not broadcast:
            # Too many groups to broadcast: count equal values first, so that the copies of
            # one value do not travel.
            rows = rows.groupBy(*groups, "_bin", "value").agg(F.sum("_weight").alias("_weight"))
        known = located.drop("_targets", "_total")
        joined = rows.alias("l").join((F.broadcast(known) if broadcast else known).alias("r"), _same([*groups, "_bin"], known))
        kept = [F.col(f"l.{n}") for n in groups] + [F.col("l.value"), F.col("l._weight")]
        extra = [F.col(f"r.{c}") for c in dict.fromkeys([*carried, low, high])]
        return joined.select(*kept, *extra).filter(F.col("value").between(F.col(low), F.col(high)))

    spread = base.groupBy(*groups, _bin(F.col("value")).alias("_bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    total = F.sum("rows").over(Window.partitionBy(*groups))
    coarse = spread.withColumn("_total", total).withColumn("_targets", _targets(F.col("_total"), probabilities))
    first, held = _settled(_locate(coarse, groups, "_bin"), bool(names))

    cut = narrowed(first, held, "_low", "_high", ["_bin"]).groupBy(
        *groups, "_bin", _part(F.col("value"), F.col("_low"), F.col("_high")).alias("_part")).agg(
        F.sum("_weight").alias("rows"), F.min("value").alias("_from"), F.max("value").alias("_to"))
    fine = _with_targets(cut, first, [*groups, "_bin"])
    second, held = _settled(_locate(fine, [*groups, "_bin"], "_part"), bool(names))

    singles = narrowed(second, held, "_from", "_to", ["_bin", "_part"]).groupBy(*groups, "_bin", "_part", "value").agg(
        F.sum("_weight").alias("rows"))
    last = [*groups, "_bin", "_part"]
    found = _locate(_with_targets(singles, second, last), last, "value")
    slots = found.select(*groups, "_total", "value", F.explode("_targets.slot").alias("slot"))
    # Two slots per probability: a handful of rows per group.
    picked = slots.groupBy(*groups).agg(
        F.first("_total").alias("total"), F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_at")
    )
    results = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.element_at("_at", F.lit(2 * i)), F.element_at("_at", F.lit(2 * i + 1))
        results.append(_between(low, high, position - F.floor(position)))
    return picked.select(
        *[F.col(n).alias(b) for b, n in zip(by, names)],
        F.get(F.array(*[F.lit(m) for m in values]), F.col("_metric")).alias("metric"),
        "total",
        F.array(*results).alias("quantiles"),
    )


def _inside(base: DataFrame, intervals: list, low: str, high: str, carried: list[str]) -> DataFrame:
    """Rows inside constant intervals of their metric, with the columns of their interval."""
    names = list(dict.fromkeys([*carried, low, high]))
    case, anywhere = F.lit(None).cast(f"struct<{','.join(f'{n}:{_kind(n, low, high)}' for n in names)}>"), F.lit(False)
    # Intervals of a metric are disjoint, so at most one holds a value.
    for r in intervals:
        holds = (F.col("_metric") == r["_metric"]) & F.col("value").between(r[low], r[high])
        case = F.when(holds, F.struct(*[F.lit(r[n]).cast(_kind(n, low, high)).alias(n) for n in names])).otherwise(case)
        anywhere = anywhere | holds
    inside = base.filter(anywhere).select("_metric", "value", F.lit(1).cast("long").alias("_weight"), case.alias("_i"))
    return inside.select("_metric", "value", "_weight", "_i.*")


def _kind(name: str, low: str, high: str) -> str:
    return "double" if name in (low, high) else "bigint"


def _with_targets(counted: DataFrame, located: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of located intervals beside the ranks wanted in them."""
    wanted = located.select(*keys, "_targets", "_total").alias("r")
    joined = counted.alias("l").join(wanted, _same(keys, located))
    return joined.select("l.*", "r._targets", "r._total")
