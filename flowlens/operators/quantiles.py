"""Ranks and exact quantiles of groups of any size.

Equal values of a group are counted first. The counts are dealt out by ranges of (group, value) and summed by range; a row's
running count is its range's base and a running sum inside the range. So no task orders a whole group, and a group that holds most
rows is spread over most ranges. A table of no more rows than a range isn't dealt out: its groups are summed as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import keep


#: About how many rows a range has at most: a task's memory doesn't grow with the table.
RANGE_ROWS = 250_000


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def running_counts(counted: DataFrame, group: list[str], value: str, sums: list[str], kept: bool = False) -> DataFrame:
    """counted with <s>_before for each of sums: the sum of s over the group's rows of smaller value. counted has a row for each
    group and value, with sums as numbers. kept: it is a table already."""
    held = counted if kept else keep(counted, "counted")  # range bounds are sampled from it before it is dealt out
    usual, n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.count()
    if n <= RANGE_ROWS:  # all of it is one range at most, so each group is one
        before = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return held.select(*counted.columns, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums])
    parts = max(usual, -(-n // RANGE_ROWS))
    ranged = keep(held.repartitionByRange(parts, *group, value).withColumn("_part", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    by_part = ranged.groupBy("_part", *group).agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    dealt = ranged.repartition(parts, "_part", *group) if parts > usual else ranged
    bases = by_part.select(F.col("_part").alias("_of"), *[F.col(g).alias(f"_g_{g}") for g in group], *[F.coalesce(F.sum(f"_s_{s}").over(earlier),
        F.lit(0)).alias(f"_b_{s}") for s in sums])
    same = reduce(lambda a, b: a & b, [_same(g, f"_g_{g}") for g in group], F.col("_part") == F.col("_of"))
    out = dealt.withColumns({f"_r_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}).join(bases, same)
    return out.select(*counted.columns, *[(F.col(f"_r_{s}") + F.col(f"_b_{s}")).alias(f"{s}_before") for s in sums])


def exact_quantiles(rows: DataFrame, group: list[str], value: str, probs: list[float], name: str = "q") -> DataFrame:
    """group and an array of the quantiles at probs, linearly interpolated between neighbouring values. Null and NaN values don't
    count; a group without others has no row. Without a group there is one row, or none."""
    x = F.col(value).cast("double")
    counted = rows.select(*group, x.alias("_v")).where("_v is not null and not isnan(_v)").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counted_quantiles(keep(counted, "counted"), group, probs, name)


def counted_quantiles(counted: DataFrame, group: list[str], probs: list[float], name: str = "q") -> DataFrame:
    """exact_quantiles() from a kept table of group, _v and _n, the number of the group's rows with that value."""
    placed = running_counts(counted, group, "_v", ["_n"], kept=True)
    totals = placed.groupBy(*group).agg(F.max(F.col("_n_before") + F.col("_n")).alias("_all"))
    if group:
        placed = placed.join(totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_all"), reduce(lambda a, b: a & b, [_same(g,
            f"_g_{g}") for g in group]))
    else:
        placed = placed.join(F.broadcast(totals), how="cross")  # one row
    at = F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probs)]),
        lambda x: F.struct(x["k"].alias("k"), (x["p"] * (F.col("_all") - 1)).alias("place")))
    covers = lambda place: (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
    low, high = (lambda x: F.floor(x["place"])), (lambda x: F.ceil(x["place"]))
    hits = placed.select(*group, "_v", "_n_before", "_n", F.explode(F.filter(at, lambda x: covers(low(x)) | covers(high(x)))).alias("_at"))
    a, b = F.floor(F.col("_at.place")), F.ceil(F.col("_at.place"))
    ends = hits.groupBy(*group, F.col("_at.k").alias("_k")).agg(
        F.max(F.when(covers(a), F.col("_v"))).alias("_low"), F.max(F.when(covers(b), F.col("_v"))).alias("_high"), F.max(F.col("_at.place") - a).alias("_part")
    )
    q = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    out = ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("_k"), q.alias("q")))).alias("_all"))  # a row for each of probs
    return out.where(F.size("_all") > 0).select(*group, F.transform("_all", lambda x: x["q"]).alias(name))
