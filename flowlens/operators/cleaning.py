"""Filters, cleaning and sampling of flow rows. Everything is a column expression; nothing collects rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import base_label, is_benign, label_year, normal_label
from flowlens.functions.stats import finite

from .quantiles import exact_quantiles, running_counts


def keep_years(df: DataFrame, years: list[str], label: str = "label") -> DataFrame:
    """Rows whose label has one of the year tags; rows without a tag never match."""
    return df.where(label_year(F.col(label)).isin(years))


def drop_benign_of_years(df: DataFrame, years: list[str], label: str = "label") -> DataFrame:
    drop = F.coalesce(label_year(F.col(label)).isin(years), F.lit(False)) & is_benign(F.col(label))
    return df.where(~drop)


def keep_attacks(df: DataFrame, include: list[str], label: str = "label") -> DataFrame:
    """Only attacks of the given types; benign rows stay, unless BENIGN is in the list, which then is all that counts."""
    names = [x.strip().upper() for x in include]
    hit = base_label(F.col(label)).isin(names) | normal_label(F.col(label)).isin(names)
    return df.where(hit if "BENIGN" in names else hit | is_benign(F.col(label)))


def drop_attacks(df: DataFrame, exclude: list[str], label: str = "label") -> DataFrame:
    """Without attacks of the given types; benign rows go only if BENIGN is in the list."""
    names = [x.strip().upper() for x in exclude]
    hit = base_label(F.col(label)).isin(names) | normal_label(F.col(label)).isin(names)
    return df.where(~hit if "BENIGN" in names else ~hit | is_benign(F.col(label)))


#: Fixed: protocol names and their numbers.
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}


def keep_protocols(df: DataFrame, tokens: list[str], protocol: str = "protocol") -> DataFrame:
    """Numbers or names, `other` for neither TCP nor UDP, `non_udp`. Fractions round half to even; unknown tokens don't
    count; with none left nothing is filtered."""
    number = F.rint(F.col(protocol).cast("double"))
    wanted, tests = set(), []
    for token in (t.strip().lower() for t in tokens):
        if token in PROTOCOLS:
            wanted.add(PROTOCOLS[token])
        elif token.isdigit():
            wanted.add(int(token))
        elif token == "other":
            tests.append(~number.isin(6, 17))
        elif token == "non_udp":
            tests.append(number != 17)
    if wanted:
        tests.append(number.isin(sorted(wanted)))
    return df.where(F.coalesce(reduce(Column.__or__, tests), F.lit(False))) if tests else df


def repair_missing(df: DataFrame, sentinels: list[str], unbounded: list[str], protocol: str | None = None) -> DataFrame:
    """Sentinel columns: -1, null and NaN become 0. Unbounded ones: infinities, null and NaN become 0. Each gets a 0/1 flag
    `<column>_missing_flag`; is_non_tcp is 1 unless the protocol is 6 (a null one is not)."""
    added = {}
    for c in sentinels:
        bad = F.col(c).isNull() | F.isnan(F.col(c)) | (F.col(c) == -1)
        added |= {c: F.when(bad, 0.0).otherwise(F.col(c)), f"{c}_missing_flag": bad.cast("int")}
    for c in unbounded:
        bad = finite(F.col(c)).isNull()
        added |= {c: F.when(bad, 0.0).otherwise(F.col(c)), f"{c}_missing_flag": bad.cast("int")}
    if protocol is not None:
        added["is_non_tcp"] = (~F.coalesce(F.col(protocol) == 6, F.lit(False))).cast("int")
    return df.withColumns(added)


@dataclass(frozen=True)
class ZeroRule:
    """Rows in which all the columns are 0 within eps go. A rule with a missing column is skipped."""

    columns: tuple[str, ...]
    eps: float = 0.0
    nan_is_zero: bool = True


def drop_all_zero(df: DataFrame, rules: list[ZeroRule]) -> DataFrame:
    tests = []
    for rule in rules:
        if rule.columns and set(rule.columns) <= set(df.columns):
            zero = [F.coalesce(F.abs(finite(F.col(c).cast("double"))) <= rule.eps, F.lit(rule.nan_is_zero)) for c in rule.columns]
            tests.append(reduce(Column.__and__, zero))
    return df.where(~reduce(Column.__or__, tests)) if tests else df


def nonzero_count(columns: list[str], eps: float = 0.0) -> Column:
    """How many of the columns are finite and further than eps from 0."""
    return reduce(Column.__add__, [F.coalesce((F.abs(finite(F.col(c).cast("double"))) > eps).cast("int"), F.lit(0)) for c in columns])


def first_per_group(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group, most of them at most."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def sample_per_group(df: DataFrame, group: list[str], key: str, most: int, seed: int) -> DataFrame:
    """A sample of each group, most rows at most: those with the smallest md5 of seed and key, the same on every run. Shares of a group are
    cut first, so no task orders a large group."""
    rank = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    share = F.pmod(F.xxhash64(key), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = df.withColumn("_share", share)
    for of in ([*group, "_share"], group):
        cut = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*of).orderBy(rank, key))).where(F.col("_n") <= most)
    return cut.drop("_n", "_share")


def stratified(df: DataFrame, group: str, key: str, fraction: float, most: int, seed: int) -> DataFrame:
    """The same fraction of every group (at least one row), after a cap for each; groups of one row go."""
    rank = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    n = F.least(F.count(F.lit(1)).over(Window.partitionBy(group)), F.lit(most))
    ranked = df.withColumn("_n", n).withColumn("_r", F.row_number().over(rank))
    return ranked.where((F.col("_n") > 1) & (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * fraction)))).drop("_n", "_r")


def oversample(df: DataFrame, test: Column, times: int) -> DataFrame:
    """Rows that pass the test come `times` times."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(test, times).otherwise(1)))).drop("_copy")


def folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """A stratified fold number for each row. Keys tell the rows of a label apart. No task orders a label's rows."""
    rank = F.struct(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).alias("m"), F.col(key).alias("k"))
    placed = running_counts(df.withColumns({"_rank": rank, "_one": F.lit(1).cast("long")}), [label], "_rank", ["_one"])
    return placed.withColumn("fold", (F.col("_one_before") % k).cast("int")).drop("_rank", "_one", "_one_before")


def quantile_band(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows between two exact quantiles (linear interpolation) of a column."""
    q = exact_quantiles(df, [], column, [low, high], "_q")  # one row
    return df.join(F.broadcast(q), how="cross").where(F.col(column).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def iqr_outlier(df: DataFrame, column: str) -> DataFrame:
    """Adds outlier: below q1 - 1.5 iqr or above q3 + 1.5 iqr."""
    q = exact_quantiles(df, [], column, [0.25, 0.75], "_q")  # one row
    iqr = F.col("_q")[1] - F.col("_q")[0]
    out = (F.col(column) < F.col("_q")[0] - 1.5 * iqr) | (F.col(column) > F.col("_q")[1] + 1.5 * iqr)
    return df.join(F.broadcast(q), how="cross").withColumn("outlier", out).drop("_q")


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN become the column's median, 0 where there is none."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*")
    med = exact_quantiles(long, ["column"], "x", [0.5], "m").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("column",
        F.col("m")[0]))).alias("_m"))  # one row
    filled = {c: F.coalesce(F.when(F.isnan(c), None).otherwise(F.col(c)), F.try_element_at("_m", F.lit(c)), F.lit(0.0)) for c in columns}
    return df.join(F.broadcast(med), how="cross").withColumns(filled).drop("_m")


def has_all_tags(tags: list[str], columns: list[str]) -> Column:
    """All tags occur, in any case, in the concatenated columns."""
    text = F.lower(F.concat_ws(" ", *columns))
    return reduce(Column.__and__, [F.contains(text, F.lit(t.lower())) for t in tags]) if tags else F.lit(True)
