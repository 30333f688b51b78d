"""Reading flow CSVs of different years as one table: ordered files, header repair, alignment of schemas, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.labels import with_year_tag, year_of_path

#: Fixed: candidate names of the label column, in the order they are tried.
LABEL_NAMES = ["Label", "label", "LABEL", "class", "Class", "attack_cat", "Attack"]


def trim_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Column names without outer space, then renamed; a name that comes twice keeps its first column."""
    names, out = set(), []
    for c in df.columns:
        name = (renames or {}).get(c.strip(), c.strip())
        if name not in names:
            names.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def resolve(columns: list[str], *names: str, needed: bool = True) -> str | None:
    """The first of the names that a table has: as written, else trimmed and in any case."""
    for name in names:
        if name in columns:
            return name
    by_lower = {c.strip().lower(): c for c in reversed(columns)}
    for name in names:
        if name.strip().lower() in by_lower:
            return by_lower[name.strip().lower()]
    if needed:
        raise KeyError(f"none of {names} is a column")
    return None


def label_column(df: DataFrame, fallback: str = "raise") -> str:
    """A known name; else, as asked for, the last column or the last one with 2 to 100 distinct values."""
    found = resolve(df.columns, *LABEL_NAMES, needed=False)
    if found:
        return found
    if fallback == "last":
        return df.columns[-1]
    if fallback == "few_values":
        n = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in df.columns]).first()
        few = [c for c in df.columns if 2 <= n[c] <= 100]
        if few:
            return few[-1]
    raise KeyError("no label column")


def common_columns(tables: list[list[str]], essential: list[str] = ()) -> list[str]:
    """Names that all tables have, in the first one's order, each once; an essential one that is missing is an error."""
    others = [set(t) for t in tables[1:]]
    out = [c for c in dict.fromkeys(tables[0]) if all(c in o for o in others)]
    if missing := [c for c in essential if c not in out]:
        raise KeyError(f"missing in some table: {missing}")
    return out


def align(tables: list[DataFrame], essential: list[str] = ()) -> list[DataFrame]:
    names = common_columns([t.columns for t in tables], essential)
    return [t.select(*[f"`{c}`" for c in names]) for t in tables]


def in_order(tables: list[DataFrame], name: str = "file_no") -> DataFrame:
    """Union by name; file_no is a table's place. Columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(name, F.lit(i)) for i, t in enumerate(tables)])


def read_flow_csv(spark: SparkSession, paths: list[str], schema: str, renames: dict[str, str] | None = None, label: str = "Label",
    bad_lines: str = "DROPMALFORMED") -> DataFrame:
    """The files as one table with source_file and year-tagged labels. The schema is given, never inferred; malformed lines
    are dropped, or kept apart with bad_lines='PERMISSIVE' and a _corrupt_record column in the schema."""
    df = spark.read.schema(schema).csv(paths, header=True, mode=bad_lines, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    df = df.withColumn("source_file", F.col("_metadata.file_path"))
    df = trim_names(df, renames)
    return df.withColumn(label, with_year_tag(F.col(label), year_of_path(F.col("source_file"))))


def parse_time(text: Column, formats: list[str]) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def without_ports(df: DataFrame, ip: str = "src_ip") -> DataFrame:
    """For tables without ports: ports '0' and a pseudo-learner for each source address."""
    return df.withColumns({"src_port": F.lit("0"), "dst_port": F.lit("0"), "learner": F.concat(F.lit("SRC_"), F.regexp_replace(ip, r"[^0-9A-Za-z]+", "_"))})


def interface_rates(df: DataFrame, time: str, counters: list[str]) -> DataFrame:
    """Deltas of growing counters between consecutive readings of a host, per second; resets count as 0. df has host."""
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(w)
    rates = {f"{c}_rate": F.when(gap > 0, F.greatest(F.lit(0.0), (F.col(c) - F.lag(c).over(w)) / gap)) for c in counters}
    return df.withColumns(rates).where(" and ".join(f"{c}_rate is not null" for c in counters))
