"""Which columns of a flow table a model sees: feature profiles, exclusion by name, alignment to a trained set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.stats import clean

#: Columns that say where and when a flow was seen, or what it was.
ENVIRONMENT = ["id", "Flow ID", "Src IP", "Dst IP", "Src Port", "Dst Port", "Protocol", "Timestamp", "Label", "Attempted Category"]

#: The curated feature sets of the flow meter's columns.
STABLE_STATS = [
    "Flow Duration", "Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Fwd Segment Size Avg", "Bwd Segment Size Avg",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes", "fwd_init_win_missing_flag", "bwd_init_win_missing_flag", "is_non_tcp", "flow_bytes_s_missing_flag",
    "Fwd Act Data Pkts", "Fwd Seg Size Min", "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]
COMPACT_STATS = [
    "Flow Duration", "Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Mean", "Fwd Packet Length Std", "Bwd Packet Length Min", "Bwd Packet Length Max", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Fwd IAT Mean", "Fwd IAT Std", "Bwd IAT Mean", "Bwd IAT Std",
    "Packet Length Mean", "Packet Length Std", "SYN Flag Count", "ACK Flag Count", "PSH Flag Count", "Average Packet Size", "FWD Init Win Bytes",
    "Bwd Header Length", "Fwd Bulk Rate Avg", "Bwd Bulk Rate Avg", "flow_bytes_s_missing_flag", "Active Mean", "Active Std", "Active Max", "Idle "
        "Mean", "Idle Std",
]
PROFILES: dict[str, list[str] | None] = {"all_numeric_no_env": None, "stable_stats_no_env": STABLE_STATS, "compact_stats_no_env": COMPACT_STATS}

#: What a synthesised feature may not be made of: columns of these names, and columns whose name has one of these parts.
EXCLUDED = {"row_index", "assigned_learner", "phase", "learner_name", "is_attack_learner", "attack_ratio"}
EXCLUDED_PARTS = ["label", "attack", "target", "year_tag", "dataset", "source_file", "row_index", "index", "assigned_learner", "learner_name",
    "phase", "fold", "split"]


def numeric_columns(df: DataFrame, left_out: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in left_out]


def profile_columns(df: DataFrame, profile: str = "all_numeric_no_env", environment: list[str] | None = None, profiles: dict[str,
    list[str] | None] | None = None) -> list[str]:
    """The numeric columns of a profile, in the profile's order; all numeric ones outside the environment if the curated set has
    none of the table's, or the profile isn't known."""
    numeric = numeric_columns(df, ENVIRONMENT if environment is None else environment)
    curated = (PROFILES if profiles is None else profiles).get(profile) or []
    return [c for c in curated if c in numeric] or numeric


def project(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """keep as it is, then the columns as doubles; null, NaN and infinite values are 0."""
    return df.select(*(keep or []), *[clean(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])


def allowed(columns: list[str], excluded: set[str] | None = None, parts: list[str] | None = None) -> list[str]:
    """Columns that may be learned from: not excluded by name, and no part in the lower-cased name."""
    excluded, parts = EXCLUDED if excluded is None else excluded, EXCLUDED_PARTS if parts is None else parts
    return [c for c in columns if c not in excluded and not any(p in c.lower() for p in parts)]


def reindex(df: DataFrame, columns: list[str], keep: list[str] | None = None, fill: float = 0.0) -> DataFrame:
    """keep, then exactly these columns in this order: those that df lacks, and nulls, are `fill`; others go."""
    has = set(df.columns)
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill)) if c in has else F.lit(fill)
    return df.select(*(keep or []), *[value(c).alias(c) for c in columns])


#: How a profile column's name ends, and what it holds; the first that fits counts.
SUFFIXES = [
    ("__mean", "mean of the feature over the group's rows"), ("__std", "sample deviation, 0 for one row"), ("__cv", "|deviation / mean|, 0 where the "
        "mean is 0"),
    ("__min", "least value"), ("__max", "greatest value"), ("_ratio", "share, 0 to 1"), ("_count", "number of rows"), ("_entropy", "entropy over its "
        "greatest possible value"),
]


def metric_catalog(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, kind, what it holds) of each column: by its suffix, else by its type."""
    out = []
    for f in df.schema.fields:
        found = next(((s.strip("_"), text) for s, text in SUFFIXES if f.name.endswith(s)), None)
        out.append((f.name, *(found or (("number", "a value of the table") if isinstance(f.dataType, T.NumericType) else ("text", "a name or a document")))))
    return out


def top_groups(df: DataFrame, group: Column, tests: dict[str, Column], rank: str, k: int = 30) -> DataFrame:
    """The k groups of the largest share of test `rank`, then of most rows, then of the smaller name: rows, and each test's rows and
    share."""
    n = F.count(F.lit(1))
    out = df.groupBy(group.alias("group")).agg(n.alias("rows"), *[F.sum(t.cast("long")).alias(f"{c}_rows") for c, t in tests.items()])
    out = out.withColumns({f"{c}_ratio": F.coalesce(F.col(f"{c}_rows"), F.lit(0)) / F.col("rows") for c in tests})
    return out.orderBy(F.col(f"{rank}_ratio").desc(), F.col("rows").desc(), "group").limit(k)
