"""Functions that SQL can call by name, for as long as the session lives.

Those that columns can express are SQL functions, which the optimiser sees through; the tail threshold is an Arrow function over arrays; a
row's pairs are a table function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowlens.operators.models import tail_threshold

_REST = r"trim(CASE WHEN trim(label) RLIKE '^20\\d{2}\\|' THEN substring(trim(label), 6) ELSE trim(label) END)"

#: name, parameters, result, body.
SQL_FUNCTIONS = [
    ("is_benign_label", "label STRING", "BOOLEAN", f"upper({_REST}) = 'BENIGN' OR upper({_REST}) LIKE 'BENIGN|%'"),
    ("label_year_tag", "label STRING", "STRING", r"CASE WHEN trim(label) RLIKE '^20\\d{2}\\|' THEN left(trim(label), 4) END"),
    ("norm_entropy", "counts ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(counts) <= 1 THEN 0D ELSE least(1D, greatest(0D, aggregate(counts, 0D, (s, n) "
        "-> s - n / aggregate(counts, 0D, (a, b) -> a + b) * ln(n / aggregate(counts, 0D, (a, b) -> a + b))) / ln(size(counts)))) END"),
    ("safe_div", "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b = 0 THEN 0D ELSE a / b END"),
    ("soft_probability", "margin DOUBLE, k DOUBLE", "DOUBLE", "1 / (1 + exp(-k * margin))"),
]


class _Pairs:
    """a < b of each unordered pair of distinct names."""

    def eval(self, names: list[str] | None) -> Iterator[tuple[str, str]]:
        found = sorted({x for x in names or [] if x is not None})
        for k, a in enumerate(found):
            for b in found[k + 1 :]:
                yield a, b


def register_functions(spark: SparkSession) -> list[str]:
    """Registers is_benign_label, label_year_tag, norm_entropy, safe_div, soft_probability, evt_threshold (array of losses) and the table
    function accepted_pairs (array of names); gives the names."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    @F.pandas_udf("double")
    def evt_threshold(losses: pd.Series) -> pd.Series:
        return losses.map(lambda x: tail_threshold(np.asarray([] if x is None else x, float)))

    spark.udf.register("evt_threshold", evt_threshold)
    spark.udtf.register("accepted_pairs", F.udtf(_Pairs, returnType="learner_a string, learner_b string"))
    return [*(f[0] for f in SQL_FUNCTIONS), "evt_threshold", "accepted_pairs"]
