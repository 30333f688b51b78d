"""Rows that nobody owns, claimed by new learners to match the labels that they were made of.

Learners claim in the order of their birth, each for its labels from the largest need down, the first rows that are left of a label, and
stop at their sample count. What each one gets depends on counts alone: from the number of rows of each label the claims follow as ranges
of row numbers, a small table (learners x labels), and one join gives the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import keep

from .quantiles import running_counts


def claim_ranges(available: dict[str, int], births: list[tuple[str, int, dict[str, int]]]) -> list[tuple[str, str, int, int]]:
    """(learner, label, first, last + 1): places among a label's rows. births: learner, sample count, label -> need, in order of birth;
    ties of need go to the label that is named first."""
    taken, out = dict.fromkeys(available, 0), []
    for learner, samples, needs in births:
        got = 0
        for label, need in sorted(needs.items(), key=lambda x: -x[1]):
            n = min(need, available.get(label, 0) - taken.get(label, 0), samples - got)
            if n > 0:
                out.append((learner, label, taken[label], taken[label] + n))
                taken[label] += n
                got += n
            if got >= samples:
                break
    return out


def claim_rows(unowned: DataFrame, births: list[tuple[str, int, dict[str, int]]]) -> DataFrame:
    """row_index, label, claimer of the rows of unowned (row_index, label) that are claimed."""
    placed = running_counts(unowned.select("row_index", "label").withColumn("_one", F.lit(1).cast("long")), ["label"], "row_index", ["_one"])
    placed = keep(placed.select("row_index", "label", F.col("_one_before").alias("_at")), "unowned")
    available = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each label
    ranges = unowned.sparkSession.createDataFrame(claim_ranges(available, births), "claimer string, label string, _from long, _to long")
    return placed.join(F.broadcast(ranges), "label").where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select("row_index",
        "label", "claimer")


def births_of(created: DataFrame) -> list[tuple[str, int, dict[str, int]]]:
    """What claim_rows takes, from created (learner, label, need, born): learners by their smallest `born`, labels by need and name."""
    order = created.groupBy("learner").agg(F.min("born").alias("born"), F.sum("need").alias("samples"))
    rows = created.select("learner", "label", "need").join(order, "learner").orderBy("born", "learner", F.col("need").desc(),
        "label").collect()  # a row for each learner and label
    out: dict[str, tuple[str, int, dict[str, int]]] = {}
    for r in rows:
        out.setdefault(r["learner"], (r["learner"], r["samples"], {}))[2][r["label"]] = r["need"]
    return list(out.values())


