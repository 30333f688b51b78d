"""Shards by k-d tree partitioning over metadata, with DataFrame operations only.

All rows are one cell at first. A cell that is to hold m shards is split in two for m // 2 and the rest, at the weighted
quantile of its widest dimension that parts its bytes in that proportion, until each cell is one shard of the target
bytes. A dimension's width in a cell is its share of distinct places, from the cell's smallest to its largest value, in
the range of all rows; ties go to the dimension named first. Equal values on the split are parted by a hash of the
row, so a value, source or text that a third of all rows have splits like any other.

The quantile is found by refinement: rows are ordered by a 48-bit key (the value's place in 2^24, a hash), each pass sums the
bytes of 4096 buckets of a slice of the key per cell, and the bucket with the split is refined in the next. A pass is
one aggregation with partial sums; the driver sees cells * 4096 sums, whatever the corpus. Shard sizes so differ from the
target by about one row per level. Places in a shard are numbered by buckets of the hash with running bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, save

#: Bits of a value, of the hash, and of a slice of the key.
_VALUE, _HASH, _SLICE = 24, 24, 12


def _slices() -> int:
    return (_VALUE + _HASH) // _SLICE


def _slice(dim: Column, k: int) -> Column:
    """Bits of slice k of the key (value, hash), from the top."""
    source, at = (dim, k) if k < _VALUE // _SLICE else (F.col("h"), k - _VALUE // _SLICE)
    return F.shiftright(source, _VALUE - _SLICE * (at + 1)).bitwiseAND(F.lit(2**_SLICE - 1))


def kd_shards(rows: DataFrame, shards: int, dimensions: list[str], size: str = "size", bucket_rows: int = 50_000) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    rows has doc_id, a long `size` and the dimensions as non-negative long values (nulls count as 0). Rows equal in
    doc_id and size may come repeatedly; each gets its own slot. An empty table gives none. Other columns come back as they are,
    whatever their names; those named shard or slot give way to the results.
    """
    spark = rows.sparkSession
    given = [c for c in rows.columns if c not in ("shard", "slot")]
    inside = {c: f"u{k}" for k, c in enumerate(given)}  # no name of the caller's meets one of ours
    rows = rows.select(*[F.col(f"`{c}`").alias(u) for c, u in inside.items()])
    dimensions, size, doc_id = [inside[d] for d in dimensions], inside[size], inside["doc_id"]
    dims = [F.coalesce(F.col(d), F.lit(0)) for d in dimensions]
    mask = F.lit(2**_HASH - 1)
    base = rows.select(
        "*",
        *[d.cast("long").alias(f"d{i}") for i, d in enumerate(dims)],
        F.xxhash64(F.lit(11), doc_id, F.monotonically_increasing_id()).bitwiseAND(mask).alias("h"),
        F.lit(0).alias("cell"),
    )
    base = save(base, "kd-base")
    names = [f"d{i}" for i in range(len(dims))]
    whole = base.agg(*[F.struct(F.min(d).alias("low"), F.max(d).alias("high")).alias(d) for d in names]).first()
    low = {d: whole[d]["low"] or 0 for d in names}
    top = {d: max(1, (whole[d]["high"] or 0) - low[d]) for d in names}
    base = base.withColumns({d: F.floor((F.col(d) - low[d]) * ((2**_VALUE - 1) / top[d])) for d in names})
    cells = {0: (0, shards)}  # cell -> first shard, shards
    while any(m > 1 for _, m in cells.values()):
        open_ = [c for c, (_, m) in cells.items() if m > 1]
        wide = base.where(F.col("cell").isin(open_)).groupBy("cell").agg(F.sum(size).alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in names]).collect()
        pick = {r["cell"]: max(names, key=lambda d: (r[d], -names.index(d))) for r in wide}
        goal = {r["cell"]: r["bytes"] * (cells[r["cell"]][1] // 2) / cells[r["cell"]][1] for r in wide}
        # the split of each cell as the slices of its key; a row goes left if its key is below
        prefix: dict[int, list[int]] = {c: [] for c in pick}
        passed = dict.fromkeys(pick, 0)
        for k in range(_slices()):
            found = {}
            plan = spark.createDataFrame([(c, pick[c], *prefix[c]) for c in pick], "cell int, dim string" + "".join(f", p{j} long" for j in range(k)))
            chosen = base.join(F.broadcast(plan), "cell").withColumn("v", F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in names]))  # one row a cell
            same = chosen
            for j in range(k):
                same = same.where(_slice(F.col("v"), j) == F.col(f"p{j}"))
            for r in same.groupBy("cell", _slice(F.col("v"), k).alias("bucket")).agg(F.sum(size).alias("bytes")).orderBy("cell", "bucket").collect():
                found.setdefault(r["cell"], []).append((r["bucket"], r["bytes"]))
            for c in pick:
                below, at = passed[c], found.get(c, [])
                cut = at[-1][0] + 1 if at else 0
                for bucket, n in at:
                    last = k + 1 == _slices() and below + n - goal[c] < goal[c] - below  # the nearer of two cuts
                    if below + n > goal[c] and not last:
                        cut = bucket
                        break
                    below += n
                passed[c] = below
                prefix[c].append(cut)
        plan = spark.createDataFrame([(c, pick[c], *prefix[c]) for c in pick], "cell int, dim string" + "".join(f", p{j} long" for j in range(_slices())))
        joined = base.join(F.broadcast(plan), "cell", "left").withColumn("v", F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in names]))
        left = F.lit(False)
        for j in reversed(range(_slices())):
            s = _slice(F.col("v"), j)
            left = (s < F.col(f"p{j}")) | ((s == F.col(f"p{j}")) & left)
        moved = joined.withColumn("cell", F.when(F.col("dim").isNull(), F.col("cell") * 2).when(left, F.col("cell") * 2).otherwise(F.col("cell") * 2 + 1))
        moved = save(moved.select(base.columns), "kd-base")
        drop(base)
        base, after = moved, {}
        for c, (first, m) in cells.items():
            after[2 * c] = (first, m // 2 if m > 1 else 1)
            if m > 1:
                after[2 * c + 1] = (first + m // 2, m - m // 2)
        cells = after
    shard = spark.createDataFrame([(c, first) for c, (first, _) in cells.items()], "cell int, shard int")
    placed = base.join(F.broadcast(shard), "cell")
    buckets = max(1, -(-base.count() // bucket_rows))
    placed = placed.withColumn("part", F.pmod(F.col("h"), F.lit(buckets)))
    each = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = each.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", doc_id)) - 1
    out = placed.withColumn("own", own).join(before, ["shard", "part"]).select(*[F.col(u).alias(c) for c, u in inside.items()], "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"))
    out = save(out, "kd-shards")
    drop(base)
    return out


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in shards of near equal bytes.

    The dimensions are length, source and language; source and language are placed by a hash.
    size is the text's UTF-8 bytes plus 8; a null text counts as empty. Columns other than these
    are ignored; source and lang may be missing.
    """
    place = lambda c: F.coalesce(F.xxhash64(F.col(c)).bitwiseAND(F.lit(2**48 - 1)), F.lit(0)) if c in docs.columns else F.lit(0)
    data = F.col("text").cast("binary")
    meta = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"),
        place("source").alias("by_source"),
        place("lang").alias("by_lang"),
    )
    out = kd_shards(meta, shards, ["length", "by_source", "by_lang"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
