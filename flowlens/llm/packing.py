"""Packing token sequences to a fixed length by exact complements, then best fit.

What to put together depends only on how many pieces of each length there are, a table of at most `capacity` rows
whatever the corpus. On it the planner looks, from the longest length down, for one length, then a pair, then a triple
of lengths whose sum is exactly the gap, and uses up each combination as often as the counts allow; what is left over
goes in best-fit order, in runs of equal lengths. The plan is a list of patterns with multiplicities; its size is bound
by the number of lengths, not of pieces. Spark then numbers the pieces of each length and joins each number to its
place in the plan.

Pieces of one length are numbered in buckets by hash, each bucket after the sum of the earlier ones, so a length that a
third of all pieces have is not numbered by one task.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .shared import drop, save
from .words import slices

Plan = list[tuple[int, tuple[tuple[int, int], ...]]]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """[(how often, ((length, how many), ...))]: every piece is used once, and no pattern is over capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1 to {capacity}")
        left[length] += n
    plan: Plan = []

    def use(lengths: list[int], limit: int | None = None) -> None:
        kinds = sorted({(x, lengths.count(x)) for x in lengths}, reverse=True)
        n = min(int(left[x]) // k for x, k in kinds)
        n = n if limit is None else min(n, limit)
        if n > 0:
            for x, k in kinds:
                left[x] -= n * k
            plan.append((n, tuple(kinds)))

    for length in range(capacity, 0, -1):
        if not left[length]:
            continue
        gap = capacity - length
        if not gap:
            use([length])
            continue
        if gap <= length:
            use([length, gap])
        # pairs (a, b) with a + b = gap; a from the longest down
        while left[length]:
            a = np.arange(min(gap - 1, length), (gap - 1) // 2, -1)
            ok = a[(left[a] > 0) & (left[gap - a] > 0)] if len(a) else a
            before = len(plan)
            for x in ok.tolist():
                use([length, x, gap - x])
                if not left[length]:
                    break
            if len(plan) == before:
                break
        # triples: the longest a first, then a pair for the rest
        a = min(gap - 2, length)
        while left[length] and a >= gap / 3:
            if left[a]:
                rest = gap - a
                b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
                for x in b[(left[b] > 0) & (left[rest - b] > 0)].tolist() if len(b) else ():
                    use([length, a, x, rest - x])
                    if not left[length] or not left[a]:
                        break
            a -= 1
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on counts: equal open sequences are one group, and a run of equal lengths fills the group
    with the least sufficient gap as often as both last."""
    open_: dict[int, list[list]] = {}  # gap -> [[how many, {length: count}], ...]
    gaps: list[int] = []
    done: Plan = []

    def put(gap: int, n: int, has: dict[int, int]) -> None:
        if gap == 0:
            done.append((n, tuple(sorted(has.items(), reverse=True))))
            return
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append([n, has])

    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                n, rest = divmod(todo, each)
                if n:
                    put(capacity - each * length, n, {length: each})
                if rest:
                    put(capacity - rest * length, 1, {length: rest})
                break
            gap = gaps[at]
            group = open_[gap][-1]
            n, has = group
            each = min(gap // length, todo)
            used = min(n, todo // each)
            if used == n:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                group[0] -= used
            put(gap - each * length, used, has | {length: has.get(length, 0) + each})
            todo -= used * each
    return done + [(n, tuple(sorted(has.items(), reverse=True))) for groups in open_.values() for n, has in groups]


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, how many, per sequence, first sequence, first offset): the places of a run of pieces of
    one length. Piece number i of the run is in sequence first + i // per, at offset + (i % per) * length."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for n, kinds in plan:
        offset = 0
        for length, per in kinds:
            first = taken.get(length, 0)
            out.append((length, first, n * per, per, sequence, offset))
            taken[length] = first + n * per
            offset += per * length
        sequence += n
    return out


def cut_pieces(docs: DataFrame, capacity: int, end: int, path: str | None = None, held: int = 160_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only if over capacity."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(path or default_path(), by_library=True, held=held)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None, bucket_rows: int = 50_000, held: int = 160_000_000) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come. An empty table gives none. A very long
    text is encoded whole and cut into pieces of `capacity`. Other columns are not read, so no name clashes.
    held: bytes of encoded words that a task remembers.
    """
    spark = docs.sparkSession
    pieces = save(cut_pieces(docs, capacity, end, path, held), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(
        places(plan_packing(counts, capacity)) or [(0, 0, 0, 1, 0, 0)],
        "length long, first long, many long, per long, first_sequence long, first_offset long",
    )
    # runs of places are cut so that a piece's number // step finds its runs by equality
    step = max(4096, sum(counts.values()) >> 16)
    plan = plan.withColumn("span", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("many") - 1) / step))))

    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    hashed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    each = hashed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = each.withColumn(
        "base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = hashed.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("base") + F.col("own")).withColumn("span", F.floor(F.col("number") / step))
    placed = numbered.join(plan, ["length", "span"]).where("number >= first and number < first + many")
    inside = F.col("number") - F.col("first")
    out = placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(inside / F.col("per"))).alias("sequence_id"),
        (F.col("first_offset") + (inside % F.col("per")) * F.col("length")).alias("offset"),
    )
    out = save(out, "packed")
    drop(pieces)
    return out
