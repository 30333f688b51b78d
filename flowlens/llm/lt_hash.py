"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (a line with a word) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo a power of two. So the order of paragraphs doesn't matter, and one paragraph is
added or taken out by adding or subtracting its vector, without the rest of the document.

The vector has two parts. `DENSE` lanes modulo 2^64 are filled by an extendable-output hash of the paragraph's bytes:
equal sums mean equal multisets of paragraphs. `LIKE` lanes modulo 2^32 count the paragraph's word windows with a sign:
their sums stay close when most of the paragraphs' wording does, and their cosine, 0 at least, is the likeness. A lane
wraps only beyond 2^31 windows, more than a text can hold.
Fingerprints that are equal have likeness 1; two documents without paragraphs are equal.

White space inside a line is as it is; lines are trimmed; lines without a word don't count. A null text is empty. A row
for each row, repeated ones too; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save
from .words import Memo, hash_word, mix, slices

#: Lanes of the two parts, and words in a window.
DENSE, LIKE, WINDOW = 32, 256, 3


class Fingerprint:
    """A sum of paragraph vectors. add() and remove() take text of whole paragraphs; `+` and `-` work on fingerprints."""

    __slots__ = ("dense", "like")

    def __init__(self, text: str | None = None, hashes: Memo | None = None):
        """hashes: the caller's memory of word hashes, if it has one."""
        self.dense = np.zeros(DENSE, np.uint64)
        self.like = np.zeros(LIKE, np.uint32)
        if text:
            self.add(text, hashes)

    def _vector(self, text: str, memo: Memo | None) -> tuple[np.ndarray, np.ndarray]:
        dense = np.zeros(DENSE, np.uint64)
        data = text.encode("utf-8", "surrogatepass")
        hashes, owner = [], []
        for line in data.split(b"\n"):
            words = line.split()
            if words:
                dense += np.frombuffer(hashlib.shake_128(line.strip()).digest(8 * DENSE), "<u8")
                hashes += map(memo.__getitem__ if memo is not None else hash_word, words)
                owner.append(len(words))
        like = np.zeros(LIKE, np.int64)
        if hashes:
            h = np.array(hashes, np.uint64)
            # windows that stay inside one paragraph; a paragraph's last words also make shorter ones
            line_of = np.repeat(np.arange(len(owner)), owner)
            made = mix(h)
            for k in range(1, WINDOW):
                same = np.zeros(len(h), bool)
                same[:-k] = line_of[:-k] == line_of[k:]
                step = np.zeros(len(h), np.uint64)
                step[:-k] = h[k:]
                made = mix(made + np.where(same, step, np.uint64(k)))
            sign = 1 - 2 * (made >> np.uint64(63)).astype(np.int64)
            like += np.bincount((made & np.uint64(LIKE - 1)).astype(np.int64), weights=sign, minlength=LIKE).astype(np.int64)
        return dense, like.astype(np.uint32)

    def add(self, text: str, hashes: Memo | None = None) -> Fingerprint:
        dense, like = self._vector(text, hashes)
        self.dense += dense
        self.like += like
        return self

    def remove(self, text: str) -> Fingerprint:
        dense, like = self._vector(text, None)
        self.dense -= dense
        self.like -= like
        return self

    def __add__(self, other: Fingerprint) -> Fingerprint:
        out = Fingerprint()
        out.dense, out.like = self.dense + other.dense, self.like + other.like
        return out

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        out = Fingerprint()
        out.dense, out.like = self.dense - other.dense, self.like - other.like
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.dense == other.dense).all() and (self.like == other.like).all())

    __hash__ = None

    def text(self) -> str:
        return base64.b64encode(self.dense.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        a, b = self.like.view(np.int32).astype(np.float64), other.like.view(np.int32).astype(np.float64)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return 0.0 if not size else float(min(1.0, max(0.0, a @ b / size)))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points gives way to the first as many, or all, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a string, a row for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memo = Memo(hash_word)
        for batch in (part for whole in batches for part in slices(whole)):
            made = []
            for text in batch.column("text").to_pylist():
                memo.trim()
                made.append(Fingerprint(text, memo).text())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches):
    """Rows of a range of doc_ids in order; the row marked `carry` is the first one after the range."""
    memo = Memo(hash_word)
    last = None  # (doc_id, text, fingerprint)
    rows: list[tuple] = []

    def close(following: str, after: Fingerprint) -> None:
        doc, text, own = last
        new = edited(text, following)
        made = Fingerprint(new, memo)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((doc, len(text), digest, own.text(), made.text(), own.likeness(made), own.likeness(after)))

    def out():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _COMPARED.split(", ")])

    for batch in (part for whole in batches for part in slices(whole)):
        for doc, text, carry in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "carry")), strict=True):
            memo.trim()
            text = text or ""
            own = Fingerprint(text, memo)
            if last is not None:
                close(text, own)
            last = None if carry else (doc, text, own)
            if len(rows) >= 512:
                yield out()
    if rows:
        yield out()


def compare_with_edits(docs: DataFrame, rows_per_range: int = 4000, most_ranges: int = 20_000) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's start, and their likeness.

    The next document is that of the next doc_id (rows of one doc_id: by text; null first), after the last the first.
    Each task walks a range of doc_ids in order, given also the first row of the next range; so the texts are shuffled
    once, rows stream through, and no task sees more than its range. There are at most `most_ranges`, whose bounds the
    driver holds; beyond that ranges get longer, not more. A single row is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = base.count()
    if not n:
        return spark.createDataFrame([], _COMPARED)
    parts = min(most_ranges, max(1, -(-n // rows_per_range)))
    ids = base.select("doc_id").na.fill(-(2**63), ["doc_id"])
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), "left").astype(np.int32))

    placed = base.withColumn("range", range_of(F.coalesce("doc_id", F.lit(-(2**63)))) if cuts else F.lit(0))
    heads = save(placed.groupBy("range").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("null_head")), "heads")
    order = sorted((r["range"], r["head"], r["null_head"]) for r in heads.collect())
    following = [(order[k - 1][0], None if null else head) for k, (_, head, null) in enumerate(order)]
    # the first row of each range: among the rows of its smallest doc_id that of the smallest text
    firsts = spark.createDataFrame(following, "range int, doc_id long")
    same = base.withColumnRenamed("doc_id", "own").join(F.broadcast(firsts), F.col("own").eqNullSafe(F.col("doc_id")))
    carries = same.groupBy("range").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.col("text").isNotNull(), "text")).alias("x"))
    rows = placed.withColumn("carry", F.lit(False)).unionByName(carries.select("x.doc_id", "x.text", "range", F.lit(True).alias("carry")))
    dealt = rows.repartitionById(len(order), F.col("range")).sortWithinPartitions("range", "carry", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.select("doc_id", "text", "carry").mapInArrow(_walk, _COMPARED)
