"""Phrases of words that belong together, mined level by level.

Texts are cut into pieces at punctuation and line ends and into words. Level k counts, for each language, the k-grams whose two
overlapping (k-1)-grams are frequent (`least` occurrences); k-grams with an infrequent part can't be frequent. What is frequent at a
level is broadcast as a bitmap of hashes, 32 bits for each frequent gram up to BITMAP bits in all. A bitmap lets every frequent gram
through, so no phrase is lost; the few others that it lets through are counted and then found to be infrequent. Beyond BITMAP / 32
grams a bitmap prunes less, but it never grows. Counts are exact: grams are told apart by their words, never by hashes.

A candidate is a frequent phrase of 2 words or more. Cutting it after its first k words gives a left and a right part, whose counts
stand in the level tables; the cut with the lowest a * a / (left * right) is the candidate's score. A candidate is dropped if a longer
candidate that holds it occurs nearly as often. Each language's best phrases come from two rounds of ranks, so that no task sorts all
phrases of one language.

Tasks number the words of a chunk of texts, count its grams as arrays of numbers and hand on partial counts: a gram that a third of
all rows have is a row of each chunk.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, save
from .words import slices

#: What stands between pieces in a list of words: a byte that no UTF-8 text has.
_BREAK = b"\xff"
_TO_BREAK = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
#: Bits of a level's bitmap at most: 8 MB.
BITMAP = 2**26
#: The language of rows without one.
NO_LANGUAGE = "und"
_SEED = 42  # of Spark's xxhash64


def words_and_breaks(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 with A-Z lower-cased, with _BREAK between pieces."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TO_BREAK)
    return data.replace(_BREAK, b" \xff ").split()  # what is left of white space is \x20 and \x09


class _Numbers(dict):
    """Numbers words in the order in which they come; 0 is the break."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _turn(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(21)) | (h >> np.uint64(43))


def _count(lang: str, ids: np.ndarray, words: list[bytes], size: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """The grams of `size` words in a chunk of one language: lang, gram, n."""
    spelled = pa.array(words, pa.binary())
    if size == 1:
        n = np.bincount(ids, minlength=len(words))
        total, n[0] = int(n[1:].sum()), 0
        found = np.flatnonzero(n)
        grams, n = spelled.take(pa.array(found)), n[found]
    else:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in words), np.uint64, len(words))
        places = max(0, len(ids) - size + 2)  # of grams one word shorter
        h, whole = np.full(places, xxhash.xxh64_intdigest(lang.encode(), _SEED), np.uint64), np.ones(places, bool)
        for k in range(size - 1):
            part = ids[k : k + places]
            h, whole = _turn(h) ^ hashes[part], whole & (part > 0)
        h &= np.uint64(len(bits) * 8 - 1)
        frequent = whole & (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(frequent[:-1] & frequent[1:])
        code = ids[at].astype(np.int64)
        for k in range(1, size):
            code = code * len(words) + ids[at + k]
            if k < size - 1:
                code = np.unique(code, return_inverse=True)[1].ravel()
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        parts = [spelled.take(pa.array(ids[at + k])) for k in range(size)]
        grams = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if len(at) else pa.array([], pa.binary())
    out = [pa.array([lang] * len(grams), pa.string()), grams.cast(pa.string()), pa.array(n, pa.int64())]
    if size == 1:
        out = [pa.concat_arrays([x, pa.array([y], x.type)]) for x, y in zip(out, (lang, None, total), strict=True)]
    return pa.RecordBatch.from_arrays(out, names=["lang", "gram", "n"])


def _level(size: int, bits: np.ndarray | None, most: int = 1_400_000):
    """Per task: (lang, gram, n) of grams of `size` words, counted in chunks of about `most` words; at size 1 also each language's number
    of words, with a null gram."""

    def run(batches):
        held: dict[str, tuple[list[np.ndarray], _Numbers]] = {}
        tokens, end = 0, np.zeros(1, np.int32)

        def out():
            for lang, (parts, numbers) in held.items():
                yield _count(lang, np.concatenate(parts), list(numbers), size, bits)

        for batch in (part for whole in batches for part in slices(whole)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts, numbers = held.setdefault(lang, ([end], _Numbers()))
                words = words_and_breaks(text)
                parts += [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), end]
                tokens += len(words)
                if tokens >= most:
                    yield from out()
                    held, tokens = {}, 0
        yield from out()

    return run


def _gram_hash(lang: Column, gram: Column) -> Column:
    """The hash of a language and a gram that _count works out: words are folded in one by one."""
    turned = lambda h: F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43))
    return F.aggregate(F.split(gram, " ", -1), F.xxhash64(lang), lambda h, w: turned(h).bitwiseXOR(F.xxhash64(w)))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits set for the hashes of (lang, gram); they are put together by Spark, so the driver sees at most BITMAP / 64 numbers."""
    wanted = 32 * frequent.count()
    size = min(BITMAP, max(2**12, 1 << (wanted - 1).bit_length() if wanted else 0))
    h = _gram_hash(F.col("lang"), F.col("gram")).bitwiseAND(F.lit(size - 1))
    bits = frequent.select(h.alias("h")).selectExpr("shiftright(h, 6) at", "shiftleft(1L, int(h & 63)) bit")
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def level_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """lang, size, gram, n: all grams of 1 to `longest` words that occur `least` times in texts of a language, and size 0 with a
    null gram for the number of all its words. A null lang is `und`; a null or empty text has no words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    levels: list[DataFrame] = []
    for size in range(1, longest + 1):
        bits = _bitmap(levels[-1].where("gram is not null").select("lang", "gram")) if levels else None
        shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
        found = texts.mapInArrow(_shared_level(size, shared), "lang string, gram string, n long")
        counted = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("gram").isNull())
        levels.append(save(counted.select("lang", F.when(F.col("gram").isNull(), 0).otherwise(size).alias("size"), "gram", "n"), f"grams{size}"))
    return reduce(DataFrame.unionAll, levels)


def _shared_level(size: int, shared):
    return lambda batches: _level(size, None if shared is None else shared.value)(batches)


def _parts(words: Column, sizes: range) -> Column:
    """All runs of so many words of an array of words, as an array of strings."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.concat_ws(" ", F.slice(words, k, n)))
    return F.flatten(F.array(*map(of, sizes)))


def scored_phrases(grams: DataFrame, longest: int = 3, covered: int = 50, scale: int = 1_000_000) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of the candidates in level_counts() that no longer candidate covers.

    score is floor(scale * a * a / (l * r)) of the lowest-scoring cut (ties: after the fewest words), in decimals of 38 digits: exact
    for counts under 10^16. A candidate is covered by a longer one, covered itself or not, that has its words in one run and occurs
    `covered` percent as often."""
    counts = grams.select("lang", "gram", "n")
    phrases = grams.where("size >= 2").select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    cut = lambda k: F.struct(k.cast("int").alias("k"), F.concat_ws(" ", F.slice(words, 1, k)).alias("left"), F.concat_ws(" ", F.slice(words, k + 1, F.size(words))).alias("right"))
    cuts = phrases.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)).alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    left = counts.select("lang", F.col("gram").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("gram").alias("right"), F.col("n").alias("r"))
    wide = lambda x: f"cast({x} as decimal(38,0))"
    score = F.expr(f"({wide(scale)} * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    if longest > 2:
        inner = reduce(
            DataFrame.unionAll,
            [phrases.where(F.col("size") == size).select("lang", F.explode(_parts(words, range(2, size))).alias("phrase"), F.col("a").alias("longer")) for size in range(3, longest + 1)],
        )
        over = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        lowest = lowest.join(over, ["lang", "phrase"], "left").where(f"longer is null or {wide('longer')} * 100 < {wide('a')} * {covered}")
    totals = grams.where("size = 0").select("lang", F.col("n").alias("n"))  # a row for each language
    return lowest.join(totals, "lang").select("lang", "phrase", F.col("size").cast("int").alias("size"), "a", "low.l", "low.r", "n", "low.score")


def best_phrases(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, parts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, a (both descending) and phrase (UTF-8
    byte order), from docs (lang, text). Repeated rows count each time; other columns are not read; an empty table, or one without
    a frequent phrase, gives no rows. parts: how many first rounds of ranks a language has."""
    grams = level_counts(docs, longest, least)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = scored_phrases(grams, longest, covered).withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = save(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    drop(grams)
    return out
