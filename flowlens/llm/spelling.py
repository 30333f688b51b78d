"""Spelling variants by letter-parity bitmasks.

A word's mask has a bit for each of the 90 letters that a run can hold: whether the letter occurs an odd number of times. One
replaced letter flips two bits, one inserted or deleted letter flips one. The letters are dealt over three bands by how often they
occur, so that the bands tell words apart about equally well. Two words of one length that are one edit apart thus agree in a band;
two words whose lengths differ by one agree in two bands and differ by one bit in the third.

Words meet by equal bands and length, and, as few bands are told apart by short words, by an equal half as well: an edit in one half
of a word leaves the other half as it is. Every word has six keys for words of its own length and six for longer and for shorter
ones; no pair is missed, and each pair is taken at one of its keys only. What is left is verified letter by letter. All of this is
joins on hashes of (length, bands, half): no block is held by one task, and adaptive execution splits a key that many words share.
All joins are sort-merge joins by hint: Spark sizes rows after an explode as if there were one for each word, and would broadcast them.

Counting: tasks count runs text by text and hand on partial counts; a word that a third of all rows have is one row of each task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce
from operator import xor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, save
from .words import slices

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
BANDS, BAND_BITS = 3, 30


def _misspelt(run: str, start: int, every: int) -> str:
    """The run, or without one of its letters where its checksum (crc32 begun with `<doc_id>:`) is divisible by `every`."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(every: int, letters: int, most: int = 16_000_000):
    """Per task: (word, n), handed on when what is held passes about 8 * `most` bytes (long words by their length)."""

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[str, int] = {}
        size = 0
        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(lower)).items():
                    word = _misspelt(word, start, every)
                    if len(word) < letters:
                        continue
                    if word in held:
                        held[word] += n
                    else:
                        held[word] = n
                        size += 24 + len(word)
                if size > most:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    return run


def count_words(docs: DataFrame, letters: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word, n: the lower-cased (A-Z) letter runs of all texts, every so often misspelt by a fixed rule, that have at least
    `letters` code points and occur `least` times. A null text has none; a null doc_id counts as an empty one."""
    found = docs.select("doc_id", "text").mapInArrow(_counted(every, letters), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _with_masks(words: DataFrame) -> DataFrame:
    """words with size (code points) and the three bands of the mask. Letters are dealt over the bands from the most frequent on."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where(F.col("letter").isin(*LETTERS)).groupBy("letter").count()
    often = {r["letter"]: r["count"] for r in letters.collect()}  # at most 90 rows
    order = sorted(LETTERS, key=lambda x: (-often.get(x, 0), x))
    band = [0, 1, 2, 2, 1, 0]
    bit = {x: 1 << (BAND_BITS * band[k % 6] + k // 6 * 2 + (k % 6 > 2)) for k, x in enumerate(order)}

    def run(batches):
        part = (1 << BAND_BITS) - 1
        for batch in batches:
            found = batch.column("word").to_pylist()
            masks = [reduce(xor, map(bit.__getitem__, w), 0) for w in found]
            bands = [pa.array([m >> (BAND_BITS * k) & part for m in masks], pa.int32()) for k in range(BANDS)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(map(len, found), pa.int32()), *bands], names=["word", "n", "size", "b0", "b1", "b2"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, b0 int, b1 int, b2 int")


def _keyed(words: DataFrame, size: Column, bands: list[tuple[str, ...]], halves: tuple[Column, Column]) -> DataFrame:
    """A row of words for each key: part is the number of (bands, half), key a hash of what they hold."""
    keys = [F.struct(F.lit(2 * i + j).alias("part"), F.xxhash64(F.lit(2 * i + j), size, *names, half).alias("key")) for i, names in enumerate(bands) for j, half in enumerate(halves)]
    return words.select("*", F.explode(F.array(*keys)).alias("at")).select("word", "n", "size", "b0", "b1", "b2", "at.part", "at.key")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each unordered pair of distinct words (word, n; letters only) that one inserted, deleted or replaced code
    point makes equal, once. Words must be distinct."""
    masked = _with_masks(words)
    word, size = F.col("word"), F.col("size")
    left, right = (lambda w, h: F.substring(w, F.lit(1), h)), (lambda w, h: F.substring(w, h + 1, F.length(w)))
    half = F.floor(size / 2).cast("int")
    of_short = (left(word, half), right(word, half))
    short_half = F.floor((size - 1) / 2).cast("int")
    of_long = (left(word, short_half), right(word, short_half + 1))
    flips = lambda k: F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}")))

    # one length: two bits flip, in one band or in two
    same = _keyed(masked, size, [("b0",), ("b1",), ("b2",)], of_short)
    x, y = same.alias("x"), same.alias("y")
    agree = [F.col(f"x.b{k}") == F.col(f"y.b{k}") for k in range(BANDS)]
    first = F.when(agree[0], 0).when(agree[1], 1).when(agree[2], 2)
    mine = F.floor(F.col("x.part") / 2) == first  # of two bands that agree the first one counts; two halves can't both be equal
    replaced = x.join(
        y.hint("merge"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.word") < F.col("y.word"))
        & (F.col("x.size") == F.col("y.size")) & (flips(0) + flips(1) + flips(2) == 2) & mine
        & (F.levenshtein("x.word", "y.word", 1) == 1),
    )

    # lengths that differ by one: one bit flips, so two bands agree
    two = [("b1", "b2"), ("b0", "b2"), ("b0", "b1")]
    x, y = _keyed(masked, size, two, of_short).alias("x"), _keyed(masked, size - 1, two, of_long).alias("y")
    h = F.floor(F.col("x.size") / 2).cast("int")
    by_left = F.col("x.part") % 2 == 0
    left_equal = left(F.col("x.word"), h) == left(F.col("y.word"), h)
    in_band = reduce(lambda a, b: a | b, [(F.floor(F.col("x.part") / 2) == k) & (flips(k) == 1) for k in range(BANDS)])
    added = x.join(
        y.hint("merge"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.size") == F.col("y.size") - 1)
        & (flips(0) + flips(1) + flips(2) == 1) & in_band & (by_left | ~left_equal)
        & (F.levenshtein("x.word", "y.word", 1) == 1),
    )
    columns = [F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")]
    return replaced.select(*columns).unionAll(added.select(*columns))


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n; distinct words).

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least `ratio` times the word's, else
    null. root: where the forms lead. ratio must be over 1, or forms might lead in a circle. An empty table gives an empty one.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = save(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    side = lambda to, of, n: F.struct(F.col(to).alias("word"), F.col(of).alias("other"), F.col(n).alias("m"))
    both = pairs.select(F.explode(F.array(side("a", "b", "b_n"), side("b", "a", "a_n"))).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("down"), "other")).alias("best"))
    strong = -F.col("best.down") >= ratio * F.col("n")
    formed = save(
        words.join(best.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.down")).alias("form_n")
        ),
        "forms",
    )
    drop(words)
    # each round a word takes its root's root: the rounds are the logarithm of the longest chain, whose counts at least double
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    held: DataFrame | None = None
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = save(roots.join(far.hint("merge"), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        if held is not None:
            drop(held)
        held, roots = after, after.select("word", "root")
        if not moved:
            break
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, letters: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """group_variants() of the words of docs (doc_id, text). Repeated rows count each time; other columns are not read."""
    return group_variants(count_words(docs, letters, least, every))
