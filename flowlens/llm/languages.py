"""Language identification by a mixture of languages for each text.

A language's model is the share of each letter window (a letter and its two neighbours, lower-cased; whatever is no letter is one
gap) among all windows of its training texts, hashed into a table of fixed size and smoothed. A text is taken to be a mixture: each
of its windows comes from one language, languages have proportions. Expectation-maximisation finds the proportions that make the
text likeliest. The set of languages begins with the likeliest single one and grows by the language in whose direction the likelihood
rises fastest, for as long as the gain exceeds a penalty of `weight` / 2 * log(windows) for each language (neighbouring windows share
letters, so they count for less than independent ones: `weight` is 3). The language with the largest proportion is the prediction.

Windows of all training texts are counted; partial counts are summed by Spark, and the summed table is all that the driver sees: at
most TABLE numbers, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Numbers in the table of all languages at most, and hashed windows of a language at most and at least.
TABLE, MOST_WINDOWS, LEAST_WINDOWS = 2**24, 2**16, 2**12
#: Code points of a text that are looked at together; windows over a cut are kept.
PIECE = 1 << 20
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 for what is no letter."""
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                _letters[c] = ord(x.lower()[0])
    return _letters


def window_hashes(text: str, windows: int):
    """Hashes (under `windows`, a power of two) of the windows around each letter of the text, piece by piece."""
    table, shift = letters(), np.uint64(64 - windows.bit_length() + 1)
    for low in range(0, len(text), PIECE):
        part = text[max(0, low - 1) : low + PIECE + 1]
        x = np.zeros(len(part) + 2, np.uint64)
        x[1:-1] = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")]
        if low:
            x = x[1:]  # the first code point is a neighbour only
        if low + PIECE < len(text):
            x = x[:-1]
        at = np.flatnonzero(x[1:-1]) + 1
        if len(at):
            mixed = (x[at - 1] << np.uint64(42)) ^ (x[at] << np.uint64(21)) ^ x[at + 1]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            yield ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64)


@dataclass
class LanguageModel:
    """names: the languages in order; log_share[window, language]: natural logarithm of a window's share."""

    names: list[str]
    log_share: np.ndarray
    weight: float = 3.0

    def mixture(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The languages of a text, in the order in which they were chosen, and their proportions. Without letters none."""
        windows, languages = self.log_share.shape
        if not text or not languages:
            return [], np.zeros(0)
        counts: np.ndarray | None = None
        for hashes in window_hashes(text, windows):
            if counts is None and len(text) <= PIECE:
                held, n = np.unique(hashes, return_counts=True)
                break
            counts = (0 if counts is None else counts) + np.bincount(hashes, minlength=windows)
        else:
            if counts is None:
                return [], np.zeros(0)
            held = np.flatnonzero(counts)
            n = counts[held]
        n = n.astype(np.float64)
        logs, total = self.log_share[held].astype(np.float64), float(n.sum())
        single = n @ logs
        chosen, share = [int(np.argmax(single))], np.ones(1)
        if languages == 1:
            return chosen, share
        ratio = np.exp(np.clip(logs - logs[:, chosen], -600, 600))  # to the likeliest single language
        mixed, best = np.ones(len(n)), 0.0  # the mixture's share of each window and the text's likelihood, both relative to it
        penalty = self.weight / 2 * np.log(total + 1)
        while len(chosen) < languages:
            slope = (n / mixed) @ ratio / total
            slope[chosen] = 0
            new = int(np.argmax(slope))
            if slope[new] <= 1:  # no other language makes the text likelier
                break
            part, now = ratio[:, [*chosen, new]], np.append(share * 0.9, 0.1)
            for _ in range(100):
                joint = part * now
                under = joint.sum(axis=1)
                then = (n / under) @ joint / total
                done = np.abs(then - now).max() < 1e-4
                now = then
                if done:
                    break
            under = part @ now
            gain = float(n @ np.log(under))
            if gain - best <= penalty:
                break
            chosen, share, mixed, best = [*chosen, new], now, under, gain
        return chosen, share

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """The main language, its proportion, and all languages with theirs, by proportion and name."""
        chosen, share = self.mixture(text)
        found = sorted((-float(s), self.names[k]) for k, s in zip(chosen, share, strict=True))
        if not found:
            return UNDETERMINED, 0.0, [], []
        return found[0][1], min(1.0, -found[0][0]), [x for _, x in found], [-s for s, _ in found]


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4, is 2. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(texts: DataFrame, weight: float = 3.0, smoothing: float = 0.05) -> LanguageModel:
    """Counts the windows of all texts (text, lang). Rows with a null text or lang are left out. A table without letters gives a
    model without languages. With more languages each gets a smaller table, so that all fit in TABLE numbers; over TABLE /
    LEAST_WINDOWS languages (4,096) are refused, as no column of languages has so many."""
    kept = texts.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    names = sorted(r["lang"] for r in kept.select("lang").distinct().limit(TABLE // LEAST_WINDOWS + 1).collect())
    if len(names) > TABLE // LEAST_WINDOWS:
        raise ValueError(f"more than {TABLE // LEAST_WINDOWS} languages")
    windows = MOST_WINDOWS
    while windows * len(names) > TABLE:
        windows //= 2

    def counted(batches):
        held: dict[str, np.ndarray] = {}

        def out(lang: str) -> pa.RecordBatch:
            n = held.pop(lang)
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "window", "n"])

        for batch in (part for whole in batches for part in slices(whole)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in held:
                    if len(held) * windows >= TABLE // 4:
                        yield out(next(iter(held)))
                    held[lang] = np.zeros(windows, np.int64)
                for hashes in window_hashes(text, windows):
                    held[lang] += np.bincount(hashes, minlength=windows)
        for lang in list(held):
            yield out(lang)

    rows = kept.mapInArrow(counted, "lang string, window int, n long").groupBy("lang", "window").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((windows, len(names)))
    number = {x: k for k, x in enumerate(names)}
    of = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[rows.column("window").to_numpy(), of] = rows.column("n").to_numpy()
    learned = np.flatnonzero(counts.sum(axis=0))
    counts, names = counts[:, learned], [names[k] for k in learned]
    log_share = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * windows)) if names else counts
    return LanguageModel(names, log_share.astype(np.float32), weight)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the proportion of lang_pred), langs, shares: a row for each row of docs (doc_id, text);
    other columns are not read. A null text, one without letters, or a model without languages gives `und`, 0 and empty lists."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 * TABLE bytes

    def run(batches):
        known = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            found = [known.predict(text) for text in batch.column("text").to_pylist()]
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "held_out", "lang_pred", "score", "langs", "shares"])

    asked = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")


def identify(docs: DataFrame) -> DataFrame:
    """predict_languages() of all docs (doc_id, text, lang), learned from those that are not held out."""
    return predict_languages(docs, fit_languages(docs.where(~is_held_out(F.col("doc_id"))).select("text", "lang")))
