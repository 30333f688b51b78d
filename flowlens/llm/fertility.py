"""Quality rules by tokeniser fertility.

Public vocabularies spell every word of a text. Text that their makers would have called language is spelled with few,
varied pieces; junk is not. Four measures decide, each with a rejection band of the text's language (or, without one, its
script): code points per token of a vocabulary with byte fallback and of a byte-level vocabulary for many languages, the
first one's share of byte-fallback tokens, and the entropy of its token distribution in bits, as a share of what its length
allows (log2 of its tokens, at most `entropy_cap` bits). A short text varies more than a long one, so the low limits depend
on its number of tokens; no text is exempt. The bands of languages are fitted on labelled texts by fit_bands.

The base counts come with them: words, code points in words, symbols, duplicate lines and words in repeated windows.

A null or empty text has no words, fails the base rule and is not kept. Very long texts are read whole. A null or unknown
language takes the script's band. A row for each row, repeated ones too; an empty table gives none. fertility_rules gives
back the columns it is asked to keep, keep_sound all; a column to keep that has the name of a measure is left out, as the measure takes its place.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Memo, hash_word, slices, window_hashes, word_bytes

#: Fixed: symbols and white space that the base counts name.
SYMBOLS, WHITE = "#*$%&|<>", "\t\n\x0b\x0c\r "


#: Numbers of tokens at which a band's low limits are given; between them they go with the logarithm.
ANCHORS = (16, 64, 128, 256, 512, 1024, 2048, 4096)


@dataclass(frozen=True)
class Band:
    """A text is rejected outside any of these. chars_per_token: low limits of the two vocabularies, chars_per_token_multi of the
    second; each one number, or one at each of ANCHORS. most_chars: the high limit of both."""

    chars_per_token: tuple[float, ...]
    chars_per_token_multi: tuple[float, ...]
    byte_share: float
    entropy_share: tuple[float, ...]
    most_chars: float = 8.0


#: Bands by language, as fit_bands finds them on the labelled documents of sf0.1, then by script, wide and without a fit.
BANDS: dict[str, Band] = {
    "en": Band((1.39, 1.39, 1.39, 1.8, 1.94, 2.02, 2.02, 2.12), (1.81, 1.81, 1.81, 1.93, 2.05, 2.07, 2.09, 2.13), 0.05, (0.866, 0.773, 0.754, 0.742, 0.742, 0.784, 0.82, 0.841)),
    "de": Band((1.24, 1.24, 1.24, 1.99, 2.01, 2.09, 2.13, 2.14), (1.56, 1.56, 1.56, 2.11, 2.12, 2.16, 2.18, 2.19), 0.05, (0.802, 0.802, 0.739, 0.738, 0.738, 0.774, 0.797, 0.815)),
    "es": Band((1.72, 1.72, 1.72, 1.74, 1.75, 1.77, 1.83, 1.84), (1.86, 1.86, 1.86, 1.86, 1.87, 1.94, 1.95, 1.97), 0.05, (0.729, 0.729, 0.729, 0.729, 0.73, 0.763, 0.802, 0.821)),
    "fr": Band((1.6, 1.6, 1.6, 1.6, 1.66, 1.8, 1.84, 1.89), (1.75, 1.75, 1.75, 1.75, 1.83, 1.87, 1.9, 1.95), 0.05, (0.747, 0.747, 0.747, 0.737, 0.737, 0.761, 0.792, 0.808)),
    "latin": Band((1.19, 1.19, 1.19, 1.55, 1.61, 1.72, 1.78, 1.79), (1.51, 1.51, 1.51, 1.7, 1.78, 1.82, 1.85, 1.9), 0.2, (0.75, 0.75, 0.7, 0.7, 0.7, 0.74, 0.77, 0.78)),
    "greek": Band((0.8,), (0.5,), 0.3, (0.6,), 6.0),
    "cyrillic": Band((1.0,), (0.8,), 0.2, (0.6,), 6.0),
    "hebrew": Band((0.6,), (0.4,), 0.6, (0.5,), 5.0),
    "arabic": Band((0.6,), (0.4,), 0.6, (0.5,), 5.0),
    "indic": Band((0.3,), (0.3,), 0.95, (0.4,), 4.0),
    "hangul": Band((0.4,), (0.3,), 0.9, (0.4,), 4.0),
    "han": Band((0.4,), (0.3,), 0.9, (0.4,), 3.0),
    "other": Band((0.2,), (0.2,), 1.0, (0.3,)),
}


def limit_at(limits: tuple[float, ...], n_tokens: int) -> float:
    if len(limits) == 1 or n_tokens <= ANCHORS[0]:
        return limits[0]
    if n_tokens >= ANCHORS[-1]:
        return limits[-1]
    k = bisect.bisect_right(ANCHORS, n_tokens) - 1
    part = math.log(n_tokens / ANCHORS[k]) / math.log(ANCHORS[k + 1] / ANCHORS[k])
    return limits[k] + part * (limits[k + 1] - limits[k])


def script_of(text: str) -> str:
    """The script of most letters, by code point blocks; `latin` where there are none."""
    if text.isascii():
        return "latin"
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.searchsorted([0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0x1100, 0x1200, 0x2E80, 0xAC00, 0xD7B0], at, "right")
    letters = at >= 0x41
    if not letters.any():
        return "latin"
    names = ("latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "other", "hangul", "other", "han", "hangul", "other")
    return names[int(np.bincount(kinds[letters], minlength=14).argmax())]


def base_counts(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 5:
        hashes = window_hashes(np.fromiter(map(hash_word, words), np.uint64, n), 5)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        if same.any():
            twice = np.zeros(len(hashes), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + 5, -1)
            repeated = int((np.cumsum(step[:n]) > 0).sum())
    return n, chars, symbols, dup, repeated


@functools.lru_cache(maxsize=2)
def _model(path: str):
    """The vocabulary, which is of a fixed size, and which of its pieces are bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@functools.lru_cache(maxsize=2)
def _ranks(path: str):
    """A byte-level vocabulary from a file of a token in base 64 and its rank on each line."""
    import public_tokenizers
    from tiktoken import Encoding

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Speller:
    """Piece ids of words in two vocabularies, remembered within a bound."""

    #: Marks the entry behind a word's piece ids that holds its number of tokens in the second vocabulary.
    COUNT = 1 << 31

    def __init__(self, path: str | None = None, multi: str | None = None, held: int = 80_000_000):
        self.model, self.is_byte = _model(path or default_path())
        self.multi = _ranks(multi or default_multi())
        self.pieces = Memo(lambda word: self._spell([word])[0], most=held)

    def _spell(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self.model.encode(texts, num_threads=1)
        return [array("I", [*own, self.COUNT + len(self.multi.encode_ordinary(f" {text}"))]).tobytes() for own, text in zip(ids, texts, strict=True)]

    def learn(self, texts: list[list[bytes]]) -> None:
        """Spells the words of some texts that aren't known yet together, which takes a fraction of one by one."""
        self.pieces.trim()
        new = [w for w in set().union(*texts) if w not in self.pieces]
        for word, spelled in zip(new, self._spell(new) if new else [], strict=True):
            self.pieces[word] = spelled
            self.pieces.note(word, spelled)

    def measures(self, words: list[bytes], chars: int) -> tuple[int, float, float, float, float]:
        """n_tokens, code points per token in each vocabulary, byte-fallback share, entropy in bits."""
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, words)), "<u4")
        counts = ids >= self.COUNT
        multi, ids = int((ids[counts] - np.uint32(self.COUNT)).sum(dtype=np.int64)), ids[~counts]
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0, 0.0
        each = np.bincount(ids)
        each = each[each > 0]
        return n, chars / n, chars / max(1, multi), float(self.is_byte[ids].mean()), float(np.log2(n) - (each * np.log2(each)).sum() / n)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_multi() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def entropy_share(n_tokens: int, entropy: float, cap: float) -> float:
    """1 for a single token."""
    return entropy / min(math.log2(n_tokens), cap) if n_tokens > 1 else 1.0


def within(band: Band, n_tokens: int, per_token: float, per_token_multi: float, byte_share: float, entropy: float, entropy_cap: float) -> bool:
    low = lambda limits: limit_at(limits, n_tokens)
    return (
        low(band.chars_per_token) <= per_token <= band.most_chars
        and low(band.chars_per_token_multi) <= per_token_multi <= band.most_chars
        and byte_share <= band.byte_share
        and entropy_share(n_tokens, entropy, entropy_cap) >= low(band.entropy_share)
    )


FERTILITY = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, chars_per_token_multi double, byte_share double, token_entropy double, band string, kept boolean"
)


def _judge(own: Speller, bands: dict[str, Band], texts: list[str | None], langs: list[str | None], entropy_cap: float) -> list[tuple]:
    """FERTILITY's values of each text; the texts' words are held at a time."""
    words = [word_bytes(x) for x in texts]
    own.learn(words)
    return [_judge_one(own, bands, *x, entropy_cap) for x in zip(texts, words, langs, strict=True)]


def _judge_one(own: Speller, bands: dict[str, Band], text: str | None, words: list[bytes], lang: str | None, entropy_cap: float) -> tuple:
    base = base_counts(text, words)
    failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
    found = own.measures(words, base[1])
    name = lang if lang in bands else script_of(text or "")
    ok = not failed and (name not in bands or within(bands[name], *found, entropy_cap))
    return (*base, failed, *found, name, ok)


def keep_sound(docs: DataFrame, bands: dict[str, Band] | None = None, path: str | None = None, multi: str | None = None, entropy_cap: float = 8.0, held: int = 80_000_000) -> DataFrame:
    """docs, with all its columns, without the rows that fertility_rules doesn't keep. held: bytes of spelled words that a task remembers."""
    bands = BANDS if bands is None else bands
    has_lang = "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string"

    def run(batches):
        own = Speller(path, multi, held)
        for batch in (part for whole in batches for part in slices(whole)):
            langs = batch.column("lang").to_pylist() if has_lang else [None] * batch.num_rows
            keep = [x[-1] for x in _judge(own, bands, batch.column("text").to_pylist(), langs, entropy_cap)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fertility_rules(
    docs: DataFrame, bands: dict[str, Band] | None = None, path: str | None = None, multi: str | None = None, entropy_cap: float = 8.0, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` of docs (which has text and may have lang) and those of FERTILITY, a row for each row."""
    bands = BANDS if bands is None else bands
    keep = tuple(c for c in keep if c not in {x.split()[0] for x in FERTILITY.split(", ")})
    has_lang = "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string"
    columns = list(dict.fromkeys([*keep, "text", *["lang"] * has_lang]))

    def run(batches):
        own = Speller(path, multi)
        for batch in (part for whole in batches for part in slices(whole)):
            langs = batch.column("lang").to_pylist() if has_lang else [None] * batch.num_rows
            rows = _judge(own, bands, batch.column("text").to_pylist(), langs, entropy_cap)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), *[pa.float64()] * 4, pa.string(), pa.bool_()]
            made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            names = [x.split()[0] for x in FERTILITY.split(", ")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, *names])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*columns).mapInArrow(run, f"{own}, {FERTILITY}")


def fit_bands(docs: DataFrame, labels: DataFrame, slack: tuple[float, float, float] = (0.05, 0.05, 0.01), least: int = 8, byte_share: float = 0.05, entropy_cap: float = 8.0) -> dict[str, Band]:
    """The band of each language from its labelled good texts that pass the base rule. docs: doc_id, text, lang; labels: doc_id and
    quality, 1 for good. At each of ANCHORS the low limits are the least measures of the texts within a factor of two of that
    length, less slack (of characters per token in each vocabulary, of the entropy share). An anchor with under `least` texts
    takes the limit of the next longer one, or else the next shorter one. Only these minima come to the driver."""
    measured = fertility_rules(docs, {}, entropy_cap=entropy_cap, keep=("doc_id", "lang")).where("not base_failed and lang is not null and n_tokens > 1")
    good = measured.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    share = F.col("token_entropy") / F.least(F.log2("n_tokens"), F.lit(entropy_cap))
    near = F.filter(F.array(*map(F.lit, ANCHORS)), lambda a: (F.col("n_tokens") >= F.when(a == ANCHORS[0], 0).otherwise(a / 2)) & (F.col("n_tokens") < F.when(a == ANCHORS[-1], 2**62).otherwise(a * 2)))
    rows = good.select("lang", F.explode(near).alias("anchor"), "chars_per_token", "chars_per_token_multi", share.alias("share")).groupBy("lang", "anchor")
    found = {(r["lang"], r["anchor"]): (r["a"], r["b"], r["c"]) for r in rows.agg(F.count(F.lit(1)).alias("n"), F.min("chars_per_token").alias("a"), F.min("chars_per_token_multi").alias("b"), F.min("share").alias("c")).where(F.col("n") >= least).collect()}
    bands = {}
    for lang in sorted({x for x, _ in found}):
        at = [k for k, a in enumerate(ANCHORS) if (lang, a) in found]
        nearest = [min(at, key=lambda j: (j < k, abs(j - k))) for k in range(len(ANCHORS))]
        limits = [tuple(round(found[lang, ANCHORS[j]][m] - slack[m], 3) for j in nearest) for m in range(3)]
        bands[lang] = Band(limits[0], limits[1], byte_share, limits[2])
    return bands
