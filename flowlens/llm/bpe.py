"""BPE encoding by a pair occurrence index, and decoding.

A text is cut at white space into chunks, chunks into the vocabulary's words, and a word's ids are looked up. Words not
yet known in a task are gathered from a stretch of texts and merged together: every adjacent pair points to all its
positions, the active pairs are applied in ascending rank, and each merge updates the lists of the pairs it makes and
breaks. So a rank costs what it occurs, and no word is scanned for its best pair again.

The result is that of the vocabulary's own library: NFC, lower case, white space dropped, a mark on a word's last byte.
Texts of plain Latin letters take a direct path; a text with other characters is normalised and split by the
library's components, and its special tokens are found first, as the library does. A null text is empty: no ids. A row
for each row, repeated ones too; an empty table gives none; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Memo, slices

#: Fixed: the last code point of the direct path and of what its lower-casing gives, and control characters that Python's split() takes for white space.
_LAST_LATIN, _LAST_LOWER, _NOT_SPACE = 0x17F, 0x2FF, "\x1c-\x1f"
#: Fixed: contractions that the vocabulary's pattern takes first, in its order.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: printable bytes stand for themselves, the
    others get the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST_LOWER + 1) if unicodedata.category(chr(c))[0] == kind)


class PairIndexBpe:
    """The vocabulary of one file, and merging by the pair index."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.letters = _byte_letters()
        self.first = [vocab[x] for x in self.letters]
        self.last = [vocab[x + self.end] for x in self.letters]
        self.byte_of = {x: i for i, x in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)
        letter, number = _latin("L"), _latin("N")
        self.pattern = re.compile("|".join([*_CONTRACTIONS, f"[{letter}]+", f"[{number}]", f"[^\\s{letter}{number}]+"]))
        self.odd = re.compile(f"[^\\x00-{chr(_LAST_LATIN)}]|[{_NOT_SPACE}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (its UTF-8 bytes), as little-endian 32-bit integers."""
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        for word in words:
            at, n = len(symbol), len(word)
            starts.append(at)
            symbol.extend(map(self.first.__getitem__, word[:-1]))
            symbol.append(self.last[word[-1]])
            after.extend(range(at + 1, at + n))
            after.append(-1)
            before.append(-1)
            before.extend(range(at, at + n - 1))
        merges, where, heap = self.merges, {}, []
        for at, nxt in enumerate(after):
            if nxt >= 0:
                pair = symbol[at] << 20 | symbol[nxt]
                held = where.get(pair)
                if held is not None:
                    held.append(at)
                elif pair in merges:
                    where[pair] = [at]
                    heap.append((merges[pair][0], pair))
        heapq.heapify(heap)
        while heap:
            rank, pair = heapq.heappop(heap)
            places = where.pop(pair, None)
            if places is None:
                continue
            a, b, new = pair >> 20, pair & 0xFFFFF, merges[pair][1]
            places.sort()
            for k, at in enumerate(places):
                nxt = after[at]
                if symbol[at] != a or nxt < 0 or symbol[nxt] != b:
                    continue
                symbol[at], symbol[nxt] = new, -1
                over = after[at] = after[nxt]
                lowest = rank
                if over >= 0:
                    before[over] = at
                    made = new << 20 | symbol[over]
                    if made in merges:
                        if made in where:
                            where[made].append(at)
                        else:
                            where[made] = [at]
                            heapq.heappush(heap, (merges[made][0], made))
                        lowest = min(lowest, merges[made][0])
                prev = before[at]
                if prev >= 0:
                    made = symbol[prev] << 20 | new
                    if made in merges:
                        if made in where:
                            where[made].append(prev)
                        else:
                            where[made] = [prev]
                            heapq.heappush(heap, (merges[made][0], made))
                        lowest = min(lowest, merges[made][0])
                if lowest < rank and k + 1 < len(places):  # the lower rank goes first, then the rest of this pair
                    where.setdefault(pair, []).extend(places[k + 1 :])
                    heapq.heappush(heap, (rank, pair))
                    break
        flat = np.array(symbol, np.int64)
        kept = flat >= 0
        ids = flat[kept].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(kept)]) * 4
        starts.append(len(symbol))
        cuts = ends[starts].tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def library_words(self, words: list[bytes]) -> list[bytes]:
        """The same ids from the library's own merging, word by word."""
        cut, spell = self.library.model.tokenize, self.letters.__getitem__
        return [struct.pack(f"<{len(x)}I", *[t.id for t in x]) for x in (cut("".join(map(spell, w))) for w in words)]


class TextEncoder:
    """Texts to ids, with one bounded memory of words and of chunks of words and signs. `merge` gives the ids of words not seen
    before; the pair index gets those of a stretch of texts together, the library one by one."""

    def __init__(self, bpe: PairIndexBpe, merge=None, held: int = 160_000_000):
        self.bpe, self.merge, self.together = bpe, merge or bpe.merge_words, merge is None
        self.known = Memo(self._chunk, most=held)

    def _chunk(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isalpha() else self.bpe.pattern.findall(chunk)
        if words == [chunk]:
            return self.merge([chunk.encode("utf-8")])[0]
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, words) -> None:
        new = [w for w in words if w not in self.known]
        if new:
            for word, ids in zip(new, self.merge([w.encode("utf-8") for w in new]), strict=True):
                self.known[word] = ids
                self.known.note(word, ids)

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            return not any(c in text for c in "\x1c\x1d\x1e\x1f")
        except UnicodeEncodeError:
            return not self.bpe.odd.search(text)

    def _odd(self, text: str) -> bytes:
        """By the library's own special tokens, normaliser and splitter."""
        out = []
        for part in self.bpe.specials.split(text) if self.bpe.specials else [text]:
            if part in self.bpe.special:
                out.append(np.array([self.bpe.special[part]], "<u4").tobytes())
                continue
            spelled = self.bpe.library.pre_tokenizer.pre_tokenize_str(self.bpe.library.normalizer.normalize_str(part))
            raw = [bytes(map(self.bpe.byte_of.__getitem__, w)) for w, _ in spelled]
            new = list(dict.fromkeys(raw))
            ids = dict(zip(new, self.bpe.merge_words(new), strict=True)) if new else {}
            out += map(ids.__getitem__, raw)
        return b"".join(out)

    def encode(self, texts: list[str | None], stretch: int = 3_000_000):
        """Yields each text's ids. Texts are taken in stretches of about `stretch` characters."""
        at = 0
        while at < len(texts):
            n, end = 0, at
            while end < len(texts) and (end == at or n < stretch):
                n += len(texts[end] or "")
                end += 1
            yield from self._stretch(texts[at:end])
            at = end

    def _stretch(self, texts):
        self.known.trim()
        split, new = [], set()
        for text in texts:
            plain = not text or (self._plain(text) and not (self.bpe.specials and self.bpe.specials.search(text)))
            if plain:
                chunks = (text or "").lower().split()
                if not self.together:
                    yield b"".join(map(self.known.__getitem__, chunks))
                    continue
                split.append(chunks)
                new.update([c for c in set(chunks) if c not in self.known])
            elif self.together:
                split.append(text)
            else:
                yield self._odd(text)
        if new:
            self._learn({w for c in new for w in self.bpe.pattern.findall(c)})
        for chunks in split:
            yield self._odd(chunks) if isinstance(chunks, str) else b"".join(map(self.known.__getitem__, chunks))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encoder(path: str, by_library: bool = False, held: int = 160_000_000) -> TextEncoder:
    """A new one for each task: the vocabulary is of a fixed size and stays with the worker, what has been encoded goes."""
    bpe = vocabulary(path)
    return TextEncoder(bpe, bpe.library_words if by_library else None, held)


def decode(bpe: PairIndexBpe, ids: bytes) -> str:
    """What the library's decode gives for a vocabulary without a decoder: the tokens, special ones too, joined by a space."""
    return " ".join(map(bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded: one row per row of docs (doc_id, text)."""

    def run(batches):
        bpe, enc = vocabulary(path or default_path()), encoder(path or default_path())
        for batch in (part for whole in batches for part in slices(whole, 2048)):
            ids = list(enc.encode(batch.column("text").to_pylist()))
            for low in range(0, max(1, len(ids)), 256):
                part = ids[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, 256), pa.array(part, pa.binary()), pa.array([decode(bpe, x) for x in part], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, which then never leave the task."""

    def run(batches):
        bpe, enc = vocabulary(path or default_path()), encoder(path or default_path())
        for batch in (part for whole in batches for part in slices(whole, 2048)):
            n, of_ids, of_text = [], [], []
            for ids in enc.encode(batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decode(bpe, ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
