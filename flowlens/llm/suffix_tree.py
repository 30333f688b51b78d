"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are lower-cased (A-Z) words and one end for each text. The tree's root knows every word of the training texts.
Deeper states are variable-length contexts; a context becomes a state if it occurs twice, its suffix is a state (and so is
what lies between its first and last word), and the divergence of its next-word distribution from its suffix's passes a
test. Contexts grow for as long as that keeps any. A state keeps every next word seen twice after it, discounted; the rest of its mass is shared out as its suffix shares it,
so every state's distribution sums to 1. A token is scored by the longest suffix that is a state. At the root, words seen
in training are discounted by the share of words seen once, and what that frees goes to the unknown word, one symbol as in
the base score.

Evidence is absolute (`least` occurrences), so the tree grows with the corpus; no table of it is collected, broadcast or
held by one task. Texts are held in chunks of about `chunk_tokens` tokens. In each round a chunk asks for its distinct
n-grams (or contexts) with its own part of the count (or of the divergence), dealt over buckets by hash; a bucket adds the
parts up and answers each chunk. A frequent n-gram is thus one key of each chunk and makes no task large. Of each n-gram
one chunk is the owner, which brings its term of the divergence. N-grams are told apart by hashes of 64 bits, sent with as
many of them as make a chance meeting less likely than one in a million for the corpus at hand.

Through the first `replayed` levels a chunk goes from its texts and the answers anew in each round, which is cheaper than
keeping what it knows of each token. Then few tokens still have a state to extend (a tenth, and ever fewer); those alone
are kept, and further levels cost what these tokens cost.

A null or empty text is the end alone. Rows with a null doc_id train. Without training tokens every token is unknown. A very
long text is a chunk of its own. A chunk may ask nothing (no repeated pair, empty texts only); it then has no answer to wait for.

Between rounds logarithms and parts of divergences travel in steps of 2^-31, so a score depends on the chunking by about 1e-9 a
token, and a context whose divergence lies that near the limit may be a state under one chunking and none under another.
Repeated rows are scored, and counted, as often as they come. An empty table gives no rows; columns other than doc_id and
text are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import deal, drop, forget, save
from .words import hash_word, mix, slices

#: The end of a text among the tokens; no word is empty.
END = b""


class Tree:
    """The same model in memory, for small tables: the tests hold score_texts against it. Words are numbers; 0 to top - 1
    occur in contexts.

    levels[k] has the states of depth k + 1: `states` (sorted codes of contexts), `back` (log10 of what a state's other
    words are multiplied by), and `codes` and `logs` (sorted codes of state number and next word, log10 probability).
    A context's code is its suffix order in base top: (older words) * top + newest word.
    """

    def __init__(self, words: list[bytes], top: int, root: np.ndarray):
        self.number = {w: i for i, w in enumerate(words)}
        self.top, self.root, self.levels = top, root, []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """-1 for words that are not frequent."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def contexts(self, numbers: np.ndarray, depth: int) -> np.ndarray:
        """The code of the `depth` words before each token, or -1 where they are not all top words."""
        n, code = len(numbers), np.zeros(len(numbers), np.int64)
        ok = np.ones(n, bool)
        for back in range(depth, 0, -1):
            word = np.full(n, -1, np.int64)
            word[back:] = numbers[: n - back] if back < n else word[back:]
            ok &= (word >= 0) & (word < self.top)
            code = code * self.top + word
        return np.where(ok, code, -1)

    def state_of(self, level: int, context: np.ndarray) -> np.ndarray:
        """The number of each context's state at a level, or -1."""
        states = self.levels[level]["states"]
        if not len(states):
            return np.full(len(context), -1, np.int64)
        at = np.minimum(np.searchsorted(states, context), len(states) - 1)
        return np.where(states[at] == context, at, -1)

    def logs(self, numbers: np.ndarray, context_of: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each token log10 of its probability as far as the tree knows it, and whether the root's word is still to
        be multiplied in (a word that is not frequent)."""
        out, open_ = np.zeros(len(numbers)), np.ones(len(numbers), bool)
        for level in range(len(self.levels) - 1, -1, -1):
            t = self.levels[level]
            context = self.contexts(numbers, level + 1) if context_of is None else context_of[level]
            state = np.where(open_, self.state_of(level, context), -1)
            in_state = np.flatnonzero(state >= 0)
            if not len(in_state):
                continue
            code = state[in_state] * self.top + numbers[in_state]
            known = (numbers[in_state] >= 0) & (numbers[in_state] < self.top)
            at = np.minimum(np.searchsorted(t["codes"], code), max(0, len(t["codes"]) - 1))
            hit = known & (t["codes"][at] == code) if len(t["codes"]) else np.zeros(len(code), bool)
            out[in_state[hit]] += t["logs"][at[hit]]
            open_[in_state[hit]] = False
            out[in_state[~hit]] += t["back"][state[in_state[~hit]]]
        local = open_ & (numbers >= 0)
        out[local] += self.root[numbers[local]]
        return out, open_ & (numbers < 0)

    def grow(self, contexts: np.ndarray, totals: np.ndarray, owner: np.ndarray, word: np.ndarray, n: np.ndarray, divergence: float, discount: float) -> None:
        """Adds a level. contexts: sorted codes and how often each occurs; owner, word, n: the frequent next words of
        context number owner."""
        level = len(self.levels)
        back = np.zeros(len(contexts))
        if len(owner):
            share = (n - discount) / totals[owner]
            # the suffix's probability of each word: contexts of one word less, newest word last
            suffix = [contexts % self.top**k for k in range(1, level + 1)]
            below = self.logs(word, [s[owner] for s in suffix])[0] if level else self.root[word]
            under = 10.0**below
            kept, taken = np.bincount(owner, share, len(contexts)), np.bincount(owner, under, len(contexts))
            rest, left = np.maximum(1 - kept, 1e-9), np.maximum(1 - taken, 1e-9)
            far = np.bincount(owner, share * np.log(share / under), len(contexts)) + rest * np.log(rest / left)
            back = np.log10(rest / left)
        else:
            share, far = np.zeros(0), np.zeros(len(contexts))
        fine = far >= divergence
        renumber = np.cumsum(fine) - 1
        keep = fine[owner] if len(owner) else np.zeros(0, bool)
        codes, logs = renumber[owner[keep]] * self.top + word[keep], np.log10(share[keep])
        order = np.argsort(codes)
        self.levels.append({"states": contexts[fine], "back": back[fine], "codes": codes[order], "logs": logs[order]})


def is_held_out(doc_id):
    """crc32 of the doc_id as text, modulo 10, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _pack(x: np.ndarray, ordered: bool = False) -> bytes:
    """The values byte by byte of the same order, compressed; ordered: as differences. Doubles are kept in steps of 2^-31, most of
    which are fewer bytes; NaN is the least integer."""
    if x.dtype == np.float64:
        x = np.where(np.isnan(x), np.iinfo(np.int64).min, np.rint(np.nan_to_num(x) * 2.0**31)).astype(np.int64)
    x = np.diff(x, prepend=x.dtype.type(0)) if ordered else x
    each = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize)
    planes = np.empty(each.shape[::-1], np.uint8)
    for k in range(len(planes)):  # faster than a transposition
        planes[k] = each[:, k]
    return np.int64(x.size).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    size, width, fixed = int(np.frombuffer(data, np.int64, 1)[0]), np.dtype(kind).itemsize, np.dtype(kind) == np.float64
    planes = pa.decompress(data[8:], size * width, codec="zstd", asbytes=True)
    x = np.empty(size, np.int64 if fixed else kind)
    each = x.view(np.uint8).reshape(size, width)
    for k, plane in enumerate(np.frombuffer(planes, np.uint8).reshape(width, size)):
        each[:, k] = plane
    if fixed:
        return np.where(x == np.iinfo(np.int64).min, np.nan, x / 2.0**31)
    return np.cumsum(x, dtype=kind) if ordered else x


_CHUNK = "chunk long, doc_ids array<{kind}>, held array<boolean>, ends binary, words binary, ids binary, n_tokens long"


def _chunks(kind: pa.DataType, most: int):
    """Per task: texts as chunks of word hashes (`words`, sorted, and the number of each token's among them)."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, held, sizes, words = [], [], [], []  # sizes: words of each text; words: arrays of all texts' words

        def out():
            spelled = pa.concat_arrays(words).dictionary_encode()
            hashes = np.array([*map(hash_word, spelled.dictionary.to_pylist()), hash_word(END)], np.uint64)
            known, number = np.unique(hashes, return_inverse=True)
            ends = np.cumsum(np.array(sizes, np.int64) + 1)
            token = np.full(ends[-1], number[-1], np.uint32)
            is_word = np.ones(ends[-1], bool)
            is_word[ends - 1] = False
            token[is_word] = number[spelled.indices.to_numpy()]
            row = [
                pa.array([(task << 32) + made], pa.int64()),
                pa.array([list(ids)], pa.list_(kind)),
                pa.array([list(held)], pa.list_(pa.bool_())),
                pa.array([ends.tobytes()], pa.binary()),
                pa.array([_pack(known, True)], pa.binary()),
                pa.array([_pack(token)], pa.binary()),
                pa.array([len(token)], pa.int64()),
            ]
            for x in (ids, held, sizes, words):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["chunk", "doc_ids", "held", "ends", "words", "ids", "n_tokens"])

        tokens = 0
        for batch in (part for whole in batches for part in slices(whole, 64)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            flat = lists.flatten()
            kept = pc.not_equal(flat, "")  # an edge of white space gives an empty piece
            n = np.add.reduceat(kept.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())
            words.append(flat.filter(kept).cast(pa.binary()))
            sizes += n.tolist()
            ids += batch.column("doc_id").to_pylist()
            held += batch.column("held_out").to_pylist()
            tokens += int(n.sum()) + len(n)
            if tokens >= most:
                yield out()
                made, tokens = made + 1, 0
        if ids:
            yield out()

    return run


def _distinct(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of codes under 2^bits the distinct values in order, where each is first, and the number of each code's value."""
    n = len(code)
    room = max(1, (n - 1).bit_length()) if n else 1
    if bits + room > 64:
        values, first, which = np.unique(code, return_index=True, return_inverse=True)
        return values, first, which
    packed = np.sort((code << np.uint64(room)) | np.arange(n, dtype=np.uint64))  # faster than sorting the positions apart
    place, value = (packed & np.uint64((1 << room) - 1)).astype(np.int64), packed >> np.uint64(room)
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    which = np.empty(n, np.int64)
    which[place] = np.cumsum(new) - 1
    return value[new], place[new], which


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys. Positions are sorted with the keys' upper bits, which is faster than sorting them apart; where these
    leave the order open, the keys are sorted whole."""
    n = len(keys)
    room = np.uint64(max(1, (n - 1).bit_length())) if n else np.uint64(1)
    low = (np.uint64(1) << room) - np.uint64(1)
    away = keys - keys.min() if n else keys  # a bucket's keys share their first bits
    up = np.uint64(64 - max(1, int(away.max()).bit_length())) if n else np.uint64(0)
    order = (np.sort(((away << up) & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    placed = keys[order]
    return np.argsort(keys, kind="stable") if (placed[1:] < placed[:-1]).any() else order


def _values(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit keys in order, and the number of each key among them."""
    order = _order(keys)
    placed = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = placed[1:] != placed[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return placed[new], which


def _before(x: np.ndarray, first) -> np.ndarray:
    """What the token before has; the first token gets `first`."""
    out = np.empty_like(x)
    out[:1] = first
    out[1:] = x[:-1]
    return out


@dataclass
class Model:
    """What all rounds share. root: training tokens, the discount of the root's words, log10 of the unknown word."""

    least: int
    discount: float
    replayed: int
    root: tuple[float, float, float] = (0.0, 0.5, 0.0)
    bits: int = 64

    def sent(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)


def _shares(n: np.ndarray, of_context: np.ndarray, model: Model) -> np.ndarray:
    """The discounted share of next words; 1 where there is too little evidence, which is not read."""
    return np.where(n >= model.least, n - model.discount, 1.0) / np.maximum(of_context, 1)


def _terms(share: np.ndarray, log: np.ndarray, context: np.ndarray, size: int) -> np.ndarray:
    """Of each context its owned next words' share, their share at the suffix, and their part of the divergence."""
    under = 10.0**log
    return np.column_stack([np.bincount(context, x, size) for x in (share, under, share * np.log(share / under))])


def _replay(chunk: dict, answers: dict[int, np.ndarray], model: Model):
    """Goes as far as the answers reach. Gives the next questions as a list of (number, keys, values), sorted by key; after the last
    replayed level a dict of what is known of the texts and of the tokens that go on (`carry`).

    Question 0 is for the words' counts, 2k - 1 for those of n-grams of k + 1 words, 2k for contexts of k words. Questions 2k and
    2k + 1 are asked together: next words are counted for all contexts that may yet turn out to be states, most of which do.
    """
    least, (total, cut, unknown) = model.least, model.root
    ends = np.frombuffer(chunk["ends"], np.int64)
    sizes = np.diff(ends, prepend=0)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    train = np.repeat(~np.array(chunk["held"], bool), sizes)
    words, token = _unpack(chunk["words"], np.uint64, True), _unpack(chunk["ids"], np.uint32).astype(np.int64)
    asks = []
    if 0 not in answers:
        asks.append((0, model.sent(words), np.bincount(token, train, len(words)).astype(np.uint32)))
        counts = np.zeros(len(words), np.int64)
    else:
        counts = answers[0] >> 1
    seen = n = counts[token]
    log = np.where(counts > 0, np.log10(np.maximum(counts - cut, 1e-300) / max(total, 1)), unknown)[token]
    # of the n-grams of the level before: keys, their order when sent, counts, and each token's
    keys, order, gram = words, np.arange(len(words)), token
    state = may = np.ones(len(token), bool)
    for level in range(1, model.replayed + 1):
        context, of_context = _before(gram, 0), _before(n, 0)
        if level == 1:  # asked together with the words
            asked = np.flatnonzero(at >= 1)
        else:  # the others can't occur often enough
            asked = np.flatnonzero(may & (at >= level) & (of_context >= least) & (n >= least))
        room = max(1, (len(words) - 1).bit_length())
        codes, first, which = _distinct(((context[asked] << room) | token[asked]).astype(np.uint64), max(1, (len(keys) - 1).bit_length()) + room)
        of_gram = (codes >> np.uint64(room)).astype(np.int64)
        made = mix(mix(keys[of_gram]) + words[(codes & np.uint64((1 << room) - 1)).astype(np.int64)])
        sent = model.sent(made)
        by_key = _order(sent)
        if 2 * level - 1 not in answers:
            return [*asks, (2 * level - 1, sent[by_key], np.bincount(which, train[asked], len(codes)).astype(np.uint32)[by_key])]
        found = np.empty(len(codes), np.int64)
        found[by_key] = answers[2 * level - 1]
        holds = state & (at >= level) & (of_context >= least)
        true = np.zeros(len(codes), bool)  # n-grams whose context holds and whose suffix occurs often enough
        true[which] = holds[asked] & (n[asked] >= least)
        count = np.where(true, found >> 1, 0)
        n = np.zeros(len(token), np.int64)
        n[asked] = count[which]
        used = np.zeros(len(keys), bool)
        used[context[holds]] = True
        contexts = order[used[order]]
        if 2 * level not in answers:
            mine = (found & 1 == 1) & (count >= least)
            own = asked[first[mine]]
            terms = _terms(_shares(count[mine], counts[of_gram[mine]], model), log[own], of_gram[mine], len(keys))
            asks.append((2 * level, model.sent(keys[contexts]), terms[contexts]))
            if level == model.replayed:
                return asks
        else:
            back = np.full(len(keys) + 1, np.nan)  # one more for tokens without a context
            back[contexts] = answers[2 * level]
            back = np.where(holds, back[context], np.nan)
            state = ~np.isnan(back)
            on = np.flatnonzero(state)
            log[on] = np.where(n[on] >= least, np.log10(_shares(n[on], of_context[on], model)), back[on] + log[on])
        gram = np.full(len(token), -1, np.int64)
        gram[asked] = which
        keys, order, counts, may = made, by_key, count, holds
    if asks:
        return asks
    context = _before(gram, -1)
    of_context = _before(n, 0)
    on = np.flatnonzero(state & (at > model.replayed) & (of_context >= least))
    text = np.repeat(np.arange(len(sizes)), sizes)
    return {
        "sizes": sizes, "seen": seen, "log": log,
        "carry": {"place": on.astype(np.uint32), "text": text[on].astype(np.uint32), "train": train[on], "word": words[token[on]], "context": keys[context[on]] if len(on) else np.zeros(0, np.uint64),
                  "of_context": of_context[on].astype(np.uint32), "n": n[on].astype(np.uint32), "log": log[on]},
    }


#: A chunk's tokens that go on, each array packed.
_CARRIED = {"place": np.uint32, "text": np.uint32, "train": bool, "word": np.uint64, "context": np.uint64, "of_context": np.uint32, "n": np.uint32, "log": np.float64}
_CARRY = "chunk long, " + ", ".join(f"`{k}` binary" for k in _CARRIED)


def _carry_columns(carry: dict) -> list[pa.Array]:
    return [pa.array([_pack(carry[k]) if len(carry["place"]) else None], pa.binary()) for k in _CARRIED]


def _carry_on(row: dict, count: np.ndarray | None, backs: np.ndarray | None, model: Model):
    """One more level for a chunk's kept tokens: asks for counts, then for contexts, then gives the next kept tokens with the
    texts' changes of score."""
    x = {k: _unpack(row[k], kind) for k, kind in _CARRIED.items()}
    n, of_context, log = x["n"].astype(np.int64), x["of_context"].astype(np.int64), x["log"]
    gram = mix(mix(x["context"]) + x["word"])
    asked = np.flatnonzero(n >= model.least)
    keys, first, which = np.unique(gram[asked], return_index=True, return_inverse=True)
    if count is None:
        return model.sent(keys), np.bincount(which, x["train"][asked], len(keys)).astype(np.uint32)
    n = np.zeros(len(gram), np.int64)
    n[asked] = (count >> 1)[which]
    contexts, of = _values(x["context"])
    if backs is None:
        mine = (count & 1 == 1) & (count >> 1 >= model.least)
        own = asked[first[mine]]
        return model.sent(contexts), _terms(_shares(count[mine] >> 1, of_context[own], model), log[own], of[own], len(contexts))
    back = backs[of]
    state = ~np.isnan(back)
    new = np.where(state, np.where(n >= model.least, np.log10(_shares(n, of_context, model)), back + log), log)
    before = np.zeros(len(gram), bool)
    before[1:] = x["place"][1:] == x["place"][:-1] + 1
    on = np.flatnonzero(state & before)
    on = on[n[on - 1] >= model.least]
    carry = {"place": x["place"][on], "text": x["text"][on], "train": x["train"][on], "word": x["word"][on], "context": gram[on - 1], "of_context": n[on - 1].astype(np.uint32), "n": n[on].astype(np.uint32), "log": new[on]}
    return carry, np.bincount(x["text"], new - log).astype(np.float64)


_ASK = "bucket long, chunk long, keys binary, parts binary"
_ANSWER = "chunk long, round int, bucket long, answer binary, sums array<long>"


def _ask(chunk: int, asks: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, bits: int) -> pa.RecordBatch:
    """Each question's keys, of so many bits and sorted, dealt over its own `buckets`. A question without keys has no row."""
    rows = []
    for number, keys, values in asks:
        if not len(keys):
            continue
        bucket = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        names, starts = np.unique(bucket, return_index=True)
        for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            rows.append((number * buckets + name, chunk, _pack(keys[a:b], True), _pack(values[a:b])))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "keys", "parts"])


def _answer(buckets: int, divergence: float):
    """Adds up what all chunks brought to a bucket: twice the count, plus 1 for the n-gram's owner; or log10 of what a
    state's other words are multiplied by, NaN for a context that is no state."""

    def run(group: pa.Table) -> pa.Table:
        group, number = group.sort_by("chunk"), group.column("bucket")[0].as_py() // buckets
        held = [_unpack(x, np.uint64, True) for x in group.column("keys").to_pylist()]
        keys, which = _values(np.concatenate(held))
        parts, sums = group.column("parts").to_pylist(), [0, 0, 0, 0]
        if number == 0 or number % 2:
            n = np.concatenate([_unpack(x, np.uint32) for x in parts]).astype(np.int64)
            total = np.bincount(which, n, len(keys)).astype(np.int64)
            has = np.flatnonzero(n)[::-1]
            answer, owner = 2 * total[which], np.full(len(keys), -1)
            owner[which[has]] = has  # the first stays
            answer[owner[owner >= 0]] += 1
            sums = [0, 0, 0, 0] if number else [int(x) for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]
        else:
            terms = np.concatenate([_unpack(x, np.float64) for x in parts]).reshape(-1, 3)
            kept, taken, far = (np.bincount(which, terms[:, k], len(keys)) for k in range(3))
            rest, left = np.maximum(1 - kept, 1e-9), np.maximum(1 - taken, 1e-9)
            far = far + rest * np.log(rest / left)
            answer = np.where(far >= divergence, np.log10(rest / left), np.nan)[which]
        cuts = np.cumsum([len(x) for x in held])[:-1]
        rows = len(held)
        return pa.table(
            {
                "chunk": group.column("chunk"),
                "round": pa.array([number] * rows, pa.int32()),
                "bucket": group.column("bucket"),
                "answer": pa.array([_pack(x) for x in np.split(answer, cuts)], pa.binary()),
                "sums": pa.array([sums] + [[0] * 4] * (rows - 1), pa.list_(pa.int64())),
            }
        )

    return run


def _answers(rows: pa.Table, rounds: int | list[int]) -> dict[int, np.ndarray]:
    """The answers of each round in the order of the asked keys; a round in which nothing was asked has an empty one."""
    rounds = range(rounds) if isinstance(rounds, int) else rounds
    held: dict[int, list] = {k: [] for k in rounds}
    for number, _, answer in sorted(zip(*(rows.column(c).to_pylist() for c in ("round", "bucket", "answer")), strict=True)):
        held[number].append(_unpack(answer, np.float64 if number and number % 2 == 0 else np.int64))
    return {k: np.concatenate(x) if x else np.zeros(0, np.float64 if k and k % 2 == 0 else np.int64) for k, x in held.items()}


def score_texts(
    docs: DataFrame, depth: int | None = None, least: int = 2, divergence: float = 0.02, discount: float = 0.7, chunk_tokens: int = 1_000_000, replayed: int = 3
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of docs (doc_id, text). depth: the
    longest context in words; None is no limit."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    model = Model(least, discount, replayed if depth is None else min(replayed, depth))
    texts = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    made = save(texts.mapInArrow(_chunks(to_arrow_type(docs.schema["doc_id"].dataType), chunk_tokens), _CHUNK.format(kind=kind)), "chunks")
    size, rows = made.agg(F.sum("n_tokens"), F.count("*")).first()
    size, dealt, run = size or 0, min(20_000, max(8, rows // 3)), uuid.uuid4().hex
    few = max(8, dealt // 4)  # further levels have few tokens of each chunk
    chunks = deal(made, f"lm_chunks_{run}", "chunk", dealt)
    drop(made)
    buckets, bits = max(8, size // 1_000_000), min(64, max(48, 20 + int(size).bit_length()))
    model = replace(model, bits=bits)
    plain = chunks.select("chunk", "held", "ends", "words", "ids")

    def answered(asked: DataFrame, to: str, parts: int) -> DataFrame:
        return deal(asked.groupBy("bucket").applyInArrow(_answer(buckets, divergence), _ANSWER), f"lm_{to}_{run}", "chunk", parts)

    def first_ask(batches):
        for batch in batches:
            for row in batch.select(["chunk", "held", "ends", "words", "ids"]).to_pylist():
                yield _ask(row["chunk"], _replay(row, {}, model), buckets, bits)

    def next_ask(known: int, model: Model):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            return pa.Table.from_batches([_ask(row["chunk"], _replay(row, _answers(right, known), model), buckets, bits)])

        return run

    got = answered(plain.mapInArrow(first_ask, _ASK), "answers", dealt)
    total, kinds, ones, twos = (x or 0 for x in got.agg(*(F.sum(F.col("sums")[k]) for k in range(4))).first())
    cut = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    model = replace(model, root=(total, cut, float(np.log10(max(cut * kinds / total, 1e-12))) if total else 0.0))
    for level in range(1, model.replayed + 1):
        got = answered(plain.groupBy("chunk").cogroup(got.drop("sums").groupBy("chunk")).applyInArrow(next_ask(2 * level, model), _ASK), "answers", dealt)
    base_under = total + 0.1 * (kinds + 1)

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of a chunk the texts' numbers and scores so far, and the tokens that go on."""
        row = left.drop_columns(["doc_ids"]).to_pylist()[0]
        found = _replay(row, _answers(right, 2 * model.replayed + 1), model)
        sizes, n = found["sizes"], found["seen"]
        add = lambda x: pa.array([np.add.reduceat(x, np.cumsum(sizes) - sizes).tobytes()], pa.binary())
        columns = [left.column("chunk"), left.column("doc_ids"), left.column("held"), pa.array([sizes.tobytes()], pa.binary()), add((n > 0).astype(np.int64)), add(np.log10((n + 0.1) / base_under)), add(found["log"])]
        return pa.table([*columns, *_carry_columns(found["carry"])], names=["chunk", "doc_ids", "held", "sizes", "known", "base", "score", *_CARRIED])

    settled = f"chunk long, doc_ids array<{kind}>, held array<boolean>, sizes binary, known binary, base binary, score binary, " + _CARRY.split(", ", 1)[1]
    done = save(chunks.drop("n_tokens").groupBy("chunk").cogroup(got.drop("sums").groupBy("chunk")).applyInArrow(settle, settled), "settled")
    forget(spark, f"lm_chunks_{run}")
    forget(spark, f"lm_answers_{run}")

    def ask_counts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _ask(row["chunk"], [(1, *_carry_on(row, None, None, model))], buckets, bits)

    def ask_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return pa.Table.from_batches([_ask(row["chunk"], [(2, *_carry_on(row, _answers(right, [1])[1], None, model))], buckets, bits)])

    def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
        row, found = left.to_pylist()[0], _answers(right, [1, 2])
        carry, change = _carry_on(row, found[1], found[2], model)
        return pa.table([left.column("chunk"), *_carry_columns(carry), pa.array([_pack(change)], pa.binary())], names=["chunk", *_CARRIED, "change"])

    changes, carry = [], done.select("chunk", *_CARRIED).where("place is not null")
    level, gone = model.replayed, []
    while (depth is None or level < depth) and not carry.isEmpty():
        counts = answered(carry.mapInArrow(ask_counts, _ASK), f"level{level}", few)
        both = answered(carry.groupBy("chunk").cogroup(counts.drop("sums").groupBy("chunk")).applyInArrow(ask_contexts, _ASK), f"level{level}", few)
        after = save(carry.groupBy("chunk").cogroup(both.drop("sums").groupBy("chunk")).applyInArrow(go_on, _CARRY + ", change binary"), "carried")
        changes.append(after.select("chunk", "change"))
        gone += [after]
        forget(spark, f"lm_level{level}_{run}")
        carry, level = after.drop("change").where("place is not null"), level + 1

    def rows_of(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["doc_ids", "held"]).to_pylist()[0]
        get = lambda k, t: np.frombuffer(row[k], t)
        score = get("score", np.float64).copy()
        for change in right.column("change").to_pylist():
            x = _unpack(change, np.float64)
            score[: len(x)] += x
        sizes = get("sizes", np.int64)
        return pa.table(
            {
                "doc_id": left.column("doc_ids").combine_chunks().flatten(),
                "held_out": left.column("held").combine_chunks().flatten(),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(get("known", np.int64), pa.int64()),
                "train_tokens": pa.array([total] * len(sizes), pa.int64()),
                "base_score": pa.array(get("base", np.float64), pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    changed = reduce(DataFrame.unionAll, changes) if changes else spark.createDataFrame([], "chunk long, change binary")
    out = done.drop(*_CARRIED).groupBy("chunk").cogroup(changed.groupBy("chunk"))
    out = save(out.applyInArrow(rows_of, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    drop(done, *gone)
    return out
