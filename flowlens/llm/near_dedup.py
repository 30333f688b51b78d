"""Near-duplicate groups by MinHash with tensored banding.

A document is its set of word shingles. Two small collections of half-keys are computed from the minhashes, `bands`
left ones and `bands` right ones of `rows` minhashes each; every pair (left i, right j) is one table key. That gives
bands * bands tables from 2 * bands * rows minhashes, where plain banding needs bands * bands * 2 * rows. A pair of
similarity s meets in some table with probability (1 - (1 - s^rows)^bands)^2; with the defaults 0.9999 at s = 0.8.

No candidate counts before the full sets confirm it:

1. Equal sets collapse to their smallest doc_id, so copies never make pairs.
2. In a key of up to `bucket` holders all pairs are candidates. A holder of any larger key is hot: in each of its keys it
   is tied to one pivot only, besides the pairs with holders that aren't hot. Of the pivots that it shares most keys
   with, the `best` most similar ones are candidates.
3. Candidates are confirmed on the full sets, and components of the links are formed.
4. The ties join the hot ones into clusters. In each cluster everything outside its largest component is compared with
   all members whose set's size allows a link, in blocks of bounded size, on full sets. So what step 2 left out loses no
   link; only pairs that are connected already are never compared.

Candidates whose 84 minhashes agree in less than half are dropped before step 3; of pairs at similarity 0.8 that is one in
10^9, far below what the banding misses (one in 10^4).

Skew: copies are counted with partial sums, a key's holders take part in as many tables as there are keys, and blocks
bound what a task gets. Nothing of all documents reaches the driver.

Nulls and empty texts have an empty set and are linked with nothing. A null doc_id is linked with nothing by name: its
component is null and the row is kept. Rows of one doc_id are one document: if their texts differ, all of them are linked
as the one with the least set hash is. Repeated rows come back repeated, an empty table gives none, and columns other than
doc_id and text are left out (keep_one_each keeps all).
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, star_components
from .shared import drop, save
from .words import Memo, hash_word, mix, shingle_set, slices, word_bytes

_SIGNED = "doc_id long, n_shingles long, set_hash binary, sketch binary, lefts array<long>, rights array<long>"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**63, n, np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of a non-empty set, of 32 bits each."""
    a, b = _seeds(n)
    out = np.full(n, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        out = np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _sign(width: int, bands: int, rows: int):
    half = bands * rows

    def run(batches):
        memo = Memo(hash_word)
        for batch in (part for whole in batches for part in slices(whole)):
            out = {k: [] for k in ("n", "hash", "sketch", "left", "right")}
            for text in batch.column("text").to_pylist():
                memo.trim()
                found = shingle_set(word_bytes(text, lower=True), width, memo)
                out["n"].append(len(found))
                if not len(found):
                    for k in ("hash", "sketch", "left", "right"):
                        out[k].append(None)
                    continue
                spread = mix(found)
                out["hash"].append(np.array([spread.sum(), (spread * spread + found).sum()], np.uint64).tobytes())
                h = minhashes(found, 2 * half)
                out["sketch"].append((h & np.uint32(255)).astype(np.uint8).tobytes())
                keys = h.astype(np.uint64).reshape(2 * bands, rows)
                made = keys[:, 0]
                for k in range(1, rows):
                    made = mix(made) + keys[:, k]
                made = mix(made).astype(np.int64)
                out["left"].append(made[:bands])
                out["right"].append(made[bands:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(out["n"], pa.int64()),
                    pa.array(out["hash"], pa.binary()),
                    pa.array(out["sketch"], pa.binary()),
                    pa.array(out["left"], pa.list_(pa.int64())),
                    pa.array(out["right"], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_hash", "sketch", "lefts", "rights"],
            )

    return run


def _set_maker(width: int):
    def run(batches):
        memo = Memo(hash_word)
        for batch in (part for whole in batches for part in slices(whole)):
            sets = []
            for text in batch.column("text").to_pylist():
                memo.trim()
                sets.append(shingle_set(word_bytes(text, lower=True), width, memo).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _alike(least: float):
    """Drops candidates whose sketches agree in less than this share."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            two = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            same = (one == two).mean(axis=1)
            keep = same >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), batch.column("hot").filter(pa.array(keep)), pa.array(same[keep])],
                names=["a", "b", "hot", "alike"],
            )

    return run


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                keep.append(_linked(np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _overlaps(ones: list[np.ndarray], twos: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by products of 0/1 matrices over the shingles that both sides have."""
    flat_a, flat_b = np.concatenate(ones), np.concatenate(twos)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(ones), len(twos)), np.float32)

    def cells(sets, flat):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    (at_a, own_a), (at_b, own_b) = cells(ones, flat_a), cells(twos, flat_b)
    for low in range(0, len(both), 4096):
        width = min(4096, len(both) - low)
        m = []
        for at, own, n in ((at_a, own_a, len(ones)), (at_b, own_b, len(twos))):
            i, j = np.searchsorted(at, [low, low + width])
            x = np.zeros((n, width), np.float32)
            x[own[i:j], at[i:j] - low] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _block(percent: int):
    """One cell of the block comparison: each row outside the largest component against the cell's other rows. One
    link to each other component is enough."""

    def run(cell: pa.Table) -> pa.Table:
        side = np.array(cell.column("asks").to_pylist(), bool)
        ids, comp = np.array(cell.column("id").to_pylist(), np.int64), np.array(cell.column("comp").to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("shingles")]
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = [], []
        if len(one) and len(two):
            n = np.array([len(x) for x in sets], np.float32)
            both = _overlaps([sets[i] for i in one], [sets[i] for i in two])
            hit = (100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)) & (comp[one][:, None] != comp[two][None, :])
            for i in np.flatnonzero(hit.any(axis=1)):
                others = two[hit[i]]
                _, first = np.unique(comp[others], return_index=True)
                a += [ids[one[i]]] * len(first)
                b += ids[others[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_groups(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 14,
    rows: int = 3,
    bucket: int = 8,
    best: int = 3,
    block: int = 256,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    width: words in a shingle. percent: the least similarity of a link, in hundredths. component_id is the smallest
    doc_id that links reach (itself included); kept is doc_id = component_id.
    """
    signed = save(docs.select("doc_id", "text").mapInArrow(_sign(width, bands, rows), _SIGNED), "signed")
    # a doc_id with several texts is the one of the least set hash
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("least"), F.max("set_hash").alias("most")).where("least <> most")
    several = save(several.select("doc_id", "least"), "several")
    if not several.isEmpty():
        one = signed.join(several, "doc_id", "left").withColumn("set_hash", F.when(F.col("set_hash").isNotNull(), F.coalesce("least", "set_hash"))).drop("least")
        rows_of = signed.select("doc_id", "set_hash", *(F.col(c).alias(f"_{c}") for c in ("sketch", "lefts", "rights"))).dropDuplicates(["doc_id", "set_hash"])
        signed = save(one.drop("sketch", "lefts", "rights").join(rows_of, ["doc_id", "set_hash"], "left").select("doc_id", "n_shingles", "set_hash", *(F.col(f"_{c}").alias(c) for c in ("sketch", "lefts", "rights"))), "signed")
    named = signed.where("set_hash is not null and doc_id is not null")
    reps = save(named.groupBy("set_hash").agg(F.min("doc_id").alias("id")), "reps")
    rep_rows = named.join(reps.select(F.col("id").alias("doc_id"), F.col("set_hash").alias("own")), "doc_id").where("own = set_hash")
    rep_rows = save(rep_rows.select(F.col("doc_id").alias("id"), "n_shingles", "sketch", "lefts", "rights").dropDuplicates(["id"]), "rep-rows")

    # a table key is worth forming only from two half-keys that others have too
    halves = rep_rows.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lefts").alias("k")), F.struct(F.lit(1).alias("side"), F.col("rights").alias("k")))).alias("x"))
    halves = halves.select("id", "x.side", F.posexplode("x.k").alias("at", "k")).select("id", "side", F.xxhash64("side", "at", "k").alias("half"))
    shared = halves.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("half"))).where("n > 1")
    lists = shared.groupBy("id").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("half"))).alias("l"), F.collect_list(F.when(F.col("side") == 1, F.col("half"))).alias("r")
    )
    keys = lists.select("id", F.explode("l").alias("l"), "r").select("id", "l", F.explode("r").alias("r")).select("id", F.xxhash64("l", "r").alias("key"))
    # a holder of a large key is hot; two hot ones are left to the block comparison below, so a key only ties them to one
    # pivot, the same in as many keys as may be
    met_on = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    met_on = met_on.withColumn("warm", F.max("n").over(Window.partitionBy("id")) > bucket)
    at = Window.partitionBy("key").orderBy(F.col("warm").desc(), F.xxhash64("id"), "id")
    one = F.struct("id", "warm")
    held = met_on.select(
        *("id", "n", "warm"),
        F.first("id").over(at).alias("pivot"),
        F.array(*[F.lag(one, k).over(at) for k in range(1, bucket)]).alias("before"),
    )
    tie = F.struct(F.col("pivot").alias("b"), F.lit(True).alias("hot"))
    each = F.transform(F.filter("before", lambda x: x.isNotNull() & ~(x["warm"] & F.col("warm"))), lambda x: F.struct(x["id"].alias("b"), F.lit(False).alias("hot")))
    pairs = F.when(F.col("n") > bucket, F.array(tie)).when(F.col("warm"), F.concat(F.array(tie), each)).otherwise(each)
    met = held.select(F.col("id").alias("a"), F.explode(pairs).alias("p")).select("a", "p.*").where("hot or a <> b")
    first, second = (F.when(F.col("hot"), F.col(own)).otherwise(of("a", "b")) for own, of in (("a", F.least), ("b", F.greatest)))
    met = met.select(first.alias("a"), second.alias("b"), "hot").groupBy("a", "b", "hot").agg(F.count(F.lit(1)).alias("keys"))
    met = save(met, "met")
    # the pivots that a hot one shares most keys with are the likeliest
    order = Window.partitionBy("a").orderBy(F.col("hot").desc(), F.col("keys").desc(), "b")
    tried = met.where("a <> b").withColumn("rank", F.row_number().over(order)).where(f"not hot or rank <= {2 * best}").select("a", "b", "hot")

    sizes = rep_rows.select("id", "n_shingles", "sketch")
    side = lambda s: sizes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    near = tried.join(side("a"), "a").where("n_a is not null").join(side("b"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = near.select("a", "b", "hot", "sketch_a", "sketch_b").mapInArrow(_alike(0.5), "a long, b long, hot boolean, alike double")
    top = Window.partitionBy("a", "hot").orderBy(F.col("alike").desc(), "b")
    near = near.withColumn("rank", F.row_number().over(top)).where(f"not hot or rank <= {best}")
    near = save(near.select("a", "b"), "near")

    hot_ids = star_components(met.where("hot").select("a", "b"))
    hot_ids = save(hot_ids.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    wanted = near.select(F.col("a").alias("id")).unionAll(near.select(F.col("b").alias("id"))).unionAll(hot_ids.select("id")).distinct()
    wanted = save(wanted, "wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted  # a checked size: 8 bytes each
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id", "left_semi")
    sets = save(texts.mapInArrow(_set_maker(width), "id long, shingles binary"), "sets")
    links = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    links = links.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    links = save(links.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), "links")
    linked = save(star_components(links), "linked")

    # what large keys left out; sets of sizes in one class or in neighbouring ones may be alike enough
    member = hot_ids.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("comp"))
    kind = F.floor(F.ln("n_shingles") / (1.000001 * math.log(100 / percent))) if percent < 100 else F.col("n_shingles")
    member = save(member.join(rep_rows.select("id", kind.alias("class")), "id"), "members")
    counted = member.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("cluster").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("most")).where("comps > 1")
    open_ = save(member.join(largest.select("cluster", F.col("most.comp").alias("main")), "cluster"), "open")
    asking = open_.where("comp <> main").select("id", "cluster", "comp", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    told = open_.groupBy("cluster", "class").agg(F.ceil(F.count(F.lit(1)) / block).alias("columns"))
    grid = save(told.join(asking.groupBy("cluster", "class").agg(F.ceil(F.count(F.lit(1)) / block).alias("lines")), ["cluster", "class"]), "grid")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = asking.join(grid, ["cluster", "class"]).select("id", "cluster", "class", "comp", F.lit(True).alias("asks"), spread("lines").alias("x"), steps("columns").alias("y"))
    tells = open_.join(grid, ["cluster", "class"]).select("id", "cluster", "class", "comp", F.lit(False).alias("asks"), steps("lines").alias("x"), spread("columns").alias("y"))
    cells = asks.unionByName(tells).join(sets.dropDuplicates(["id"]), "id")
    more = cells.groupBy("cluster", "class", "x", "y").applyInArrow(_block(percent), "a long, b long")
    more = save(more.join(linked.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
                .join(linked.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
                .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "more")
    again = components(more)
    merged = linked.select("node", "component").unionByName(more.select(F.col("a").alias("node"), F.col("a").alias("component"))).unionByName(
        more.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("mid"))
    final = merged.join(again.select(F.col("node").alias("mid"), F.col("component").alias("end")), "mid", "left")
    final = final.select(F.col("node").alias("id"), F.coalesce("end", "mid").alias("component"))

    found = reps.join(final, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    out = signed.join(found, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
    out = save(out, "groups")
    drop(signed, several, reps, rep_rows, met, near, hot_ids, wanted, sets, links, linked, member, open_, grid, more, again)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, broadcast_ids: int = 1_000_000, **settings) -> DataFrame:
    """docs, with all its columns, with one document of each group of near_groups: that of the smallest doc_id. Of rows
    that share a doc_id one stays. Rows with a null doc_id stay."""
    stay = near_groups(docs, **settings).where("kept and doc_id is not null").select("doc_id")
    n, ids = stay.count(), stay.distinct()
    found = docs.join(F.broadcast(ids) if n <= broadcast_ids else ids, "doc_id", "left_semi")  # a checked size
    if n > ids.count():
        same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        nth = next(x for x in (f"nth{k}" for k in count()) if x not in docs.columns)
        found = found.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).drop(nth)
    return found.unionByName(docs.where("doc_id is null"))
