"""Spelling variants, language mixtures and phrases: brute force, SQL, held-out accuracy and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import languages, phrases, queries, spelling

CLASH = "word n form root size key part a b lang_pred score gram rank phrase l r window at".split()
LONG = " ".join(f"word{i % 50}tail, und der{i % 7} {'abc' * (i % 5)}." for i in range(40_000))
TEXTS = [(1, "The cat sat on the mat.", "en"), (2, None, "en"), (3, "", "de"), (4, LONG, "de"), (5, "The cat sat on the mat.", "en"), (5, "The cat sat on the mat.", "en"),
         (None, "Ohne Nummer und Sprache", None), (7, " \n\t 12 34", "fr"), (8, "x" * 50_000, "en"), (9, "Ünïcode 日本語 😀 İ ﬁ", None), (10, "one\n\none,one", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).cache()


def near(a, b):
    """One inserted, deleted or replaced code point, by comparing prefixes and suffixes."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(counts):
    out = {}
    near_of = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, found in near_of.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near_of[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdeéßÿÀ", spelling.LETTERS])
def test_variants_by_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(250)}
    for w in list(words):  # words near to others, at every place
        for _ in range(3):
            k, x = rng.randrange(len(w) + 1), rng.choice(alphabet)
            words.add(rng.choice([w[:k] + x + w[k:], w[:k] + x + w[k + 1 :], w[:k] + w[k + 1 :] or x]))
    counts = {w: rng.choice([1, 2, 3, 6, 12, 25, 60]) for w in words}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_variants(counts)
    pairs = spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(pairs) == len({frozenset((r["a"], r["b"])) for r in pairs})


def test_variants_of_the_table(spark, sf_dir):
    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    rows = queries.op11_spelling_variants(spark, sf_dir).collect()
    assert {r["word"]: r["n"] for r in rows} == counts
    near_of = defaultdict(set)
    gaps = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :]].add(w)
    for gap, found in gaps.items():
        for w in found:
            near_of[w] |= {x for x in found if near(w, x)}
            if gap in counts:
                near_of[w].add(gap)
                near_of[gap].add(w)
    for r in rows:
        assert r["n_near"] == len(near_of[r["word"]])
        best = min(near_of[r["word"]], key=lambda x: (-counts[x], x), default=None)
        assert r["form"] == (best if best and counts[best] >= 2 * counts[r["word"]] else None) and r["form_n"] == (counts[r["form"]] if r["form"] else None)


def test_counts_are_the_same_when_tables_are_handed_on(spark, docs):
    batches = docs.select("doc_id", "text").toArrow().to_batches()
    totals = []
    for most in (10, 10**9):
        table = Counter()
        for out in spelling._counted(97, 3, most)(batches):
            for w, n in zip(out.column("word").to_pylist(), out.column("n").to_pylist(), strict=True):
                table[w] += n
        totals.append(table)
    assert totals[0] == totals[1] and totals[0]


def test_variant_edges(spark, docs):
    rows = {r["word"]: r for r in spelling.spelling_variants(docs, letters=3, least=1, every=10**9).collect()}
    assert rows["x" * 50_000]["n"] == 1 and rows["the"]["n"] == 6 and "sprache" in rows and "Ünïcode" in rows
    assert rows["abc"]["n_near"] == 0 and rows["cat"]["form"] is None and rows["cat"]["n_near"] == 2  # mat, sat
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("abc", 1)], "word string, n long"), ratio=1)


def test_a_chain_of_forms(spark):
    """Each form is twice as frequent: the root is at the chain's end, whatever its length."""
    word = "aaaaaaaaaa"
    chain = [(word[:k] + "b" * (10 - k), 2 ** (10 - k)) for k in range(11)]
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"bbbbbbbbbb"}


def test_variants_broadcast_no_words(spark, monkeypatch):
    """However small Spark takes the words to be, none of the joins on them or on their keys is a broadcast."""
    plans = []
    save = spelling.save
    monkeypatch.setattr(spelling, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, name))
    words = spark.createDataFrame([("letter", 9), ("lettr", 4), ("lotter", 1)], "word string, n long")
    out = spelling.group_variants(words)
    assert {r["word"]: r["root"] for r in out.collect()} == {"letter": "letter", "lettr": "letter", "lotter": "letter"}
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (spelling.near_pairs(words), out)]
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if any(c.isalpha() for c in r["text"]))
    assert right >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_shares_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~languages.is_held_out(F.col("doc_id")))
    model = languages.fit_languages(docs)
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(languages.is_held_out(F.col("doc_id"))).collect()
    of = {lang: "".join(r["text"] for r in held if r["lang"] == lang) for lang in model.names}
    letters = lambda t: sum(map(str.isalpha, t))
    for a, b, share in (("en", "de", 0.5), ("fr", "es", 0.3), ("de", "fr", 0.8)):
        text = of[a][: int(8000 * share)] + "\n" + of[b][: int(8000 * (1 - share))]
        main, score, found, shares = model.predict(text)
        want = letters(of[a][: int(8000 * share)]) / letters(text)
        # texts of any language hold some English lines
        assert set(found[:2]) == {a, b} and sum(shares[2:]) < 0.1 and shares[found.index(a)] == pytest.approx(want, abs=0.05) and sum(shares) == pytest.approx(1)
        assert main == found[0] and score == shares[0]
    for lang, text in of.items():
        main, score, _, _ = model.predict(text[:3000])
        assert main == lang and score > 0.9


def test_proportions_are_those_of_the_likeliest_mixture():
    """Expectation-maximisation against a fine grid of two proportions."""
    rng = np.random.default_rng(1)
    table = rng.dirichlet(np.full(4096, 0.1), 2).T + 1e-9
    model = languages.LanguageModel(["a", "b"], np.log(table / table.sum(axis=0)), weight=0.1)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    hashes = np.concatenate(list(languages.window_hashes(text, 4096)))
    held, n = np.unique(hashes, return_counts=True)
    p = np.exp(model.log_share[held])
    grid = np.linspace(0, 1, 2001)
    best = grid[np.argmax([n @ np.log(p @ [g, 1 - g]) for g in grid])]
    chosen, share = model.mixture(text)
    assert sorted(chosen) == [0, 1] and dict(zip(chosen, share))[0] == pytest.approx(best, abs=2e-3)


def test_windows_don_t_depend_on_pieces(monkeypatch):
    text = "Ein Satz mit Wörtern, 42 Zahlen\nund İ ﬁ ß." * 20
    whole = Counter(np.concatenate(list(languages.window_hashes(text, 2**16))).tolist())
    model = languages.LanguageModel(["a", "b"], np.log(np.random.default_rng(2).random((2**16, 2))), weight=0.1)
    before = model.mixture(text)
    for piece in (1, 2, 7):
        monkeypatch.setattr(languages, "PIECE", piece)
        assert Counter(np.concatenate(list(languages.window_hashes(text, 2**16))).tolist()) == whole
        after = model.mixture(text)
        assert after[0] == before[0] and np.allclose(after[1], before[1])


def test_language_edges(spark, docs):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify(docs).collect()]
    assert len(got) == len(TEXTS)
    assert {(i, p, s) for i, p, s in got if i in (2, 3, 7)} == {(2, "und", 0.0), (3, "und", 0.0), (7, "und", 0.0)}
    assert all(p in ("en", "de") for i, p, _ in got if i not in (2, 3, 7))
    assert languages.identify(docs.limit(0)).count() == 0
    none = languages.predict_languages(docs, languages.fit_languages(docs.where("lang = 'fr'")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    many = spark.createDataFrame([(f"l{k}", "abc") for k in range(5000)], "lang string, text string")
    with pytest.raises(ValueError):
        languages.fit_languages(many)


def brute_phrases(rows, longest=3, least=10, covered=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        over = Counter()
        for g, a in found.items():
            for size in range(2, len(g)):
                for k in range(len(g) - size + 1):
                    over[g[k : k + size]] = max(over[g[k : k + size]], a)
        kept = []
        for g, a in found.items():
            if 100 * over[g] >= covered * a:
                continue
            cuts = [(10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((lang, " ".join(g), a, counts[g[:k]], counts[g[k:]], total[lang], score))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], k, *x[1:]) for k, x in enumerate(kept[:top], 1)]
    return sorted(out)


def found_phrases(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("longest", "least", "covered", "top"), [(3, 10, 50, 2000), (4, 4, 70, 25), (2, 6, 50, 9), (5, 3, 30, 2000)])
def test_phrases_by_brute_force(spark, longest, least, covered, top):
    rng = random.Random(longest)
    words = ["A", "b", "ç", "Dé", "e-f", "g"]
    texts = [(rng.choice(["x", "y", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "\x1c "]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    got = found_phrases(phrases.best_phrases(df, longest, least, covered, top, parts=3))
    assert got == brute_phrases(texts, longest, least, covered, top) and got


def test_phrases_of_the_table(spark, sf_dir):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found_phrases(queries.op13_phrase_mining(spark, sf_dir)) == brute_phrases(rows)


def test_a_small_bitmap_loses_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = found_phrases(phrases.best_phrases(docs))
    monkeypatch.setattr(phrases, "BITMAP", 2**12)
    assert found_phrases(phrases.best_phrases(docs)) == want


def test_bitmap_is_asked_by_the_hash_that_made_it(spark):
    grams = [("de", "größe"), ("und", "a b"), ("en", "x")]
    bits = phrases._bitmap(spark.createDataFrame(grams, "lang string, gram string"))
    for lang, gram in grams:
        h = xxhash.xxh64_intdigest(lang.encode(), 42)
        for w in gram.split():
            h = (h << 21 | h >> 43) & (2**64 - 1)
            h ^= xxhash.xxh64_intdigest(w.encode(), 42)
        h &= len(bits) * 8 - 1
        assert bits[h >> 3] >> (h & 7) & 1
    assert np.unpackbits(bits).sum() == 3


def test_pruning_leaves_rare_grams_out(spark):
    """At level 2 only pairs of two frequent words are counted."""
    text = " ".join(["often again"] * 20 + [f"rare{k} often" for k in range(30)])
    bits = phrases._bitmap(spark.createDataFrame([("x", "often"), ("x", "again")], "lang string, gram string"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["x"], "text": [text]})
    out = [dict(zip(b.column("gram").to_pylist(), b.column("n").to_pylist(), strict=True)) for b in phrases._level(2, bits)([batch])]
    assert set(out[0]) <= {"often again", "again often"} | {g for g in out[0] if "rare" in g} and sum("rare" in g for g in out[0]) <= 3


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_007
    grams = spark.createDataFrame([("x", 0, None, 10**11), ("x", 1, "a", big * 2), ("x", 1, "b", big + 5), ("x", 2, "a b", big)], "lang string, size int, gram string, n long")
    (row,) = phrases.scored_phrases(grams).collect()
    assert row["score"] == 10**6 * big * big // (big * 2 * (big + 5)) and math.log2(10**6 * big * big) > 64


def test_phrase_edges(spark, docs):
    assert found_phrases(phrases.best_phrases(docs)) == brute_phrases([(lang, text) for _, text, lang in TEXTS])
    assert found_phrases(phrases.best_phrases(docs, least=2)) == brute_phrases([(lang, text) for _, text, lang in TEXTS], least=2)
    assert phrases.best_phrases(docs.limit(0)).count() == 0
    assert phrases.best_phrases(docs.where("doc_id = 2")).count() == 0


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_phrase_mining"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in rel.description)
    order = [[c[0] for c in rel.description].index(n) for n in names]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=str)


def test_orders_and_packs_of_keys():
    """Keys are ordered whole where their upper bits are equal, and arrays come back as they were packed."""
    from flowlens.llm import suffix_tree

    rng = np.random.default_rng(0)
    wide = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    near = np.uint64(2**63) + rng.permutation(3000).astype(np.uint64)
    sets = [np.zeros(0, np.uint64), np.zeros(3, np.uint64), np.array([7], np.uint64), wide, near, np.concatenate([wide, near, wide[::-1]]), near[rng.integers(0, 50, 999)]]
    for keys in sets:
        assert (suffix_tree._order(keys) == np.argsort(keys, kind="stable")).all()
        values, which = suffix_tree._values(keys)
        want, place = np.unique(keys, return_inverse=True)
        assert (values == want).all() and (which == place).all()
        assert (suffix_tree._unpack(suffix_tree._pack(np.sort(keys), True), np.uint64, True) == np.sort(keys)).all()
    for kind in (bool, np.uint32, np.int64):
        x = rng.integers(0, 2, 100).astype(kind)
        assert (suffix_tree._unpack(suffix_tree._pack(x), kind) == x).all() and len(suffix_tree._unpack(suffix_tree._pack(x[:0]), kind)) == 0
    terms = np.column_stack([np.arange(4.0), [0.5, np.nan, 0, 1], np.arange(4.0) / 4])
    assert np.array_equal(suffix_tree._unpack(suffix_tree._pack(terms), np.float64), terms.ravel(), equal_nan=True)
