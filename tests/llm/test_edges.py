"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from flowlens.llm import bpe, fertility, html_text, kd_shards, lt_hash, near_dedup, packing, suffix_tree, toxicity, url_filter

LONG = " ".join(f"word{i % 5000} tail{i % 17}" for i in range(60_000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon for a long long time tonight."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "The cat sat on the mat and looked at the moon for a long long time tonight."),
    (5, "The cat sat on the mat and looked at the moon for a long long time tonight."),
    (None, "A text without a number."),
    (7, " \n\t "),
    (8, "x" * 50_000),
    (9, "Ünïcode 日本語 😀 <|endoftext|> ſ ﬁ İ\x1c\x85 tail"),
    (10, "one\n\none\none"),
]
#: Names that the operators use inside.
CLASH = "kept n_shingles component_id id a b key range carry h cell d0 size shard slot row word c n rank length piece toxic p_toxic base score host chunk blocks".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if i != 9 else None, "src", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def chain():
    import numpy as np

    return toxicity.Chain(["low", "toxic"], {"w:moon": 0}, [np.array([0.0]), np.array([9.0, 0.0])], [-3.0, -3.0])


OPERATORS = {
    "fertility": fertility.fertility_rules,
    "toxicity": lambda d: toxicity.judge_toxicity(d, chain()),
    "shards": lambda d: kd_shards.document_shards(d, 24),
    "fingerprints": lambda d: lt_hash.compare_with_edits(d, rows_per_range=3),
    "near": lambda d: near_dedup.near_groups(d, width=4),
    "bpe": bpe.encode_digests,
    "texts": bpe.encode_texts,
    "scores": suffix_tree.score_texts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, docs, empty):
    rows = OPERATORS[name](docs).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert OPERATORS[name](empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    assert {str(r["doc_id"]) for r in rows} == {str(i) for i, _ in TEXTS}
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for have in places.values():
        at = 0
        for offset, length in sorted(have):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty).count() == 0


def test_stages_keep_columns(docs, empty):
    for stage in (lambda d: toxicity.drop_toxic(d, chain()), fertility.keep_sound, near_dedup.keep_one_each):
        out = stage(docs)
        assert out.columns == docs.columns and 0 < out.count() < len(TEXTS)
        assert stage(empty).count() == 0
    kept = {r["doc_id"] for r in near_dedup.keep_one_each(docs).select("doc_id").collect()}
    assert kept == {1, 2, 3, 4, None, 7, 8, 9, 10}


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "no scheme", ""), (3, "http://A.Example.com/en/x?y#z", "<p>Hi &amp; you<br>there"), (3, "http://A.Example.com/en/x?y#z", "<p>Hi &amp; you<br>there"), (None, "://", "<" * 5000)],
        "page_id long, url string, html string",
    ).withColumns({c: F.lit("clash") for c in CLASH})
    urls = url_filter.judge_urls(pages).collect()
    assert len(urls) == 5 and {(r["host"], r["path"], r["rule"]) for r in urls if r["page_id"] == 3} == {("a.example.com", "/en/x", "example.com/en/")}
    assert {(r["host"], r["path"], r["rule"]) for r in urls if r["page_id"] in (1, 2)} == {("", "", None)}
    texts = {(r["page_id"], r["text"]) for r in html_text.extract_text(pages).collect()}
    assert (1, "") in texts and (2, "") in texts and (3, "Hi & you there") in texts
    assert url_filter.judge_urls(pages.limit(0)).count() == 0 and html_text.extract_text(pages.limit(0)).count() == 0


def test_chain_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = toxicity.fit_chain(docs, toxicity.chain_labels(labels), toxicity.CATEGORIES)
    assert toxicity.judge_toxicity(docs, made).where("toxic").count() == 0
    one = spark.createDataFrame([(1, 1, 1), (4, None, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    made = toxicity.fit_chain(docs, toxicity.chain_labels(one), toxicity.CATEGORIES)
    assert toxicity.judge_toxicity(docs, made).count() == len(TEXTS)


def test_a_doc_id_with_two_texts(spark):
    """Both rows are the one with the least set hash, so the groups don't depend on the order of rows."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, a), (5, b)]
    for order in (rows, rows[::-1]):
        got = near_dedup.near_groups(spark.createDataFrame(order, "doc_id long, text string"), width=4).collect()
        seen = {r["doc_id"]: r["component_id"] for r in got}
        assert len(got) == 6 and seen[1] == 1 and sorted(seen.values()) in ([1, 1, 1, 3, 3], [1, 1, 1, 2, 2]) and (seen[2] == seen[4]) and (seen[3] == seen[5])
    kept = near_dedup.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert len(kept) == 2 and len({r["doc_id"] for r in kept}) == 2


def test_kept_columns_that_clash_with_measures(docs):
    got = fertility.fertility_rules(docs.withColumn("n_words", F.lit("clash")), keep=("doc_id", "n_words", "source"))
    assert got.columns.count("n_words") == 1 and got.columns[:2] == ["doc_id", "source"] and got.schema["n_words"].dataType.simpleString() == "bigint"
    assert got.count() == len(TEXTS)


def test_pipeline_of_odd_rows(spark, docs, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage; an empty table stays empty."""
    import corpus_pipeline

    labels = [(k, 1, 0) for k in (1, 4, 8)] + [(5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, empty):
        have = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, have, str(tmp_path))
            assert after.columns == rows.columns, name
            after.write.parquet(str(tmp_path / f"{name}-{rows is docs}"))
            have = spark.read.parquet(str(tmp_path / f"{name}-{rows is docs}"))
        pieces = corpus_pipeline.STAGES[-1][1](spark, have, str(tmp_path)).collect()
        ids = [r["doc_id"] for r in have.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and {r["doc_id"] for r in pieces} == set(ids)
        assert not {2, 3, 7, 8} & set(ids) and bool(ids) == (rows is docs) and not {1, 5} <= set(ids)  # 1 and 5 are one text
