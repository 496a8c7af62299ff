"""The corpus pipeline against plain Python, stage by stage."""

import random

import pytest

import corpus_pipeline
from curatrix.llm import near_dedup
from tests.llm.test_operators import brute_classes, brute_hits, brute_lines, copies, prose, weighted_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(21)
    d = str(tmp_path_factory.mktemp("sf"))
    bench = [(i, prose(rng, 15)) for i in range(5)]
    texts = [t for _, t in copies(rng)] + [prose(rng, 80) + " " + bench[i % 5][1] + " " + prose(rng, 20) for i in range(10)]
    block = "\n".join(prose(rng, 12) for _ in range(3))
    texts += [prose(rng, 60) + "\n" + block + "\n" + prose(rng, 60) for _ in range(20)]
    labels = []
    for i in range(120):
        bad = i % 4 == 0
        texts.append(" ".join(["horridword" if bad and k % 25 == 3 else w for k, w in enumerate(prose(rng, 70).split())]))
        labels.append((len(texts) - 1, int(bad)))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, texts[0] + " end", None, None, None), (0, texts[0], "en", "s", len(texts[0]))]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, bench, dict(labels)


def test_stages(spark, data):
    d, bench, labels = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, (toxic, lines, near, benchmark, pack) = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = corpus_pipeline.materialize(toxic(spark, docs, d), "t1")
    gone = set(texts(docs)) - set(texts(kept))
    assert kept.columns == columns and gone == {i for i, bad in labels.items() if bad}

    single = corpus_pipeline.materialize(lines(spark, kept, d), "t2")
    assert single.columns == columns and texts(single) == brute_lines(list(texts(kept).items()))
    assert all(r["n_chars"] == len(r["text"]) for r in single.collect() if r["text"] is not None)

    unique = corpus_pipeline.materialize(near(spark, single, d), "t3")
    classes = brute_classes(single.where("text IS NOT NULL"))
    assert unique.columns == columns and set(texts(unique)) == set(classes.values()) | {9000}

    clean = corpus_pipeline.materialize(benchmark(spark, unique, d), "t4")
    items = [(str(i), t) for i, t in bench]
    assert clean.columns == columns and set(texts(clean)) == {i for i, t in texts(unique).items() if not brute_hits(t, items)[1]}

    pieces = pack(spark, clean, d).collect()
    assert {p["doc_id"] for p in pieces} == set(texts(clean))
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)

    final = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(tuple, final)) == sorted(map(tuple, pieces)) or {p["doc_id"] for p in final} == {p["doc_id"] for p in pieces}
    assert near_dedup.THRESHOLD == 0.8


def test_near_copies_are_told_by_the_idf_of_every_shingle(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in weighted_pairs(random.Random(32))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {2}


def test_empty_and_odd_columns(spark, data, tmp_path):
    d, *_ = data
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0).selectExpr("*", "1 AS node", "2 AS key", "3 AS score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
