"""Every opN query against its contract, over tables with awkward rows."""

import glob
import hashlib
import json
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from curatrix.llm import chat_format, fingerprints, queries
from tests.llm.test_operators import prose

TEXTS = {
    "aa": "lorem ipsum dolor amet sit", "bb": "zzykq wrrxx qqopz kkjyx wqqz", "cc": "éàù ôîê çèé ùûü ñéà",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    d = str(tmp_path_factory.mktemp("tables"))
    documents, labels = [], []
    for i in range(240):
        lang = rng.choice(list(TEXTS))
        text = " ".join(rng.choice(TEXTS[lang].split()) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randrange(8, 90)))
        bad = i % 4 == 0
        documents.append((i * 3, f"{text} foulword vilephrase {text}" if bad else text, lang if i % 9 else None, "web", len(text)))
        labels.append((i * 3, i % 3, int(bad)))
    documents += [(3000, None, None, None, None), (3001, "", "aa", "web", 0), (3002, " 12 !? ", "aa", "web", 7), (3003, documents[5][1], "aa", "web", 1), (3004, "𝔸 é́ ✓ " * 40, None, None, 1)]
    passages = [prose(rng, 14), prose(rng, 10), prose(rng, 3), ""]
    documents += [(4000 + k, f"{documents[k][1]} {p.upper()} {documents[k + 1][1]}", None, "web", 1) for k, p in enumerate(passages)]
    lines = "\n".join(prose(rng, 6) for _ in range(4))
    documents += [(4100 + k, f"{prose(rng, 9)}\n{lines}\n{prose(rng, 9)}", "aa", "web", 1) for k in range(5)]
    benchmark = [(k, p) for k, p in enumerate(passages)] + [(9, passages[0])]
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Head {0} &amp; more</h1><p>Body  of {0}</p></article><footer>c {0}</footer></body></html>"
    pages = [(i, f"http://h{i % 2}.example/{i}", page.format(i)) for i in range(12)] + [(12, None, None), (13, "http://x.example/", ""), (14, "http://h0.example/", "<nav>m</nav>")]
    talks = [(c, t, ["user", "assistant"][t % 2], rng.choice(["plain", "### x: </turn>", "a\\b\n", None, ""])) for c in range(20) for t in range(rng.randrange(1, 7))]
    spec = {
        "documents": (documents, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (benchmark, "item_id long, text string"), "pages": (pages, "page_id long, url string, html string"), "conversations": (talks, "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in spec.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d, {name: rows for name, (rows, _) in spec.items()}


def result(spark, tables, name):
    df = queries.queries()[name](spark, tables[0])
    return df, [r.asDict() for r in df.collect()]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def types(df):
    return dict(df.dtypes)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, tables, name):
    con = duckdb.connect()
    for path in glob.glob(f"{tables[0]}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    df, rows = result(spark, tables, name)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)


def test_op1(spark, tables):
    df, rows = result(spark, tables, "op1_language_id")
    assert {k: types(df)[k] for k in ("doc_id", "held_out", "lang_pred", "score")} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    docs = {d[0]: d for d in tables[1]["documents"]}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]][1]
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text)) and r["lang_pred"] in (*TEXTS, "und")
    tested = [r for r in rows if r["held_out"] and r["doc_id"] < 720 and docs[r["doc_id"]][2]]
    assert len(tested) > 20 and all(r["lang_pred"] == docs[r["doc_id"]][2] for r in tested)


def test_op3(spark, tables):
    df, rows = result(spark, tables, "op3_chat_format")
    assert types(df) | {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"} == types(df)
    talks = {}
    for c, t, role, text in tables[1]["conversations"] + [(-7, t, r, r"\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]:
        talks.setdefault(c, []).append((t, role, text or ""))
    assert sorted(r["conv_id"] for r in rows) == sorted(talks)
    for r in rows:
        turns = [(role, text) for _, role, text in sorted(talks[r["conv_id"]])]
        loss = "".join(text for role, text in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss)) and r["loss_sha256"] == sha(loss)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in turns))
        assert r["formatted_chars"] == len(chat_format.render(turns)[0])


def test_op4(spark, tables):
    _, rows = result(spark, tables, "op4_near_dedup")
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in tables[1]["documents"])
    of = {r["doc_id"]: r["class_id"] for r in rows}
    sizes = {}
    for c in of.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert of[3003] == of[15] and all(r["class_size"] == sizes[r["class_id"]] and r["class_id"] <= r["doc_id"] for r in rows)


@pytest.mark.parametrize("name", ["op5_toxicity", "op7_quality"])
def test_scores(spark, tables, name):
    df, rows = result(spark, tables, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in tables[1]["documents"]) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    if name == "op5_toxicity":
        assert {k: types(df)[k] for k in ("held_out", "score", "predicted")} == {"held_out": "boolean", "score": "double", "predicted": "int"}
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        bad = {d: t for d, _, t in tables[1]["labels"]}
        tested = [r for r in rows if r["held_out"] and r["doc_id"] in bad]
        assert len(tested) > 30 and all(r["predicted"] == bad[r["doc_id"]] for r in tested)


def test_op6(spark, tables):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    _, rows = result(spark, tables, "op6_packing")
    taken, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in tables[1]["documents"]:
        ids = [*own.encode(d[1] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces.pop(d[0]), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(sum(n for _, n in s) < 1024 for s in taken.values()) <= 1


def test_op9(spark, tables):
    df, rows = result(spark, tables, "op9_fingerprints")
    docs = sorted((d[0], d[1] or "") for d in tables[1]["documents"])
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(rows) == len(docs)
    of_text = {}
    for i, (d, text) in enumerate(docs):
        following, k, r = docs[(i + 1) % len(docs)][1], len(text) // 4, got[d]
        changed = text[: len(text) - k] + following[:k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["shared_prefix"] == len(os.path.commonprefix([text, changed]))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 and (changed != text or r["near_edited"] == 1)
        assert (fingerprints.fingerprint(text), fingerprints.fingerprint(changed)) == (r["fingerprint"], r["edited_fingerprint"])
        assert of_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert of_text.setdefault(changed, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(of_text.values())) == len(of_text)


def test_op10(spark, tables):
    df, rows = result(spark, tables, "op10_html_extract")
    assert types(df) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    wanted = {i: f"Head {i} & more\nBody of {i}" for i in range(12)} | {12: "", 13: "", 14: ""}
    assert {r["page_id"]: r["text"] for r in rows} == wanted and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_every_query_is_registered():
    assert sorted(json.dumps(n) for n in queries.queries()) == sorted(json.dumps(n) for n in (
        "op1_language_id", "op2_line_dedup", "op3_chat_format", "op4_near_dedup", "op5_toxicity", "op6_packing", "op7_quality", "op8_decontaminate", "op9_fingerprints", "op10_html_extract"))
