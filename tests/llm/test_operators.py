"""The corpus operators against brute force, and their defined cases."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import chat_format, decontaminate, fingerprints, html_extract, language_id, line_dedup, near_dedup, packing, quality, text, toxicity
from curatrix.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta river stone cloud paper green seven table light".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def odd(spark):
    """Nulls, empty and long texts, repeated rows and names that operators use themselves."""
    rows = [(1, None), (2, ""), (3, "   \n\n "), (4, "one two three four five six"), (4, "one two three four five six"), (None, "no id here at all"), (5, "é" * 50_000), (6, "x y z\n" * 3_000)]
    df = frame(spark, rows)
    for name in ("key", "digest", "at", "lines", "removed", "node", "kept_id", "s", "f", "b", "p", "score", "part"):
        df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# text

def test_word_hashes_do_not_depend_on_place():
    a, b = text.words(text.codes("one two, three")), text.words(text.codes("...three  one"))
    assert a[2][0] == b[2][1] and a[2][2] == b[2][0] and len(set(a[2].tolist())) == 3


# 1 language id

def languages(rng, n=160):
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zzykq", "wrrxx", "qqopz", "kkjyx"], "cc": ["éàù", "ôîê", "çèé", "ùûü"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang if i % 7 else None))
    return rows


def test_language_id(spark):
    rows = languages(random.Random(1))
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1 for i, _, lang in rows if lang)
    other = language_id.identify(odd(spark), model).collect()
    assert {r["doc_id"] for r in other if r["lang_pred"] == "und"} == {1, 2, 3} and len(other) == 8
    assert all(r["score"] == 0 and r["rejected"] for r in other if r["lang_pred"] == "und")
    assert language_id.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    s = language_id.symbols("abracadabra abacus cadabra")
    keys, n = np.unique(language_id.grams(s), return_counts=True)
    alphabet = np.unique(s)
    model = language_id.joined({"x": language_id.train(keys.view(np.int64), n.astype(float), len(alphabet))}, len(alphabet))
    for context in ("abr", "cad", "zzz", "a c"):
        head = 0
        for c in context:
            head = head << 16 | ord(c)
        known = np.exp(model._rows(np.array([(head << 16 | int(c)) & (1 << 64) - 1 for c in alphabet], dtype=np.uint64))).sum()
        assert known + np.exp(model._rows(np.array([head << 16 | 0xFFFE], dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-5)


def test_no_counted_gram_is_left_out_of_a_large_model(spark):
    rng = random.Random(14)
    rows = [(i, t + " rare" + "".join(rng.choice("bcdfgklmnprst") for _ in range(8)), lang) for i, t, lang in languages(rng)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    whole, apart = language_id.fit(docs), language_id.fit(docs, cells=50)
    known = {lang: set() for lang in "aa bb cc".split()}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            known[lang].update(language_id.grams(language_id.symbols(t)).tolist())
    assert [len(p.grams[4]) for p in apart.parts] == [len(known[x]) for x in apart.langs] and len(whole.parts) == 1
    for _, t, _ in rows[:40]:
        s = language_id.symbols(t + " Unseen zürq")
        assert whole.score(s) == pytest.approx(apart.score(s), abs=1e-5)
    results = [{r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.identify(docs, m).collect()} for m in (whole, apart)]
    assert results[0] == results[1]


class _PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries and its textbook formula, one n-gram at a time."""

    def __init__(self, texts, alphabet, order=4):
        self.order, self.alphabet = order, alphabet
        self.count = {order: Counter()}
        for t in texts:
            s = " " * (order - 1) + _spaced(t)
            self.count[order].update(s[i : i + order] for i in range(len(s) - order + 1))
        for k in range(order - 1, 0, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, c in self.count.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[k] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.alphabet + 1)
        total = self.total[k][gram[:-1]]
        if not total:
            return self.p(gram[1:])
        return max(self.count[k][gram] - self.discount[k], 0) / total + self.discount[k] * self.kinds[k][gram[:-1]] / total * self.p(gram[1:])

    def score(self, text):
        s = " " * (self.order - 1) + _spaced(text)
        return float(np.mean([math.log(self.p(s[i : i + self.order])) for i in range(len(s) - self.order + 1)]))


def _spaced(text):
    """Letters with one space for every run of others that follows one."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).lstrip()


def test_language_models_against_the_formula(spark):
    rng = random.Random(19)
    rows = [(i, t + rng.choice(["", " 42!", " naïve Ünder"]), lang) for i, t, lang in languages(rng)]
    model = language_id.fit(frame(spark, rows, "doc_id long, text string, lang string"))
    learnt = {lang: [t for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)] for lang in model.langs}
    alphabet = len({c for ts in learnt.values() for t in ts for c in _spaced(t)} | {" "})
    plain = [_PlainKneserNey(learnt[lang], alphabet) for lang in model.langs]
    for _, t, _ in rows[:25] + [(0, "something Else zq é", None)]:
        assert model.score(language_id.symbols(t)).tolist() == pytest.approx([m.score(t) for m in plain], abs=2e-4)


# 2 line dedup

def brute_lines(rows, size=3):
    first, gone = {}, Counter()
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = [x.strip(" ") for x in t.split("\n")]
        for at in range(len(lines) - size + 1):
            window = tuple(lines[at : at + size])
            if not any(window):
                continue
            if first.setdefault(window, (i, at)) != (i, at):
                for j in range(size):
                    gone[i, at + j] = 1
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not gone[i, k]) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) + " " * rng.randrange(2) for _ in range(rng.randrange(9)))) for i in range(80)] + [(99, None), (100, "\n\n\n\n"), (101, "a\n" * 40)]
    out, lines, removed = line_dedup.deduplicate(frame(spark, rows))
    got = out.select("doc_id", "text", lines.alias("l"), removed.alias("r")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)
    assert all(r["l"] - r["r"] == (len(r["text"].split("\n")) if r["text"] else r["l"] - r["r"]) for r in got if r["text"] is not None)
    kept, _, _ = line_dedup.deduplicate(odd(spark))
    assert kept.count() == 8 and set(odd(spark).columns) < set(kept.columns)
    assert line_dedup.deduplicate(empty(spark))[0].count() == 0


def test_line_dedup_is_native(spark):
    out, _, _ = line_dedup.deduplicate(frame(spark, [(1, "a\nb\nc")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3 chat formatting

TEXTS = ["plain", "", None, r"\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "tail\\", "\\</turn>", "a:b\n\nc", "####"]


def test_template_round_trip():
    for role in ("user", "assistant", "tool: x", "a\\", "###"):
        turns = [(role, t) for t in TEXTS]
        formatted, spans = chat_format.render(turns)
        assert chat_format.parse(formatted) == [(r, t or "") for r, t in turns]
        assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == ([t or "" for _, t in turns] if role == "assistant" else [])
    with pytest.raises(ValueError):
        chat_format.parse("no turn")


def test_long_and_tied_conversations(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(150)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, None, None, None)]
    messages = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("other"))
    got = {r["tree"]: chat_format.parse(r["formatted"]) for r in chat_format.conversations(chat_format.linear(messages)).collect()}
    assert [t for _, t in got[1]] == [f"t{i}" for i in range(150)]
    assert got[2] == [("user", "a"), ("user", "a"), ("user", "b")] and got[3] == [("", "")]
    assert chat_format.conversations(chat_format.linear(messages.limit(0))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(5)
    rows, parents = [], {}
    for tree in range(4):
        for i in range(30):
            parent = None if i == 0 else rng.randrange(max(0, i - 4), i)
            parents[tree, i] = parent
            rows.append((tree, i, parent, "user", f"{tree}.{i}", float(rng.randrange(10))))
    score = {(r[0], r[1]): r[5] for r in rows}
    best = {}
    for tree in range(4):
        for leaf in set(range(30)) - {p for (t, _), p in parents.items() if t == tree}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parents[tree, at]
            mean = sum(score[tree, n] for n in path) / len(path)
            best.setdefault(tree, []).append((-mean, leaf, [f"{tree}.{n}" for n in reversed(path)]))
    rows.append((9, 1, 2, "user", "circle", 0.0))
    rows.append((9, 2, 1, "user", "circle", 0.0))
    messages = frame(spark, rows, "tree long, id long, parent long, role string, text string, score double")
    for k in (1, 2, None):
        got = sorted((r["tree"], r["rank"], [t for _, t in chat_format.parse(r["formatted"])]) for r in chat_format.conversations(messages, best=k).collect())
        assert got == sorted((t, n + 1, p[2]) for t, ps in best.items() for n, p in enumerate(sorted(ps)[:k]))


def test_messages_without_and_with_equal_ids(spark):
    rows = [("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 2, "user", "after", 1.0), ("t", None, 1, "user", "nameless", 1.0), (None, None, None, "user", "alone", 0.0)]
    got = chat_format.conversations(spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double"), best=None).collect()
    assert sorted([t for _, t in chat_format.parse(r["formatted"])] for r in got) == [["alone"], ["root", "a", "after"], ["root", "b"], ["root", "nameless"]]


# 4 near-dedup

def plain_shingles(text, k=5):
    found = re.findall(r"[^\W_]+", text.lower())
    return [tuple(found)] if 0 < len(found) < k else [tuple(found[i : i + k]) for i in range(len(found) - k + 1)]


def plain_frequencies(texts, k=5):
    """How many different texts have each shingle, and their number."""
    once = {tuple(re.findall(r"[^\W_]+", t.lower())) or t: set(plain_shingles(t, k)) for t in texts if t is not None}
    return Counter(x for own in once.values() for x in own), len(once)


def brute_classes(docs, k=5):
    """Classes by all pairs, with words, weights and similarities of its own; nothing of the module but its settings."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    df, n = plain_frequencies([t for _, t in rows], k)
    sets = []
    for _, t in rows:
        tf = Counter(plain_shingles(t, k))
        sets.append({x: c * math.log(1 + n / max(df[x], n / near_dedup.RARE)) for x, c in tf.items()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum(min(w, sets[j].get(x, 0.0)) for x, w in sets[i].items())
            total = sum(sets[i].values()) + sum(sets[j].values()) - shared
            if rows[i][1] == rows[j][1] or total and shared / total >= near_dedup.THRESHOLD:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("copies_of_one", [0, 400])
def test_common_shingles_are_counted_exactly(spark, monkeypatch, copies_of_one):
    monkeypatch.setattr(near_dedup, "_TEXTS", 7)
    rng = random.Random(8)
    common = [prose(rng, 12) for _ in range(4)]
    texts = [" ".join([prose(rng, 20), *(c for j, c in enumerate(common) if rng.random() < (0.5, 0.12, 0.05, 0.07)[j]), prose(rng, 9)]) for _ in range(120)]
    texts += [texts[0]] * copies_of_one + [None, "", "!?"]
    rng.shuffle(texts)
    df, n = plain_frequencies(texts)
    keys, counts, told = near_dedup.frequencies(frame(spark, list(enumerate(texts))).select("text"), 5)
    assert told == n
    assert sorted(counts.tolist()) == sorted(c for c in df.values() if c > n / near_dedup.RARE) and len(counts) > 4
    assert (np.diff(keys.astype(object)) > 0).all()


def copies(rng):
    """Exact copies, copies of copies, a family round one original, texts that share a passage."""
    rows, passage = [], prose(rng, 40)
    for base in range(6):
        original = prose(rng, 120).split()
        rows.append(" ".join(original))
        rows.append(" ".join(original))
        drift = list(original)
        for _ in range(6):
            drift[rng.randrange(len(drift))] = "edited" + str(rng.randrange(1000))
            rows.append(" ".join(drift))
        for _ in range(12):
            near = list(original)
            for _ in range(rng.randrange(1, 6)):
                near[rng.randrange(len(near))] = "other" + str(rng.randrange(1000))
            rows.append(" ".join(near))
    rows += [prose(rng, 50) + " " + passage + " " + prose(rng, 50) for _ in range(40)]
    rows += ["short one", "short one", "short two", "a b c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_dedup_against_all_pairs(spark):
    docs = frame(spark, copies(random.Random(4)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs).collect()}
    assert got == brute_classes(docs)
    kept = {r["doc_id"] for r in near_dedup.deduplicate(docs).collect()}
    assert kept == set(got.values())


def weighted_pairs(rng):
    """Plain similarity says the opposite of TF-IDF here, with shingles that 2 and 14 of 400 texts have: 1 and 2 are a class, 3 and 4 are none."""
    rare, usual, passage = prose(rng, 100), prose(rng, 30), prose(rng, 100)
    rows = [(1, rare), (2, rare + " " + usual), (3, passage + " " + prose(rng, 8)), (4, passage + " " + prose(rng, 8))]
    rows += [(100 + i, usual + " " + prose(rng, 60)) for i in range(13)] + [(200 + i, passage + " " + prose(rng, 60)) for i in range(12)]
    return rows + [(1000 + i, prose(rng, 30)) for i in range(371)]


def test_every_shingle_has_its_own_idf(spark):
    docs = frame(spark, weighted_pairs(random.Random(31)))
    _, counts, n = near_dedup.frequencies(docs.select("text"), 5)
    assert n == 400 and {1, 2, 14} <= set(counts.tolist())
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs).collect()}
    assert got == brute_classes(docs) and [got[i] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]


def test_near_dedup_steps_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        found = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}

    before = held()
    texts = near_dedup.lots(frame(spark, weighted_pairs(random.Random(33))).select("doc_id", "text"))
    texts = near_dedup.materialize(texts, "lots")
    nodes = near_dedup.placed(texts)
    told = near_dedup.counted(texts, nodes, 5)
    assert near_dedup.sign(texts, nodes, told, 400, 5, 3, 14).count() == near_dedup.vectors(texts, nodes, told, 400, 5).count() == 400
    for _ in range(50):  # files go in the background
        left = sum(n for name, n in held().items() if name not in before)
        if left < 20_000:  # those of small counts stay
            break
        time.sleep(0.2)
    assert left < 20_000


@pytest.mark.parametrize("listed", [0, 1_000_000])
def test_places_are_found_by_bits_or_by_shuffle(spark, monkeypatch, listed):
    monkeypatch.setattr(near_dedup, "LISTED", listed)
    monkeypatch.setattr(near_dedup, "_TEXTS", 130)
    rows = weighted_pairs(random.Random(34))
    texts = near_dedup.materialize(near_dedup.lots(frame(spark, [*rows, (5000, ""), (5001, None)]).select("doc_id", "text")), "lots")
    wanted = texts.where("doc_id % 3 = 0")
    found = near_dedup._at(texts, wanted).collect()
    assert sorted(r["doc_id"] for r in found if r["node"] is not None) == sorted(i for i, _ in rows if i % 3 == 0)
    assert sum(r["node"] is None for r in found) == texts.where("node IS NULL").count() >= 4


def test_sampling_estimates_similarity():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    a, b = (h[:240], rng.uniform(1, 3, 300).astype(np.float32)[:240]), (h[40:], None)
    w = np.concatenate([a[1][40:], rng.uniform(1, 3, 60).astype(np.float32)])
    b = (b[0], w)
    drawn = near_dedup.sample(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 240, 500]), 600)
    exact = near_dedup.similarity(a, b)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(exact, abs=0.07)


def test_near_dedup_cases(spark):
    docs = odd(spark)
    got = near_dedup.classify(docs).collect()
    assert len(got) == 8 and [r["class_id"] for r in got if r["doc_id"] == 1] == [1]
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert near_dedup.classify(empty(spark)).count() == 0 and near_dedup.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("bands", [1, 2])
def test_large_buckets_lose_no_pair(spark, monkeypatch, bands):
    docs = frame(spark, copies(random.Random(15)))
    want = {r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs, rows=1, bands=bands).collect()}
    monkeypatch.setattr(near_dedup, "DEALT", 3)  # members over many tasks
    monkeypatch.setattr(near_dedup, "LEADERS", (1,))  # and more left for the search
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4_000)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classify(docs, rows=1, bands=bands).collect()}
    assert got == want and len(set(got.values())) < len(got) - 40


def test_equal_ids_keep_the_least_text(spark):
    text = prose(random.Random(3), 30)
    rows = [(1, text + "!", "b"), (1, text + " ", "z"), (1, text + " ", "a"), (-(1 << 63), "x y z", "n"), (None, "x y z", "m")]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in near_dedup.deduplicate(docs).collect()}
    assert got == {(1, text + " ", "a"), (None, "x y z", "m")}


# 5 toxicity

def marked(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randrange(20, 200)).split(), i % 5 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["horridword", "nastything", "vileperson"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = marked(random.Random(6))
    docs, marks = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (labels[i][1] == 1) for i in held) / len(held)
    assert right > 0.95
    clean = prose(random.Random(7), 30)
    plain, wrong = model.score([clean, clean + " horridwordd nastythingg"])
    assert wrong > plain  # an unseen spelling shares n-grams
    assert toxicity.clean(docs, model).count() == sum(s < 0.5 for s in got.values())


def test_toxicity_cases(spark):
    docs = odd(spark)
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}
    one = toxicity.fit(docs, spark.createDataFrame([(4, 1), (5, 1), (6, 1), (None, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {1.0}
    both = toxicity.fit(docs, spark.createDataFrame([(4, 1), (5, 0), (6, 0), (2, 0), (3, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, both).where("score BETWEEN 0 AND 1").count() == 8
    assert toxicity.score(empty(spark), both).count() == 0


# 6 packing

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(60)) + rng.choice(["", "\n", " ,x", " \u00a0y", "  two", "it's Ünï", "日本", "<|endoftext|>", "\t\tz", "12ab", "x\n\ny"])) for i in range(120)] + [(200, None), (201, ""), (7, "again")]
    docs = frame(spark, rows).withColumn("ids", F.lit(1)).withColumn("part", F.lit(1))
    pieces = packing.pack(docs, tokenizer_path(), length=64).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows)
    by, at = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
        ids = np.frombuffer(p["ids"], dtype="<u4")
        assert len(ids) == p["length"]
        if p["start"] == 0:
            by.setdefault(p["doc_id"], []).append([])
        by[p["doc_id"]][-1].extend(ids.tolist())
    assert Counter(tuple(x) for xs in by.values() for x in xs) == want
    total = sum(len(k) * v for k, v in want.items())
    assert sorted(at) == list(range(-(-total // 64))) and all(n == 64 for s, n in at.items() if s < max(at))
    whole = packing.sequences(packing.pack(docs, tokenizer_path(), length=64)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total


def test_packing_empty(spark):
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0
    assert packing.pack(odd(spark), tokenizer_path()).where("start = 0").count() == 8


# 7 quality

def test_quality_orders_grades(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        grade = i % 3
        words = [w + "%" * (rng.random() < 0.45 * (2 - grade)) for w in prose(rng, 80).split()]
        rows.append((i, " ".join(words)))
        labels.append((i, grade))
    docs = frame(spark, rows)
    model = quality.fit(docs, frame(spark, labels, "doc_id long, quality int"))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.grade(docs, model, least=2).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([abs(got[i]["expected_grade"] - labels[i][1]) < 0.7 for i in held]) > 0.9
    assert np.mean([got[i]["selected"] == (labels[i][1] == 2) for i in held]) > 0.85


def test_quality_cases(spark):
    docs = odd(spark)
    none = quality.grade(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert len(none) == 8 and all(r["expected_grade"] is None and not r["selected"] for r in none)
    one = quality.grade(docs, quality.fit(docs, spark.createDataFrame([(4, 1), (5, 1), (6, 1)], "doc_id long, quality int"))).collect()
    assert {r["expected_grade"] for r in one} == {1.0} and all(r["selected"] for r in one)


# 8 decontamination

def brute_hits(t, items, window=10):
    lower = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    w, hit, found = lower(t), set(), set()
    for item, body in items:
        b = lower(body)
        m = min(window, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(10)
    items = [(str(i), prose(rng, rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [("12", None), ("13", " .,"), ("14", "Éa ÉA"), ("2", "alpha1 beta2")]
    rows = []
    for i in range(60):
        t = prose(rng, 40)
        if i % 3 == 0:
            body = (rng.choice(items)[1] or "").split()
            t += ", ".join(["", *body[: rng.randrange(1, 30)]]) + " " + prose(rng, 5)
        rows.append((i, t.upper() if i % 4 == 0 else t))
    rows += [(70, None), (71, ""), (0, rows[0][1])]
    found = decontaminate.decontaminate(frame(spark, rows), frame(spark, items, "item_id string, text string"), block_bytes=block_bytes)
    got = sorted((r["doc_id"], r["n_words"], r["h"], r["items"]) for r in found.withColumn("h", decontaminate.n_hit(F.col("spans"))).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t in rows)
    clean = decontaminate.clean(frame(spark, rows), frame(spark, items, "item_id string, text string"), block_bytes=block_bytes)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(g[0] for g in got if not g[2])


def test_decontamination_cases(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd(spark), none).where("size(items) = 0").count() == 8
    assert decontaminate.decontaminate(empty(spark), none).count() == 0
    assert decontaminate.clean(odd(spark), none).columns == odd(spark).columns


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_items_without_an_id_are_searched_for(spark, block_bytes):
    items = frame(spark, [(None, "one two three"), (7, "four five six seven"), (None, "eight nine ten"), (8, None)], "item_id long, text string")
    docs = frame(spark, [(1, "a one two three b eight nine ten"), (2, "four five six seven one two three"), (3, "four five six seven"), (4, "none")])
    found = decontaminate.decontaminate(docs, items, block_bytes=block_bytes)
    got = {r["doc_id"]: (r["h"], r["items"]) for r in found.withColumn("h", decontaminate.n_hit(F.col("spans"))).collect()}
    assert got == {1: (6, [None]), 2: (7, ["7", None]), 3: (4, ["7"]), 4: (0, [])}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items, block_bytes=block_bytes).collect()] == [4]


def test_matcher_tables_are_small():
    rng = random.Random(6)
    texts = [(f"i{i}", " ".join(f"w{rng.randrange(20_000)}" for _ in range(300))) for i in range(300)]
    matcher = decontaminate.Matcher(texts)
    assert matcher.nbytes() < 14 * sum(len(t) for _, t in texts)
    repeated = decontaminate.Matcher([("a", "x " * 400), ("b", "x y"), (None, "x y"), ("c", "")])
    n, spans, items = repeated.search("q " + "x " * 12 + "y q")
    assert (n, spans, items) == (15, [(1, 14)], ["a", "b", None])


# 9 fingerprints

def test_prefix_arrays_answer_spans_and_extensions():
    rng = random.Random(11)
    a = "".join(rng.choice("ab\U0001F600") for _ in range(200))
    b = a[:120] + "X" + a[121:]
    p, q = fingerprints.Prefix(text.codes(a)), fingerprints.Prefix(text.codes(b))
    for _ in range(300):
        i, j, n = rng.randrange(200), rng.randrange(200), rng.randrange(12)
        if max(i, j) + n <= 200:
            assert p.equal(i, q, j, n) == (a[i : i + n] == b[j : j + n])
        want = next((k for k in range(200) if max(i, j) + k >= 200 or a[i + k] != b[j + k]))
        assert p.extension(i, q, j) == want


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i * 3, prose(rng, rng.randrange(120))) for i in range(90)] + [(1000, None), (1001, ""), (1002, "ab"), (5, "😀" * 40)]
    got = {r["doc_id"]: r for r in fingerprints.compare(frame(spark, rows)).collect()}
    order = sorted(rows)
    spans = lambda t: {t[i : i + 12] for i in range(max(1, len(t) - 11))} if t else set()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e, r = t[: len(t) - cut] + following[:cut], got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t) and r["edited_fingerprint"] == fingerprints.fingerprint(e)
        for other, near in ((e, r["near_edited"]), (following, r["near_next"])):
            x, y = spans(t), spans(other)
            exact = 1.0 if t == other else 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0
            assert near == pytest.approx(exact, abs=0.25)
    assert np.mean([got[i]["near_edited"] for i, t in rows if t and len(t) > 200]) > 0.6


def test_fingerprint_cases(spark):
    assert fingerprints.compare(odd(spark)).count() == 8
    one = fingerprints.compare(frame(spark, [(1, "abcdefgh")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.compare(empty(spark)).count() == 0


# 10 html

PAGE = "<!doctype html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul>{menu}</ul></nav><div class='cookie-notice'>We use cookies</div>{body}<aside>side</aside><form>Name <input></form><section id=comments><article>nice!</article></section><footer>&copy; x</footer></body>"


def test_extraction():
    body = "<article><header><h1>A &amp; B</h1><span>by me</span></header><p>One  <b>two</b>\nthree<br>four<p>f&uuml;nf<!-- x --><ul><li>six<li>seven</ul><div class=ad>buy</div><blockquote>eight</article>"
    assert html_extract.extract(PAGE.format(menu="<li>m", body=body)) == "A & B\nOne two three four\nfünf\nsix\nseven\neight"
    assert html_extract.extract("a < b &lt; c <3") == "a < b < c <3"
    for nothing in (None, "", "<script>x</script>", "<nav>only", "<!-- x"):
        assert html_extract.extract(nothing) == ""
    assert html_extract.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_wrappers_find_main_text_without_article(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for i in range(24):
        parts = [prose(rng, 30) for _ in range(1 + i % 4)]
        body = "<div class=wrap><div class=tag>Welcome to the site</div><div class=story><h2>" + f"Title {i}</h2>" + "".join(f"<p>{p}" for p in parts) + "</div></div>"
        rows.append((i, f"http://Host.example/{i}", PAGE.format(menu="<li><a href=x>a</a>" * (1 + i % 3), body=body)))
        want[i] = "\n".join([f"Title {i}", *parts])
    rows += [(50, None, "<p>alone"), (51, "http://host.example/x", None), (52, "bad url", "")]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("of", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(pages).collect()}
    assert {i: got[i] for i in want} == want and got[50] == "alone" and got[51] == "" and got[52] == ""
    found = {r["host"]: r for r in html_extract.infer(pages).collect()}
    expression = html_extract.expression(json.loads(found["host.example"]["wrapper"]))
    assert found["host.example"]["pages"] == 24 and "(<p>" in expression and "#fixed" in expression
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_alignment_makes_optional_and_repeated_groups():
    shapes = [html_extract._shape(html_extract.tree(p)) for p in ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl><hr>", "<h1>x</h1><dl><dt>q<dd>b</dl>")]
    wrapper = shapes[0]
    for s in shapes[1:]:
        wrapper = html_extract.merge(wrapper, s)
    assert html_extract.expression(wrapper) == "<> (<h1> #fixed </h1>)? <dl> ((<dt> #TEXT </dt> <dd> #TEXT </dd>))+ </dl> (<hr/>)? </>"


def ruled(pages):
    """The pages' main texts under the rules of their common wrapper."""
    shapes = [html_extract._shape(html_extract.tree(p)) for p in pages]
    wrapper = shapes[0]
    for s in shapes[1:]:
        wrapper = html_extract.merge(wrapper, s)
    rule = html_extract.rules(wrapper, len(pages))
    return [html_extract.extract(p, rule) for p in pages]


def test_texts_of_one_page_are_not_the_templates():
    pages = [f"<body><div class=tag>Welcome</div><div class=story><p>{n} words</p></div></body>" for n in ("one", "two", "three", "four")]
    pages[1] = pages[1].replace("</p>", "</p><blockquote>only here</blockquote><h3>Alone</h3>")
    pages[2] = pages[2].replace("</p>", "</p><ul><li>same<li>same<li>same</ul>")
    assert ruled(pages) == ["one words", "two words\nonly here\nAlone", "three words\nsame\nsame\nsame", "four words"]
    strangers = [f"<body><div class={n}><p>all of {n}</p></div></body>" for n in ("red", "green", "blue", "grey")]
    assert ruled(strangers) == [f"all of {n}" for n in ("red", "green", "blue", "grey")]


def test_no_text_beside_the_main_container_is_lost():
    usual = [f"<body><div class=top>Welcome</div><div class=page><div class=intro>Intro {n}</div><div class=story><p>{n} " + "word " * 30 + "</p></div></div></body>" for n in range(8)]
    rare = [f"<body><div class=top>Welcome</div><div class=page><div class=story><p>Short {n}</p></div><div class=other-text><p>{n} " + "long " * 40 + "</p></div></div></body>" for n in range(2)]
    want = [f"Intro {n}\n{n} " + " ".join(["word"] * 30) for n in range(8)] + [f"Short {n}\n{n} " + " ".join(["long"] * 40) for n in range(2)]
    assert ruled(usual + rare) == want and ruled(usual) == want[:8] and ruled(rare) == ["Welcome\n" + w for w in want[8:]]
    mixed = [f"<body><div class=box id={'x' if n else 'comments'}><p>Text {n}</p></div><div class=story><p>{n} more</p></div></body>" for n in range(4)]
    assert ruled(mixed) == ["0 more", *(f"Text {n}\n{n} more" for n in range(1, 4))]


def test_slugs_do_not_make_a_region_other():
    page = "<article><h2 id=social-life>Social life</h2><section id=search-methods><p>Found</section><h3 id=legal>Legal</h3><h3 class=section-header>Part</h3><div id='related-work'>Work</div><p id=list-form>Form</p><div id=comments>nice!</div></article>"
    assert html_extract.extract(page) == "Social life\nFound\nLegal\nPart\nWork\nForm"
    assert html_extract.extract("<div id=site-footer>x</div><div id=cookieNotice>y</div><div id=main-nav>z</div><div id=form-of-life>kept</div>") == "kept"


def test_deep_nesting_keeps_blocks_and_other_regions(spark):
    deep = "<div>" * 600 + "<p>a<p>b<nav>menu</nav><form>Name</form>" + "</div>" * 600
    assert html_extract.extract(deep) == "a\nb"
    rows = [(i, "http://deep.example/", deep.replace("<p>a", f"<p>a{i}")) for i in range(4)]
    got = html_extract.main_texts(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"a{i}\nb" for i in range(4)}


def story(i, extra=""):
    return f"<html><body><ul class=top><li><a href=/>Home</a></li></ul><div class=story><h2>Title {i}</h2><p>Body text {i} of its own</p>{extra}<p>Closing words {i * 7}</p></div></body></html>"


def test_what_one_page_alone_has_stays():
    pages = [story(1), story(2, "<blockquote>Only here</blockquote><p>And this</p>"), story(3), story(4)]
    got = ruled(pages)
    assert got[1].split("\n") == ["Title 2", "Body text 2 of its own", "Only here", "And this", "Closing words 14"]
    assert all(g.startswith("Title") for g in got)


def article(i, body):
    return f"<html><body><article><p class=lead>Read this first</p><h1>Head {i}</h1>{body}<p class=end>Thanks for reading</p></article></body></html>"


def test_template_texts_in_articles_go_and_copies_stay():
    own = [article(i, f"<p>A body of page {i} that is longer than what all pages share with one another</p>") for i in range(5)]
    assert ruled(own)[2].split("\n") == ["Head 2", "A body of page 2 that is longer than what all pages share with one another"]
    same = "<p>The very same body stands on most pages of this host</p>"
    mixed = [article(7, same)] * 4 + [article(8, "<p>Another body altogether, found on one page of it alone</p>")]
    assert ruled(mixed)[0].split("\n") == ["Head 7", "The very same body stands on most pages of this host"]
    copies_ = [article(7, same)] * 4  # nothing tells what is the template's
    assert ruled(copies_)[0].split("\n") == ["Read this first", "Head 7", "The very same body stands on most pages of this host", "Thanks for reading"]


def test_the_wrapper_tells_teasers_from_the_article():
    page = "<html><body><div class=grid><article class=card><a href=/a>Another story {0}</a></article><article class=card><a href=/b>One more {0}</a></article></div><article><h1>Main {0}</h1><p>The text of {0}</p></article></body></html>"
    assert ruled([page.format(i) for i in range(4)])[3] == "Main 3\nThe text of 3"
    alone = html_extract.extract(page.format(3))
    assert alone.startswith("Another story 3")  # without a wrapper nothing tells them apart


def test_wrappers_do_not_depend_on_the_deal(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        parts = [rng.choice([f"<h2>H{i}</h2>", f"<p>text {i}</p>", "<hr>", f"<ul><li>x{i}<li>y</ul>", f"<div class=c{rng.randrange(4)}>z{i}</div>"]) for _ in range(rng.randrange(2, 7))]
        rows.append((i, f"http://h{i % 2}/{i}", "<body>" + "".join(parts) + "</body>"))
    schema = "page_id long, url string, html string"
    found = []
    for deal, forms in ((1, 500), (5, 500), (7, 500), (3, 4), (6, 4)):
        monkeypatch.setattr(html_extract, "FORMS", forms)
        pages = spark.createDataFrame(rows if deal % 2 else rows[::-1], schema).repartition(deal)
        found.append({r["host"]: (r["pages"], r["wrapper"]) for r in html_extract.infer(pages).collect()})
    assert found[0] == found[1] == found[2] and found[3] == found[4]
    assert {n for n, _ in found[3].values()} == {30}


def test_broken_pages_take_no_longer_than_others():
    import time

    worst = ['<a "' * 40_000, '<a "' * 40_001 + ">", "<div>" * 40_000 + "</b>" * 40_000, "</script " * 20_000 + "<script>" + "</script " * 40_000, "<a b='" * 40_000 + '">x']
    for page in worst:
        start = time.monotonic()
        html_extract.tree(page)
        assert time.monotonic() - start < 3
    assert html_extract.extract('<p>one</p><p class="x>two</p><p>three</p>') == "one\ntwo\nthree" and html_extract.extract("<p>kept</p><a href=") == "kept"


class _Plain(HTMLParser):
    """The blocks of the article but for its excluded elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.words, self.inside, self.out = [], "", 0, 0

    def flush(self):
        if " ".join(self.words.split()):
            self.blocks.append(" ".join(self.words.split()))
        self.words = ""

    def handle_starttag(self, tag, attributes):
        if tag == "article":
            self.inside += 1
        if tag in ("p", "h1", "li", "blockquote", "aside", "div", "article"):
            self.flush()
        if tag in ("aside", "script") or dict(attributes).get("class") == "ad":
            self.out += 1
        elif self.out and tag == "div":
            self.out += 1

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "blockquote", "aside", "div", "article"):
            self.flush()
        if tag in ("aside", "script") or tag == "div" and self.out:
            self.out -= 1
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.out:
            self.words += data


def test_extraction_against_another_parser(spark):
    rng = random.Random(12)
    rows = []
    for i in range(80):
        word = lambda: rng.choice(["alpha", "b &amp; c", "déjà", "x &lt; y", "two  spaces", "line\nend"]) + str(rng.randrange(1000))
        inner = lambda: " ".join(rng.choice([word(), f"<b>{word()}</b>", f"<a href='/{i}'>{word()}</a>"]) for _ in range(rng.randrange(1, 5)))
        block = lambda: rng.choice([f"<p>{inner()}</p>", f"<ul><li>{inner()}</li><li>{inner()}</li></ul>", f"<blockquote>{inner()}</blockquote>", f"<div class=ad><div>{inner()}</div></div>", f"<aside>{inner()}</aside>", f"<script>var a = '<p>{i}</p>';</script>", f"<!-- {i} --><p>{inner()}</p>"])
        body = "".join(block() for _ in range(rng.randrange(1, 9)))
        rows.append((i, f"http://host{i % 3}.example/{i}", f"<!doctype html><html><body><nav>{inner()}</nav><article><h1>{word()}</h1>{body}</article><footer>{inner()}</footer></body></html>"))
    wanted = {}
    for i, _, page in rows:
        plain = _Plain()
        plain.feed(page)
        plain.close()
        wanted[i] = "\n".join(plain.blocks)
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == wanted
