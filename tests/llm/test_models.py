"""The two operators that learn: accuracy on held-out rows, and the parts that must be exact."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import langid, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.QUERIES["op1_language"](spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def network(spark):
    return langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), texts=60)


def test_language_of_odd_texts(documents, network):
    docs = documents([(1, None, "x", 3), (2, "", "x", 3), (3, "123 !? 😀", "x", 3), (None, "the " * 400_000, "x", 3), (5, "a", "x", 3)], "lang_pred string, score int")
    got = {r.doc_id: r for r in langid.with_language(docs, network).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[None].lang_pred == "en" and got[5].lang_pred in network.languages


def test_no_labels_no_language(documents, spark):
    assert langid.fit(documents([(1, "text")])) is None
    assert [tuple(r) for r in langid.with_language(documents([(1, "text")]), None).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert langid.fit(documents([])) is None and langid.with_language(documents([]), None).count() == 0


def test_windows_cover_the_whole_text():
    data = np.arange(1, 251, dtype=np.uint8).repeat(5)
    windows, lengths = langid.cut(data)
    assert lengths.sum() == len(data) and np.concatenate([w[:n] for w, n in zip(windows, lengths, strict=True)]).tolist() == data.tolist()


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    windows = np.concatenate([rng.choice([97, 98], (80, langid.WINDOW)), rng.choice([99, 100], (80, langid.WINDOW))]).astype(np.uint8)
    labels = np.repeat([0, 1], 80)
    net = langid.train(windows, labels, ["x", "y"])
    assert (net.logits(windows).argmax(axis=1) == labels).all()


def index_of(n=200, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}x" for i in range(300)]
    texts, toxic = [], []
    for i in range(n):
        own = rng.choice(words, 30).tolist()
        toxic.append(int(i % 3 == 0))
        texts.append(" ".join(own + ["grumble"] * toxic[-1] + ["pleasant"] * (1 - toxic[-1])).encode())
    views = [np.frombuffer(t, np.uint8) for t in texts]
    return toxicity.build(list(range(n)), views, np.array(toxic), (n - sum(toxic), sum(toxic))), views


def test_neighbours_are_exact():
    """Blocks are left out only if they cannot matter: the same as all cosines sorted."""
    index, views = index_of()
    matrix = index.weights.transpose(0, 2, 1).reshape(-1, len(index.terms))
    for view in views[:60]:
        found, w = index.vector(view)
        best, sims = index.nearest(found, w, 10)
        cosines = matrix[:, found] @ w
        order = np.lexsort((np.arange(len(cosines)), -np.round(cosines, 9)))
        order = order[cosines[order] > 0][:10]
        assert best.tolist() == order.tolist() and np.allclose(sims, cosines[order])


def test_terms_do_not_depend_on_the_block(monkeypatch):
    text = np.frombuffer(("ab  \n cd " * 40 + "x" * 50 + " " * 30 + "Yz").encode(), np.uint8)
    whole = sorted(np.concatenate(list(toxicity.blocks_of(text))).tolist())
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        assert sorted(np.concatenate(list(toxicity.blocks_of(text))).tolist()) == whole


def test_odd_texts_and_tables(spark, documents):
    index, _ = index_of()
    docs = documents([(1, None, 5), (2, "", 5), (3, "GRUMBLE  grumble", 5), (3, "GRUMBLE  grumble", 5), (None, "pleasant " * 300_000, 5)], "score int")
    got = sorted(toxicity.with_toxicity(docs, index).collect(), key=lambda r: (r.doc_id or 9))
    assert got[0].score == got[1].score < 0.5 and not got[0].neighbours
    assert got[2].predicted == got[3].predicted == 1 and got[4].predicted == 0
    assert all(n.toxic == 1 for n in got[2].neighbours)
    assert toxicity.not_toxic(docs, index).count() == 3 and toxicity.not_toxic(docs, index).columns == docs.columns
    nothing = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(documents([(1, "a")]), nothing) is None
    assert [r.score for r in toxicity.with_toxicity(documents([(1, "a")]), None).collect()] == [0.0]
    only_null = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.fit(documents([(1, "a")]), only_null) is None


def test_toxicity_on_held_out_rows(spark):
    """Of the rows that hold one of the words that mark toxic English text, nearly all are found, and few others."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = (queries.QUERIES["op10_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id", F.lower("text").alias("t")), "doc_id")
            .withColumn("worded", F.rlike("t", F.lit("idiot|moron|trash|pathetic"))).collect())
    marked = [r for r in rows if r.toxic and r.worded]
    clean = [r for r in rows if not r.toxic]
    assert len(marked) > 30 and np.mean([r.predicted for r in marked]) > 0.95
    assert np.mean([r.predicted for r in clean]) < 0.02


def test_a_copied_text_is_one_example(documents, spark):
    """Copies, in whatever case and spacing, neither take the vocabulary nor count as evidence of their own."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(n))
    words = ["".join(rng.choice(list("qrstuvwxyz"), 8)) for _ in range(8)]
    toxic, clean, copied = [f"{prose(8)} {words[i % 8]} {prose(8)}" for i in range(320)], [prose(17) for _ in range(320)], prose(1000)
    copies = [copied.upper() if i % 2 else f"\t{copied} \n" for i in range(320)]
    texts = [*toxic, *clean, *copies]
    labels = spark.createDataFrame([(i, int(i < 320)) for i in range(len(texts))], "doc_id bigint, toxic int")
    index = toxicity.fit(documents(list(enumerate(texts))), labels)
    assert sorted(np.bincount(index.toxic).tolist()) == [320, 321]
    got = toxicity.with_toxicity(documents([(i, f"{prose(8)} {w} {prose(8)}") for i, w in enumerate(words)] + [(8, copied), (9, prose(17))]), index).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id)] == [1] * 8 + [0, 0]


def test_a_rare_word_finds_its_example():
    """A word that only one labelled text has is too rare to be evidence, and still leads to that text."""
    rng = np.random.default_rng(4)
    prose = lambda n=20: " ".join(f"w{i}x" for i in rng.integers(0, 300, n))
    rare = ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(40)]
    texts = [f"{prose()} {w}" for w in rare] + [prose() for _ in range(160)]
    toxic = np.array([1] * 40 + [0] * 160)
    index = toxicity.build(list(range(200)), [np.frombuffer(t.encode(), np.uint8) for t in texts], toxic, (160, 40))
    near = [index.ids[index.nearest(*index.vector(np.frombuffer(f"{prose(10)} {w}".encode(), np.uint8)), toxicity.NEIGHBOURS)[0]] for w in rare]
    alone = [index.ids[index.nearest(*index.vector(np.frombuffer(w.encode(), np.uint8)), 1)[0]].tolist() for w in rare]
    assert np.mean([i in ids for i, ids in enumerate(near)]) > 0.9 and alone == [[i] for i in range(40)]



def test_stage_rejects_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.not_toxic(spark, docs, folder).select("doc_id")
    gone = docs.join(kept, "doc_id", "anti").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    toxic = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").count()
    assert sum(r.toxic == 1 for r in gone) > toxic / 2 and sum(r.toxic == 0 for r in gone) <= 2


def test_a_language_of_long_texts_is_learned(documents):
    """Texts of any length teach, and rows without a letter neither count nor name a language."""
    rng = np.random.default_rng(5)
    prose = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, prose("abcdefgh", 60), "x") for i in range(60)] + [(100 + i, prose("stuvwxyz", 4000), "y") for i in range(60)] + [(200, "123", "z")]
    net = langid.fit(documents(rows, "lang string"), texts=40)
    assert net.languages == ["x", "y"]
    got = langid.with_language(documents([(1, prose("abcdefgh", 50)), (2, prose("stuvwxyz", 50))]), net).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["x", "y"]


def pieces(text):
    """The terms of a text, by a plain loop."""
    out = []
    for run in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower() if isinstance(text, bytes) else text.encode().lower()):
        out += [run] if len(run) <= toxicity.LONG else [(run[k:k + toxicity.RUN],) for k in range(len(run) - toxicity.RUN + 1)]
    return Counter(out)


def brute_scores(texts, toxic, asked):
    """(raw score, neighbours) of every asked text, from IDF to votes, without anything of the operator."""
    n, base = len(texts), sum(toxic) / len(texts)
    counts = [pieces(t) for t in texts]
    holders = {}
    for i, c in enumerate(counts):
        for term in c:
            holders.setdefault(term, []).append(i)
    tried, own = sum(map(len, counts)), {}
    for term, at in holders.items():
        share = sum(toxic[i] for i in at) / len(at)
        divergence = sum(p * math.log(p / q) for p, q in ((share, base), (1 - share, 1 - base)) if p)
        own[term] = (math.log((1 + n) / (1 + len(at))) + 1) ** 2 * min(1, len(at) * divergence / math.log(tried / toxicity.ACCIDENT))

    def unit(c):
        w = {term: (1 + math.log(k)) * own[term] for term, k in c.items() if term in own}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {term: x / max(size, 1e-12) for term, x in w.items()}

    units = [unit(c) for c in counts]
    out = []
    for text in asked:
        q = unit(pieces(text))
        sims = sorted(((sum(x * u.get(term, 0) for term, x in q.items()), i) for i, u in enumerate(units)), reverse=True)
        best = [(c, i) for c, i in sims if c > 1e-12][:toxicity.NEIGHBOURS]
        yes = sum(c * c for c, i in best if toxic[i])
        out.append(((yes + toxicity.PRIOR_WEIGHT * base) / (sum(c * c for c, i in best) + toxicity.PRIOR_WEIGHT), best))
    return out


@pytest.fixture(scope="module")
def mixed_texts():
    """Prose in a few hundred words, texts without spaces, and two words that mark the toxic ones."""
    rng = np.random.default_rng(9)
    texts, toxic = [], []
    for i in range(150):
        words = [f"w{k}x" for k in rng.zipf(1.4, rng.integers(1, 60)) % 400]
        toxic.append(int(i % 4 == 0))
        words += [str(rng.choice(["Grumble", "snarl!"]))] * int(rng.integers(1, 3)) * toxic[-1]
        if i % 10 == 0:
            words.append("".join(rng.choice(list("\u4e00\u4e8c\u4e09\u56db"), 30)))
        rng.shuffle(words)
        texts.append(f"{i} " + " ".join(words))
    return texts, toxic


def test_scores_against_brute_force(mixed_texts):
    texts, toxic = mixed_texts
    index = toxicity.build(list(range(150)), [np.frombuffer(t.encode(), np.uint8) for t in texts], np.array(toxic), (150 - sum(toxic), sum(toxic)))
    asked = [f"{a[:60]} {b[-60:]}" for a, b in zip(texts[:60], texts[60:120], strict=True)] + ["grumble", "nothing known", ""]
    for text, (raw, best) in zip(asked, brute_scores(texts, toxic, asked), strict=True):
        near, sims = index.nearest(*index.vector(np.frombuffer(text.encode(), np.uint8)), toxicity.NEIGHBOURS)
        assert np.allclose(sims, [c for c, _ in best], atol=1e-6) and len(near) == len(best)
        assert abs(index.raw(near, sims) - raw) < 1e-5
        sure = {i for c, i in best if c > best[-1][0] + 1e-6}
        assert sure <= {int(index.ids[i]) for i in near}
        logit = math.log(raw / (1 - raw))
        assert abs(index.score(raw) - 1 / (1 + math.exp(-(index.line[0] * logit + index.line[1])))) < 1e-9


def test_calibration_is_the_least_loss(mixed_texts):
    """Scores of the examples among themselves: no other line near by has a smaller loss."""
    raw, label = np.random.default_rng(2).random(200), np.random.default_rng(3).integers(0, 2, 200)
    a, b = toxicity._calibrated(raw, label, np.ones(200))

    def loss(a, b):
        z = a * np.log(raw / (1 - raw)) + b
        return (np.log1p(np.exp(z)) - label * z).sum() + ((a - 1) ** 2 + b * b) / 2

    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_blocks_are_skipped_and_nothing_is_lost():
    index, views = index_of(400)
    scored = []
    for view in views:
        found, w = index.vector(view)
        sims, blocks = index.cosines(found, w, 5)
        whole, every = index.cosines(found, w, len(index.ids))
        assert every >= blocks and np.allclose(np.sort(sims)[-5:], np.sort(whole)[-5:])
        scored.append(blocks)
    assert np.mean(scored) < 0.8 * index.blocks


def test_words_in_scripts_without_spaces(documents):
    """A run too long for a word is known by its pieces, wherever it is cut."""
    rng = np.random.default_rng(8)
    run = lambda n: "".join(rng.choice(list("\u3042\u3044\u3046\u3048\u304a\u304b\u304d\u304f"), n))
    bad = "\u99ac\u9e7f\u91ce\u90ce"
    texts = [run(40) + bad * (i % 2) + run(40) for i in range(200)]
    index = toxicity.build(list(range(200)), [np.frombuffer(t.encode(), np.uint8) for t in texts], np.arange(200) % 2, (100, 100))
    got = toxicity.with_toxicity(documents([(1, run(30) + bad + run(50)), (2, run(80))]), index).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id)] == [1, 0]


def test_short_texts_are_taken_apart_together(monkeypatch):
    """One pass over many short texts gives what each gives by itself; a long one is read by itself."""
    index, views = index_of()
    texts = [np.frombuffer(t, np.uint8) for t in (b"", b"w1x", b"w1x W1X w2x", b" ", b"w3x" * 30, b"no term", b"grumble", b"w5x " * 90)] + views[:40]
    alone = [index.vector(t) for t in texts]
    calls, whole = [], toxicity._terms
    monkeypatch.setattr(toxicity, "_terms", lambda *a: calls.append(1) or whole(*a))
    for limit, most in ((300, len(texts) - 1), (1 << 20, 1)):
        monkeypatch.setattr(toxicity, "TOGETHER", limit)
        calls.clear()
        together = list(index.vectors(iter(texts)))
        assert len(calls) <= most and len(together) == len(alone)
        assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(alone, together, strict=True))


def test_tasks_take_texts_apart_together(monkeypatch):
    """The function that tasks run does not go through the steps of a text for each."""
    index, views = index_of()
    monkeypatch.setattr(toxicity.F, "arrow_udf", lambda kind: lambda f: lambda text: f)
    calls, whole = [], toxicity._terms
    monkeypatch.setattr(toxicity, "_terms", lambda *a: calls.append(1) or whole(*a))
    got = next(toxicity.assess(None, index)(iter([pa.array([v.tobytes().decode() for v in views])])))
    assert len(calls) == 1
    for row, view in zip(got.to_pylist(), views, strict=True):
        best, sims = index.nearest(*index.vector(view), toxicity.NEIGHBOURS)
        assert row["score"] == index.score(index.raw(best, sims)) and [x["doc_id"] for x in row["neighbours"]] == index.ids[best].tolist()


def test_an_index_without_terms():
    index = toxicity.build([1], [np.empty(0, np.uint8)], np.array([0]), (1, 0))
    assert [x.tolist() for v in index.vectors([np.frombuffer(b"a b", np.uint8)] * 2) for x in v] == [[]] * 4
