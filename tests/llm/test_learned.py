"""Language ID by held-out accuracy and brute-force marginals, nearest neighbours by recall."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgrade.llm import ann, langid

FOLDER = "/root/testdata/sf0.001"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    sizes, change = np.array([3, 1, 0, 4]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(sizes.sum(), 3))
    got, moves = langid.marginals(scores, sizes, change, count=True)
    want, want_moves, at = np.zeros_like(scores), np.zeros((3, 3)), 0
    for n in sizes:
        paths = list(product(range(3), repeat=int(n)))
        weight = np.array([np.exp(sum(scores[at + i, s] for i, s in enumerate(p)) + sum(change[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for i, s in enumerate(p):
                want[at + i, s] += w
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).filter(langid.held_out() & (F.length("text") > 100))
    row = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert row[0] > 0.95 and row[1] > 10


def test_code_switched_words_have_their_own_language():
    words = {"aa": ["saba", "daba", "gaba", "laba"], "bb": ["zoto", "moto", "koto", "roto"]}
    rng = np.random.default_rng(2)
    model = langid.fit([(lang, list(rng.choice(w, 20))) for lang, w in words.items() for _ in range(60)])
    reader = langid.Reader(model)
    lang, score = reader.read(["saba laba gaba gaba moto koto", "zoto 12 !! roto", "", "12 3.4"])
    assert lang == ["aa", "bb", "und", "und"] and 0.55 < score[0] < 0.8 and score[1] > 0.9 and score[2:] == [0, 0]
    chances, _ = langid.marginals(model.emissions(["saba", "laba", "moto", "koto"]), np.array([4]), model.change)
    assert chances.argmax(axis=1).tolist() == [0, 0, 1, 1]


def test_language_workers_hold_little(monkeypatch):
    """Chunks of a few texts are learned at once; a full cache keeps what is common and drops what a batch adds."""
    rng = np.random.default_rng(3)
    model = langid.fit([("aa", ["saba", "daba"] * 10), ("bb", ["zoto", "moto"] * 10)] * 9)
    texts = [" ".join(["saba", "zoto", *("".join(rng.choice(list("abotz"), 7)) for _ in range(60))]) for _ in range(400)]
    want = langid.Reader(model).read(texts)
    asked = []
    monkeypatch.setattr(langid.Model, "emissions", lambda self, words, own=langid.Model.emissions: asked.append(list(words)) or own(self, words))
    monkeypatch.setattr(langid, "GROUP", 5_000, raising=False)
    assert langid.Reader(model).read(texts) == want
    assert max(map(len, asked)) < 1_000 < sum(map(len, asked))
    asked.clear()
    monkeypatch.setattr(langid, "CACHE", 500)
    reader = langid.Reader(model)
    got = [reader.read(texts[i : i + 10]) for i in range(0, 30, 10)]
    assert sum(words.count("saba") for words in asked) == 1 and "saba" in reader.chunks
    assert len(reader.chunks) == len(reader.words) < 700 and reader.missed > 500
    got += [reader.read(texts[i : i + 10]) for i in range(30, 400, 10)]
    assert [x for langs, _ in got for x in langs] == want[0] and np.allclose([x for _, scores in got for x in scores], want[1], atol=1e-5)


def test_languages_of_odd_rows(spark):
    rows = [(i, f"{'aba saba' if i % 2 else 'oto zoto'} " * 10, "a" if i % 2 else "b", "x") for i in range(60)]
    rows += [(100, None, "a", "x"), (101, "", None, None), (None, "saba aba", None, "x"), (102, "…12", "a", "x"), (103, "ABA " * 50_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None, 1, 2)] == ["und", "und", "und", "a", "a", "a", "b"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df.limit(0), langid.train(df)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.train(df.filter("lang IS NULL"))).collect()} == {"und"}


def brute_nearest(rows, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in fine.items():
        near = sorted(((-float((x * y).sum()), i) for i, y in fine.items() if i != q))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("probe_all", [True, False])
def test_nearest(spark, probe_all):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "part": F.lit(1)})
    got = {}
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0 if probe_all else 0.95).orderBy("query_id", "rank")
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, 20)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= (0.99 if probe_all else 0.9) * 20 * len(got)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and all(i != q for i, _ in found)
        assert not set(found) & set(want[q]) or np.allclose(*zip(*[(s, dict(want[q]).get(i, s)) for i, s in found]), atol=1e-12)


def test_nearest_of_odd_rows(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (40, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.0]), (7, [1.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 0.5), (20, 2, 6, -1.0)]
    more = spark.createDataFrame([(80, [2.0]), (20, [3.0]), (80, [2.0, 0.0]), (100, [1.0, 2.0, 3.0])], df.schema)
    got = [tuple(r) for r in ann.nearest(df.union(more), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    twenty = [(20, 1, 80, 6.0), (20, 2, 7, 3.0), (20, 3, 1, 0.5), (20, 4, 6, -1.0)]
    assert got == twenty + [(80, 1, 20, 6.0), (80, 2, 7, 2.0), (80, 3, 1, 1.0), (80, 4, 6, -2.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_probes_and_nearly_empty_parts_give_k_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    lone = [(20 * i, (np.eye(8)[i % 8] * 10 + 0.01 * rng.normal(size=8)).tolist()) for i in range(16)]
    crowd = [(1000 + i, (-np.ones(8) + 0.01 * rng.normal(size=8)).tolist()) for i in range(600)]
    again = [(20, lone[3][1])] * 30 + [(40, lone[2][1])] * 30  # repeated ids hold one candidate each

    def by_axis(vectors, parts, recall):
        router = ann.Router([np.zeros((8, 1)), np.zeros(1), np.zeros((1, 8)), np.zeros(8), np.eye(8)])
        return router  # one probe: the part of the largest component

    monkeypatch.setattr(ann, "learn", by_axis)
    df = spark.createDataFrame(lone + crowd + again, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") < 1000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {i for i, _ in lone} and all(len(set(ids)) == len(ids) == 20 and q not in ids for q, ids in got.items())


def test_recall_on_the_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    slim = [(r.vec_id, r.embedding) for r in rows.select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in slim]), np.array([v for _, v in slim], float)
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        score[ids == ids[q]] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got) and all(len(g) == 20 for g in got.values())
