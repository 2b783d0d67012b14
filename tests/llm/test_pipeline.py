"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import re
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as entry
import brute
import corpus_pipeline
from check import connect, difference
from textgrade.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    found = difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])
    assert found is None, found


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def first_of_alike(texts, width=5, least=0.8):
    """Smallest id of each class of texts linked by a Jaccard similarity of ``least`` between sets of shingles."""
    words = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if (both >= least * (len(sets[a]) + len(sets[b]) - both)) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(i) for i in texts})


def test_near_dedup_by_five_word_jaccard(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        words = [f"w{g}x{k}" for k in range(150)]
        rows.append(words)
        for n in (1, 2, 3, 6, 12):  # edits, from a similarity of about 0.93 down to 0.4
            copy = list(words)
            for at in rng.choice(150, n, replace=False):
                copy[at] = f"new{rng.integers(1 << 30)}"
            rows.append(copy)
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], schema)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, FOLDER).collect())
    want = first_of_alike(texts)
    assert set(got) >= set(want) and len(set(got) - set(want)) <= 1  # candidates are pairs within 16 bits


def test_parts_of_characters_go(spark):
    texts = ["aé€😀z", "日本語 text", "\ufffd ok", "ÿþ"]
    data = [t.encode()[a:b] + t.encode()[c:] for t in texts for a in range(4) for b in range(a, 12) for c in range(b, 14)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, kept binary")
    for r in df.withColumn("t", corpus_pipeline._whole_characters("kept")).collect():
        assert r.t == data[r.i].decode("utf-8", "ignore")


def test_corpus_without_languages_keeps_its_documents(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["some words", "andere Wörter", "12 34", "", None])], schema)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, df, FOLDER).collect()) == [0, 1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()}
    lines = {i: t for i, t, n in brute.repeated_lines(kept.items(), 2) if not n or t.strip()}
    single = [(i, lines[i]) for i in first_of_alike(lines)]
    final = {}
    for (i, t), gone in zip(single, brute.repeated_bytes(single)):
        text = bytes(np.frombuffer(t.encode(), np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or text.strip():
            final[i] = text
    got = corpus_pipeline.run(spark, FOLDER).collect()
    library = packing.Tokens(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)).library
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want


def test_stages_of_odd_rows(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "the word is here", "en", "s", 16), (3, "the word is here", "en", "s", 16), (3, "the word is here", "en", "s", 16)]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, FOLDER)
            assert name == "best_fit_packing" or df.columns == list(corpus_pipeline.COLUMNS)
        assert {r.doc_id for r in df.collect()} <= {1, 2, 3, None}
