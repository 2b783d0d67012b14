"""Forced-boundary BPE against the library, Merkle manifest and filter audit against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textgrade.llm import audit, forced, merkle, queries

WORDS = P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = [
    "the ", "HELLO's ", "can'T'RE ", "éÈüß ŉĲǅ İı ", "ΣΑΣς ΐ", "日本語", "é ́x ", "<|startoftext|>", "<|endoftext|>", "<|other|> ",
    "\x1c\x1d\x85\xa0 ​\t\n", "12٣४½² ", "!?#$…—“” ", "😀👩‍👧", "qzjxqzvvk ", "</w>", "aaaaaaaaaaaaaaaaa ",
]

LETTERS = forced.byte_letters()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def own():
    return forced.Coder(WORDS)


# forced-boundary BPE


def test_ids_of_the_library(library, own):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000 + "c", "é" * 3000, "word " * 30_000, "\x00\x01" * 400]
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:80]
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_cuts_are_certain(library, own):
    """No token of the vocabulary reaches over a cut, and fragments merge to what the word merges to."""
    words = [w.encode() for w in ("hello", "qzjxvk", "x́y", "größe", "日本", "zzzqqqzzz")]
    fragments, owners = own.cut(words)
    assert len(fragments) > len(words)
    for k, word in enumerate(words):
        mine = [f for f, o in zip(fragments, owners) if o == k]
        assert b"".join(mine) == word + forced.END
        whole = own.merge([word + forced.END])[0].tolist()
        assert own.merge(mine)[0].tolist() == whole
    for token in library.get_vocab():  # tokens of the vocabulary stay whole
        ends = token.endswith("</w>") and len(token) > 4
        data = bytes(LETTERS[c] for c in (token[:-4] if ends else token))
        if token not in own.special:
            pieces = own.cut([data if ends else data + b"a"])[0]
            assert pieces[0].startswith(data), token


def test_full_caches_change_nothing(own):
    small = forced.Coder(WORDS)
    small.chunks.limit = small.fragments.limit = 2000
    texts = [f"w{i % 37} zq{i} {'x' * (i % 9)}" for i in range(600)]
    for at in range(0, 600, 50):
        for a, b in zip(small.encode(texts[at : at + 50]), own.encode(texts[at : at + 50])):
            assert a.tolist() == b.tolist()
    assert small.chunks.held <= 2000


def test_documents_of_odd_kinds(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  <|endoftext|>w", "x"), (3, "Hello  <|endoftext|>w", "x"), (None, "ΣΑΣ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = forced.encode_documents(df, WORDS)
    back = sorted((r.doc_id or 0, r.text) for r in forced.decode_documents(encoded, WORDS).collect())
    sums = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in forced.digests(df, WORDS).collect())
    want, texts = [], []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        texts.append((i or 0, text))
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert back == sorted(texts) and sums == sorted(want)
    assert forced.digests(df.limit(0), WORDS).count() == 0


def test_whole_table_as_the_library_does(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_forced_boundary_bpe(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """Root, and for each leaf its (siblings before, siblings after) level by level."""
    proofs, where, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            proofs[k].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        where = [at // 16 for at in where]
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return (nodes or [None])[0], proofs


def plain_manifest(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (first(r[0]), plain_leaf(*r)))
        trees.append((mine, *plain_tree([plain_leaf(*r) for r in mine])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (mine, subroot, proofs), top in zip(trees, tops):
        for r, proof in zip(mine, proofs):
            proof = proof + top
            folded = plain_leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                folded = plain_leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            for before, after in proof:
                folded = digest(before + folded + after)
            out.append((r[0], plain_leaf(*r), subroot, root, digest("".join(a + b for a, b in proof)), folded, folded == root))
    return out


def ours(spark, rows, folder_schema=DOCS):
    df = spark.createDataFrame(rows, folder_schema).withColumns({"leaf": F.lit("clash"), "tree": F.lit(1), "idx": F.lit(None).cast("int")})
    fields = [merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in merkle.PARTS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(df, F.when(changed, merkle.leaf_digest(*fields)))


def by_text(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 5, 1, 33), (1, 257, 2), tuple([1] * 20)])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(1000 * s + i, f"Text {i} É", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    assert by_text(ours(spark, rows).audit().collect()) == by_text(plain_manifest(rows))


def test_trees_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"T{i}", None, "hot" if i % 3 else None, i) for i in range(700)]
    built = ours(spark, rows)
    assert len(built.passes) >= 3
    assert by_text(built.audit().collect()) == by_text(plain_manifest(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (None, "", "", "", 0), (None, "", "", "", 0), (2, "A" * 300_000, "en", "é", 1), (2, "a", "en", "é", 1),
        (5, "SAME", "en", "z", 4), (5, "SAME", "en", "z", 4), (7, "x:-", "-", "-", -1),
    ]
    built = ours(spark, rows)
    assert by_text(built.audit().collect()) == by_text(plain_manifest(rows))
    for r in built.proofs().collect():
        assert merkle.fold(r.leaf, [(p.pos, p.run) for p in r.proof]) == built.root
    empty = ours(spark, [])
    assert empty.root is None and empty.audit().count() == 0


# filter audit


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, s in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = {}
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        parts.setdefault(s or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, found in parts.items():
        share, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                share[f] += len(gone)
                failed = sum(f in d[0] for d in found)
                lines.append((f, (part, "".join(order), step, len(left), len(gone), failed - len(gone), sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*line, share[f]) for f, line in lines]
    return sorted(out)


def test_audit_of_odd_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, None, None), (2, "", None), (3, "", "a"), (4, long_, "a"), (5, long_, "a"), (5, long_, "a"), (6, long_ + " #", "b"), (7, "Ab " * 300, "b"),
        (None, long_, "a"), (None, None, ""), (8, "x\x0by\tz\x0cw v", "b"), (9, "ÀB" * 20, "c"), (4, long_, "c"), (10, "w " * 100_000, "c"),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (6, None, 1), (99, 1, 1), (5, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("clash"), "mask": F.lit(0), "n": F.lit(9)})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))
    got = audit.audit(audit.mask_counts(df, said))
    names = ["part", "filter_order", "step", *audit.COUNTS]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == plain_audit(rows, labels)
    assert audit.audit(audit.mask_counts(df.limit(0), said)).count() == 0
    assert audit.audit(audit.mask_counts(df, said.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_min_plus_steps():
    orders, steps = audit.removal_steps(4)
    for mask in range(16):
        for order, step in zip(orders, steps[mask]):
            want = next((k for k, f in enumerate(order) if mask >> f & 1), audit.STAYS)
            assert step == want
