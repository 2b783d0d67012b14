"""SimHash classes against brute force, with short, long and dealt-out lists."""

import numpy as np
import pytest
import xxhash

from textgrade.llm import common, simhash
from textgrade.llm.common import components


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(fps, max_bits=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "a b c d e", "a b c d e " * 50, "É ñ ü x y z", "A B C D E", "w " * 40_000, "no\xa0break space here now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("block_size", [4096, 50])
def test_links_connect_what_is_near(spark, block_size):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for at, n in ((0, 200), (1, 40), (2, 5)):  # chains and clusters around one fingerprint
        x = fps[at]
        for _ in range(n):
            for bit in rng.integers(0, 30, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps += [fps[5] ^ 0b1111, fps[6] ^ 0b11111, 0, 0, 15]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = components(simhash.links(df, block_size=block_size)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == brute_roots(fps)


def test_classes_with_odd_rows(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", None), (3, "a b c d e f", "x"), (None, "only me here now", "x"), (9, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", df_col())
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, None), (9, 8), (8, 8)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def df_col():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b").unionAll(spark.createDataFrame([(900, 901), (7, None), (5, 5)], "a long, b long"))
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(300)} | {900: 900, 901: 900}


@pytest.mark.parametrize("max_bits, positions", [(4, 8), (16, 17), (10, 12)])
def test_postings_meet_within_the_bound(spark, max_bits, positions):
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(40):
        x = int(rng.integers(0, 2**63))
        pairs.append((x, x ^ sum(1 << int(b) for b in rng.choice(63, max_bits, replace=False))))
    df = spark.createDataFrame([(f,) for p in pairs for f in p], "fp long").distinct()
    keys = {}
    for r in simhash.postings(df, max_bits, positions).collect():
        keys.setdefault(r.fp, set()).add((r.places, r.bytes))
    assert all(keys[a] & keys[b] for a, b in pairs)


@pytest.mark.parametrize("positions", [8, 17, 18, 21])
def test_tally_counts_matching_positions(positions):
    rng = np.random.default_rng(4)
    differ = np.bitwise_and.reduce(rng.integers(0, 2**64, (3, 500), dtype=np.uint64))
    bits = [f"{x:064b}"[::-1] for x in [0, *differ.tolist()]]
    edges = [64 * i // positions for i in range(positions + 1)]
    want = [sum("1" not in b[lo:hi] for lo, hi in zip(edges, edges[1:])) for b in bits]
    assert simhash.tally(np.r_[np.uint64(0), differ], positions).tolist() == want


def test_wide_pairs_with_the_tally(spark):
    """All pairs within the bound and no others, from an index whose guaranteed minimum is more than one match."""
    assert simhash.SPARE > 1
    rng = np.random.default_rng(6)
    fps = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for f in fps[:20] for k in (3, 9, 16, 17)]
    nodes = spark.createDataFrame([(i, f, 100, i) for i, f in enumerate(fps)], "mark long, fp long, n int, root long")
    want = {(i, j) for j in range(len(fps)) for i in range(j) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 16}
    assert {(r.a, r.b) for r in simhash.wide_pairs(nodes, 16, 0.8, False).collect()} == want


def jaccard(a, b, width=5):
    def parts(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stage_against_brute_force_jaccard(spark):
    """Planted edits of one to eight words in 160: similarity from 0.94 down to about 0.65."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 8):
            copy = list(base)
            for at in rng.choice(160, edits, replace=False):
                copy[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += ["", " ", "one two", "One  two", "one two three"] + [texts[0]] * 50
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if find(i) != find(j) and jaccard(a, texts[j]) >= 0.8:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    want = {find(i) for i in range(len(texts))}
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got) == sorted(want)


def near_copies(rng, groups, copies, words=60, edits=3):
    """Texts around a few bases; two copies of one base are about 0.6 to 1 alike."""
    texts = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        for _ in range(copies):
            copy = list(base)
            for at in rng.choice(words, int(rng.integers(0, edits)), replace=False):
                copy[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    return texts


def fingerprint(text, width=5):
    return simhash.majority(np.unique(simhash.shingle_hashes(text.encode(), width)))


def linked(text_of, max_bits=16, threshold=0.8):
    """All pairs of different texts within the bits whose similarity is enough."""
    marks, fps = sorted(text_of), {m: fingerprint(t) for m, t in text_of.items()}
    return {(a, b) for i, b in enumerate(marks) for a in marks[:i] if (fps[a] ^ fps[b]).bit_count() <= max_bits and jaccard(text_of[a], text_of[b]) >= threshold}


def roots_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def set_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    text_of = {r.mark: texts[r.doc_id] for r in simhash.shingle_sets(df).collect()}
    return df, text_of


def test_alike_sets_share_a_listed_shingle(spark):
    """No pair is lost by the lists, unrelated texts have none, and a passage that all hold brings them no pairs."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{x}" for x in range(40))
    texts = near_copies(rng, 12, 6) + [" ".join(f"u{x}" for x in rng.integers(0, 10**7, 80)) for _ in range(30)]
    texts += [passage + " " + " ".join(f"x{x}" for x in rng.integers(0, 10**7, 40)) for _ in range(60)] + ["", "one two", "one two three four five six"]
    df, text_of = set_rows(spark, texts)
    cells = simhash.saved(simhash.set_cells(df))
    shared = simhash.shared_shingles(cells, 0.8).collect()
    lists = {}
    for r in shared:
        lists.setdefault(r.key, set()).add(r.mark)
    alone = {m for m, t in text_of.items() if t.startswith("u")}
    assert not alone & {r.mark for r in shared}
    want = linked(text_of)
    assert len(want) > 20 and all(any({a, b} <= held for held in lists.values()) for a, b in want)
    nodes = cells.selectExpr("explode(arrays_zip(mark, fp, n)) AS x").selectExpr("x.*", "x.mark AS root")
    kept = spark.createDataFrame(shared, "mark long, key int, at int")
    found = {(r.a, r.b) for r in simhash.wide_pairs(nodes, 16, 0.8, False, shared=kept).collect()}
    assert want <= found and not any(text_of[a].startswith("p0") for a, b in found)
    firsts = {(r.a, r.b) for r in simhash.wide_pairs(nodes, 16, 0.8, True, shared=kept).collect()}
    assert firsts <= found and len(firsts) <= len(shared)


@pytest.mark.parametrize("size", [1000, 16])
def test_crowds_give_few_rows_and_lose_no_link(spark, size):
    """Near copies of which some are linked and some are not: at most a row for each set and pair of blocks."""
    texts = near_copies(np.random.default_rng(9), 2, 50, edits=7)
    df, text_of = set_rows(spark, texts)
    sets = simhash.shingle_sets(df).dropDuplicates(["mark"]).selectExpr("mark", "fp", "n", "mark AS root", "shingles")
    crowds = sets.selectExpr("cast(1 as long) AS place", "mark")
    found = [(r.a, r.b) for r in simhash.crowd_links(crowds, sets, 16, 0.8, size=size).collect()]
    want = linked(text_of)
    assert set(found) <= want and roots_of(text_of, found) == roots_of(text_of, want)
    blocks = -(-len(text_of) // size)
    assert len(found) < len(text_of) * blocks * blocks and len(found) < len(want)


def test_large_group_of_near_copies(spark):
    """One group far longer than a short list: right classes, no row for each pair, one table left behind."""
    texts = near_copies(np.random.default_rng(10), 1, 150, edits=7) + near_copies(np.random.default_rng(11), 20, 4)
    df, text_of = set_rows(spark, texts)
    before = len(common._SAVED)
    got = {r.mark: r.root for r in simhash.alike_sets(df).collect()}
    assert len(common._SAVED) == before + 1
    want = roots_of(text_of, linked(text_of))
    groups = lambda roots: {frozenset(m for m in roots if roots[m] == r) for r in set(roots.values())}
    assert groups(got) == groups(want)
    rows = simhash.alike_classes(df).collect()
    assert len(rows) == len(texts) and {(r.mark, r.root) for r in rows} == set(got.items())


def test_similar_sets_link_whatever_their_bits(spark):
    """Eight words and one more have four of five shingles in common, but some fingerprints are over 16 bits apart; in short lists and in a crowd."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(80):
        words = [f"w{x}" for x in rng.integers(0, 10**7, 9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    hub = [f"h{x}" for x in range(8)]  # like each of the next texts, which are not like one another: a list of 81
    crowd = [" ".join(hub)] + [" ".join([*hub, f"x{x}"]) for x in rng.integers(0, 10**7, 80)]
    assert any((fingerprint(crowd[0]) ^ fingerprint(t)).bit_count() > 16 for t in crowd)
    texts += crowd
    df, text_of = set_rows(spark, texts)
    every = linked(text_of, max_bits=64)
    assert len(every) > len(linked(text_of))  # there are pairs that a bound of 16 bits leaves out
    got = {r.mark: r.root for r in simhash.alike_sets(df).collect()}
    groups = lambda roots: {frozenset(m for m in roots if roots[m] == r) for r in set(roots.values())}
    assert groups(got) == groups(roots_of(text_of, every)) != groups(roots_of(text_of, linked(text_of)))
