"""Chat formatting, line dedup, passage dedup, BPE, MinHash and packing against plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import brute
from textgrade.llm import bpe, chat, linededup, minhash, order, packing, sharding, suffixdedup

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "x", "é" * 60, "<|endoftext|> a", "a\\b<|end|>", "word " * 30_000]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# chat formatting


def test_chat_reads_back_what_was_put_in(spark):
    turns = [
        (1, 1, "user", "a\\<|end|>b"), (1, 2, "user", "<|next|>"), (1, 3, "assistant", "</s>[INST]\n\\"), (1, 3, "assistant", None),
        (2, None, None, None), (2, 5, "assistant", ""), (None, 0, "assistant", "héé"), (None, 0, "assistant", "héé"),
        (3, 0, "sys<|message|>tem", "<<|"), (4, 0, "assistant", "y" * 50_000), (4, 1, "assistant", "\\|"),
    ]
    df = table(spark, turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.format_chat(df)
    read = {r.conv_id: [tuple(x) for x in r.t] for r in got.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert read[conv] == [(r, x) for _, _, r, x in mine]
    sums = {r.conv_id: r for r in chat.digests(got).collect()}
    assert sums[1].loss_chars == len("</s>[INST]\n\\") and sums[2].loss_chars == 0
    assert sums[None].loss_sha256 == hashlib.sha256("héé".encode() * 2).hexdigest()
    text = {r.conv_id: r.formatted for r in got.collect()}[1]
    assert text.count(chat.START) == 2 and text.count(chat.NEXT) == 2 and "</s>" not in text and "[INST]" not in text
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0


# line dedup


@pytest.mark.parametrize("run", [1, 2, 3])
def test_repeated_lines(spark, run):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "dd", "", " \t"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "only"), (103, "same\nsame\nsame\nsame\nsame"), (104, "long line " * 20_000 + "\nq\nr")]
    df = table(spark, rows).withColumns({"at": F.lit(1), "n_lines": F.lit("clash"), "__x": F.lit(None).cast("int")})
    got = {r.doc_id: r for r in linededup.dedup_lines(df, run=run).collect()}
    for doc_id, kept, n in brute.repeated_lines(rows, run):
        assert (got[doc_id].text or "", got[doc_id].n_removed) == (kept, n), doc_id
    assert got[100].text is None and got[0].at == 1


def test_repeated_lines_of_odd_rows(spark):
    df = table(spark, [(7, "a\nb"), (7, "a\nb"), (None, "a\nb"), (9, "a\nb\nz"), (7, "b\nz")])
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "a\nb", 0), (7, "", 2), (7, "", 2), (7, "b\nz", 0), (9, "", 3)], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# passage dedup


def passages():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a, n = rng.randint(0, 60), rng.randint(30, 100)
            parts += [s[a : a + n], " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "be " * 100), (201, "x" + "be " * 60), (202, "ab" * 40), (203, None), (204, ""), (205, "s" * 49), (206, "s" * 49)]
    return rows + [(300, rows[3][1]), (301, rows[3][1]), (301, rows[3][1]), (302, "z" * 200_000), (303, "z" * 51)]


@pytest.mark.parametrize("cell_bytes", [300, 1 << 22])
def test_repeated_passages(spark, cell_bytes):
    rows = passages()
    df = table(spark, rows).withColumns({"cell": F.lit(3), "kept": F.lit("clash"), "gram": F.lit(None).cast("string")})
    got = suffixdedup.dedup_passages(df, cell_bytes=cell_bytes).collect()
    want = []
    for (i, text), gone in zip(rows, brute.repeated_bytes(rows)):
        data = (text or "").encode()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone) if not g)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert got[0].cell == 3


def test_passages_across_pieces_of_a_long_text(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 5_000)))
    rows = [(1, text), (2, text[:2_000] + "!" + text[2_000:]), (3, text[4_951:] + "?" + text[100:149])]
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    ends = np.cumsum([len(t) for _, t in rows])
    whole = suffixdedup.Anchors(data, ends, 50)
    monkeypatch.setattr(suffixdedup, "AT_ONCE", 512)
    pieces = suffixdedup.Anchors(data, ends, 50)
    assert whole.place.tolist() == pieces.place.tolist() and whole.context.tolist() == pieces.context.tolist()


def test_passages_of_odd_tables(spark):
    df = table(spark, [(None, "p" * 60), (1, "p" * 60), (None, "p" * 60)])
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixdedup.dedup_passages(df).collect())
    assert got == [("1", 60), ("None", 0), ("None", 0)]
    assert suffixdedup.dedup_passages(df.limit(0)).count() == 0


# byte-level BPE


def test_bpe_is_the_public_one(spark):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "\xa0", "1", "٣", "é", "ß", "中", "!", "'s", "　", "é", "😀", "\r\n", "X", "_", "​", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [t for t in ODD if t] + ["a" * 5000, " " * 700, "!" * 900, "\n", "x \n", "'", "'l", "'r"]
    coder = bpe.encoder(RANKS)
    ids = coder.encode(texts)
    assert [i.tolist() for i in ids] == [public.encode_ordinary(t) for t in texts]
    assert [coder.decode(i) for i in ids] == [t.encode() for t in texts]
    assert all(coder.offsets(i)[-1] == len(t.encode()) for i, t in zip(ids, texts))


def test_bpe_tables(spark):
    df = table(spark, [*enumerate(ODD), (None, "again"), (1, "again")]).withColumn("ids", F.lit("clash"))
    encoded = bpe.encode_documents(df, RANKS)
    back = sorted((str(r.doc_id), bytes(r.data).decode()) for r in bpe.decode_documents(encoded, RANKS).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in df.collect())
    sums = {r.doc_id: r for r in bpe.digests(df, RANKS).collect()}
    for r in encoded.filter("doc_id > 1").collect():
        assert sums[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert sums[r.doc_id].decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest() and len(r.offsets) == len(r.ids)
    assert bpe.digests(df.limit(0), RANKS).count() == 0


# MinHash


def jaccard(a, b, width=5):
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("cell_bytes", [200, 1 << 24])
def test_fingerprints_and_edits(spark, cell_bytes):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("xyzé") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    rows = list(zip(range(0, 400, 10), texts)) + [(5, None), (7, ""), (9, "Ab C"), (11, "w " * 300_000), (405, texts[-1])]
    docs = table(spark, rows)
    found = minhash.fingerprints_and_edits(docs.withColumn("cell", F.lit(1))) if cell_bytes > 200 else None
    if found is None:  # many cells
        got_order = order.in_order(docs, "doc_id", "text", cell_bytes)
        assert got_order.filter("NOT extra").count() == len(rows) and got_order.filter("extra").count() > 5
        return
    got = {r.doc_id: r for r in found.collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for (i, text), (_, follows) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert abs(got[i].near_edited - jaccard(text, edited)) < 0.2 and abs(got[i].near_next - jaccard(text, follows)) < 0.2
    assert got[390].fingerprint == got[405].fingerprint and len(got[0].fingerprint) == 8 * minhash.PERMS
    assert minhash.fingerprints_and_edits(docs.limit(0)).count() == 0


def test_words_do_not_depend_on_pieces():
    data = b" ".join(b"w%d" % (i % 977) for i in range(400_000))
    assert minhash.word_hashes(data)[:977].tolist() == minhash.word_hashes(data)[977 * 300 : 977 * 301].tolist()
    assert len(minhash.word_hashes(b"x" * (3 << 20))) == 1


# packing


def test_tokens_are_those_of_the_library():
    tokens = packing.Tokens(WORDS)
    rng = random.Random(2)
    signs = ["'", "s", "t", "LL", "ve", " ", "\n", "\xa0", "1", "²", "é", "ß", "中", "!", "é", "😀", "Y", "<|endoftext|>", "_", "\x1c", "\x85", "İ", "Σ", "µ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(2000)] + [t for t in ODD if t]
    want = [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in tokens.encode(texts)] == want


def test_plain_words_go_to_the_model_alone():
    """Without the library's normalising of each text; every code point below U+0250 in and beside words."""
    tokens = packing.Tokens(WORDS)
    texts = [f"a{c}b {c} x1{c}, {c}'ll {c}{c}" for c in map(chr, range(0x250)) if c not in "\x1c\x1d\x1e\x1f"]
    want = [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]
    tokens.library = None
    assert [i.tolist() for t in texts for i in tokens.encode([t])] == want and [i.tolist() for i in tokens.encode(texts)] == want


def test_packing_workers_hold_little():
    """Few characters are encoded at once, and a chunk that is one word stands in one cache only."""
    asked = []

    class Counting:
        def encode(self, texts):
            asked.append(sum(map(len, texts)))
            return [np.zeros(0, np.uint32) for _ in texts]

    assert len(list(packing._encoded(Counting(), ["word " * 200] * 1000))) == 1000
    assert max(asked) <= (1 << 18) + 1000
    tokens = packing.Tokens(WORDS)
    texts = ["one two, three", "two (three) three", "", "it's one-two ... one", "two,"]
    for _ in range(2):
        assert [x.tolist() for x in tokens.encode(texts)] == [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert "one" in tokens.chunks.place and "it's" in tokens.chunks.place
    assert "it" in tokens.words.place and "three" in tokens.words.place and len(tokens.words.place) < 10
    plain = packing.Tokens(WORDS)
    plain.encode(["only plain words here"])
    assert len(plain.chunks.place) == 4 and not plain.words.place


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "cat", "x!"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(400, None), (None, "a"), (401, "same"), (401, "same"), (402, "long " * 1000)]
    df = table(spark, rows).withColumn("length", F.lit("clash"))
    got = packing.pack(packing.pieces(df, WORDS, capacity=128), capacity=128).collect()
    tokens = packing.Tokens(WORDS)
    want = []
    for i, text in rows:
        ids = np.append(tokens.library.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        want += [(str(i), k, at, len(ids[at : at + 128]), zlib.crc32(ids[at : at + 128].tobytes())) for k, at in enumerate(range(0, len(ids), 128))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in got) // 128) + 1
    assert packing.pack(packing.pieces(df.limit(0), WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_sweep_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.choice([1, 5, 60]))}
    matches = packing.sweep(counts, 100)
    ranks = {n: sorted((r, r + c) for length, r, c, _, _ in matches if length == n) for n in counts}
    for n, spans in ranks.items():
        assert spans[0][0] == 0 and spans[-1][1] == counts[n] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    used = {}
    for length, _, count, sequence, offset in matches:
        for s in range(sequence, sequence + count):
            used.setdefault(s, []).append((offset, length))
    for parts in used.values():
        ends = [0, *[o + n for o, n in sorted(parts)]]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100


# sharding


def test_shards_are_even_and_whole(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["en", "de", None]), f"s{i % 7}", i) for i in range(400)]
    rows += [(1000 + i, "copy" * 30, "en", "s1", None) for i in range(300)] + [(None, None, None, None, None), (5, "again", "en", "s", 5), (5, "again", "en", "s", 5)]
    df = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"shard": F.lit("clash"), "size": F.lit(0)})
    for n in (1, 5, 8):
        got = sharding.kd_shards(df, sharding.default_dimensions(), shards=n).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        weights = [0] * n
        slots = [[] for _ in range(n)]
        for r in got:
            weights[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert max(weights) - min(weights) < 0.1 * sum(weights) / n + 300
        assert all(sorted(s) == list(range(len(s))) for s in slots)
    by_target = sharding.kd_shards(df, sharding.default_dimensions(), target_bytes=20_000).agg(F.countDistinct("shard")).first()[0]
    assert by_target == -(-sum(len((t or "").encode()) + 1 for _, t, *_ in rows) // 20_000)
    assert sharding.kd_shards(df.limit(0), sharding.default_dimensions(), shards=8).count() == 0


def test_tokens_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 40)
    monkeypatch.setattr(packing, "NAMES", 30)
    tokens = packing.Tokens(WORDS)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcde!") for _ in range(rng.randint(1, 4))) for _ in range(60)) for _ in range(50)]
    want = [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in tokens.encode(texts)] == want and [tokens.encode([t])[0].tolist() for t in texts] == want


def test_classes_by_bands_and_jaccard(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, " "), (202, rows[4][1]), (202, rows[4][1]), (None, rows[5][1]), (203, "a b")]
    got = minhash.near_duplicates(table(spark, rows).withColumn("key", F.lit("clash"))).collect()
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if jaccard(a or "", rows[j][1] or "") >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), 10**9), doc_id)
    want = sorted(((doc_id, least.get(find(i))) for i, (doc_id, _) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert len({c for _, c in want}) < len(rows) / 2
    assert minhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_repeated_rows_of_one_id_are_dealt_out(spark):
    for ident in (7, None):
        df = table(spark, [(ident, "fourteen bytes", "en", "s", 14)] * 800, "doc_id long, text string, lang string, source string, n_chars long")
        sizes = [r.n for r in sharding.kd_shards(df, sharding.default_dimensions(), shards=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
        assert len(sizes) == 8 and sum(sizes) == 12_000 and max(sizes) - min(sizes) < 600


def plain_kd(points, shards, first=0):
    """Shard of every ``(id, size, coordinates)``: sorted along the widest side, cut where the weight comes nearest."""
    if shards == 1 or not points:
        return {p[0]: first for p in points}
    axis = max(range(len(points[0][2])), key=lambda a: (max(p[2][a] for p in points) - min(p[2][a] for p in points), a))
    points = sorted(points, key=lambda p: p[2][axis])
    want = sum(p[1] for p in points) * (shards // 2) / shards
    below = at = 0
    while at < len(points) and below + points[at][1] < want:
        below += points[at][1]
        at += 1
    if at < len(points) and want - below >= below + points[at][1] - want:
        at += 1
    return plain_kd(points[:at], shards // 2, first) | plain_kd(points[at:], shards - shards // 2, first + shards // 2)


def test_shards_equal_a_plain_kd_tree(spark, monkeypatch):
    rng = random.Random(5)
    xs, ys = rng.sample(range(100_000), 600), rng.sample(range(90_000), 600)
    rows = [(i, f"{i} " + "x" * rng.randrange(60), x, y) for i, (x, y) in enumerate(zip(xs, ys))]
    df = table(spark, rows, "doc_id long, text string, a long, b long")
    cell = lambda v, vs: int((v - min(vs)) / (max(vs) - min(vs)) * ((1 << sharding.GRID) - 1))
    points = [(i, len(t) + 1, (cell(x, xs), cell(y, ys))) for i, t, x, y in rows]
    dims = {"a": F.col("a").cast("double"), "b": F.col("b").cast("double")}
    for shards, most in ((7, sharding.BROADCAST_ROWS), (16, 0)):  # the second way joins heavy groups in salted pieces
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", most)
        got = {r.doc_id: r.shard for r in sharding.kd_shards(df, dims, shards=shards).collect()}
        assert got == plain_kd(points, shards)
