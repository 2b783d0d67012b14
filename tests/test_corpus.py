"""Sources, sinks, ingest, language filter, numbering, groups and folds on small fixtures."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgrade.functions import names
from textgrade.functions.text import split_lines
from textgrade.operators import annotate, features, frequency, groups, ingest, langid, profile, ranking, sampling
from textgrade.sources import conllu, named_files, sinks, tables
from textgrade.sources.text import read_documents


def test_text_files_and_chapters(spark, tmp_path):
    (tmp_path / "a1-a2_one.txt").write_text("a b\x0cc­d\x0c", encoding="utf8")
    (tmp_path / "b1_two.txt").write_text("x", encoding="utf8")
    (tmp_path / "other.md").write_text("no", encoding="utf8")
    files = read_documents(spark, str(tmp_path))
    assert files.count() == 2 and read_documents(spark, str(tmp_path), "b1*.txt").count() == 1
    got = {r["name"]: r["text"] for r in ingest.chapter_corpus(files).collect()}
    assert sorted(got.values()) == ["", "a b", "cd", "x"]
    ids = sorted(int(n.split("_")[0]) for n in got)
    assert ids == [1, 2, 3, 4]
    one = sorted(n for n in got if "_one_" in n)
    assert [n.split("_", 1)[1] for n in one] == [f"Edika_a1-a2_one_00{i}.txt" for i in (1, 2, 3)]
    first = int(one[0].split("_")[0])
    assert [int(n.split("_")[0]) for n in one] == [first, first + 1, first + 2]


def test_csv_sources(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w", encoding="utf8") as f:
        f.write('label,name,text\n0,a,"line one\nsays ""hi"""\n1,b,_\n1,NA,NA\n')
    rows = tables.read_csv(spark, path, tables.CORPUS_SCHEMA, multi_line=True).collect()
    assert [r["text"] for r in rows] == ['line one\nsays "hi"', None, "NA"] and rows[2]["name"] == "NA"
    assert tables.read_labelled(spark, path, (0, 1)).count() == 3
    with pytest.raises(Exception, match="undeclared label 1"):
        tables.read_labelled(spark, path, (0,)).select("label").collect()


def test_feature_file_round_trip(spark, tmp_path):
    columns = ["name", *features.FEATURE_NAMES, "group", "label"]
    values = ["n", *[float(i) for i in range(len(features.FEATURE_NAMES))], 3, 1]
    values[columns.index("non_sentence_end_punct")] = None
    types = ["string"] + ["double"] * len(features.FEATURE_NAMES) + ["int", "int"]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"`{c}` {t}" for c, t in zip(columns, types)))
    out = str(tmp_path / "feats")
    sinks.write_csv(features.csv_layout(df), out)
    header = next(open(os.path.join(out, n)).readline() for n in os.listdir(out) if n.startswith("part"))
    assert header.startswith("name,words/sent,mean_chars/wd") and header.strip().endswith("group,label")
    back = tables.read_features(spark, out).first()
    assert back["non_sentence_end_punct"] is None and back["max_dep_length_intj"] == float(len(features.FEATURE_NAMES) - 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "l1\nl2"), ("b", "x")], "name string, text string")
    sinks.write_documents(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    lines = [l for n in os.listdir(tmp_path / "j") if n.startswith("part") for l in open(tmp_path / "j" / n)]
    assert sorted(json.loads(l)["name"] for l in lines) == ["a", "b"]


def test_one_file_per_name(spark, tmp_path):
    texts = {"a.txt": "l1\r\nl2\n", "b.txt": " é ", "c d.txt": "", "e.txt": None}
    df = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(3)
    out = str(tmp_path / "t")
    sinks.write_text_per_name(df, out)
    assert {n: open(os.path.join(out, n), newline="", encoding="utf8").read() for n in os.listdir(out)} == {n: t or "" for n, t in texts.items()}
    assert {r["file_name"]: r["text"] for r in read_documents(spark, out).collect()} == {n: t for n, t in texts.items() if t}
    with pytest.raises(Exception, match="not empty"):
        sinks.write_text_per_name(df, out)
    for bad in ("x/y.txt", "_hidden", None, ".", ""):
        with pytest.raises(ValueError, match="file names"):
            sinks.write_text_per_name(spark.createDataFrame([(bad, "t")], "name string, text string"), str(tmp_path / "u"))
    with pytest.raises(ValueError, match="repeat"):
        sinks.write_text_per_name(df.union(df.where("name = 'a.txt'")), str(tmp_path / "u"))
    failing = df.withColumn("text", F.when(F.col("name") == "e.txt", F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        sinks.write_text_per_name(failing, str(tmp_path / "v"))
    assert not os.path.exists(tmp_path / "v") or os.listdir(tmp_path / "v") == []  # nothing is left of a failed job
    sinks.write_text_per_name(df.limit(0), str(tmp_path / "w"))
    assert os.listdir(tmp_path / "w") == []


def test_an_attempt_written_again_leaves_one_whole_file(tmp_path):
    import pyarrow as pa

    writer = named_files.NamedTextWriter(f"file:{tmp_path}")
    batch = pa.RecordBatch.from_pydict({"name": ["a.txt", "b.txt"], "text": ["first", "x"]})
    (tmp_path / writer.staging).mkdir()
    (tmp_path / writer.staging / "lost").write_text("fir")  # of an executor that went away
    messages = [writer.write(iter([batch])) for _ in range(2)]
    writer.commit(messages[1:])
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt"] and (tmp_path / "a.txt").read_text() == "first"


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = named_files.NamedTextFiles({"path": f"file:{tmp_path}/x"}).writer(None, False)
    batch = pa.RecordBatch.from_pydict({"name": ["a.txt", "b.txt"], "text": ["first", "x"]})
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([batch]))
    assert os.listdir(tmp_path / "x") == []


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no list of many files, and the rows are those of Spark's reader."""
    from textgrade.sources import text as source

    monkeypatch.setattr(source, "FEW_FILES", 10)
    texts = {f"{i:03d}_é {i}.txt": f"text {i}\r\n" for i in range(60)} | {"_hidden.txt": "x", ".dot.txt": "x", "none.txt": "", "a.csv": "x", "000.txt": "y", "%41.txt": "z", "a;b[1]#?+.txt": "v", "n\xa0b\u2003s.txt": "w"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("x")
    for folder, glob in ((str(tmp_path), "*.txt"), (f"file:{tmp_path}/", "0*_*.txt"), (str(tmp_path), "00?.txt"), (str(tmp_path), "nothing.txt")):
        got = read_documents(spark, folder, glob)
        assert got.inputFiles() == []
        plain = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).where("length > 0")
        want = {(r.name, r.text) for r in plain.selectExpr("_metadata.file_name AS name", "cast(content AS string) AS text").collect()}
        assert {(r["file_name"], r["text"]) for r in got.collect()} == want and got.count() == len(want)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_documents(spark, str(tmp_path / "missing"))


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    rows = [(0, "a", ' x "y" '), (1, "b", "l1\nl2, \\"), (2, "c", "NA"), (0, "d", "")]
    sinks.write_csv(spark.createDataFrame(rows, "label int, name string, text string"), str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), tables.CORPUS_SCHEMA, multi_line=True)
    assert sorted((r["label"], r["name"], r["text"]) for r in back.collect()) == sorted(rows)


def test_frequency_file(spark, tmp_path):
    path = str(tmp_path / "d.tsv")
    rows = ["\ta\t9\t1\t1\t1\t1\tx", "1\t\"\t8\t1\t1\t1\t1\tx", "\tnull\t7\t1\t1\t1\t1\tx", "2\tb\t6\t1\t1\t1\t1\tx", "\ta\t5\t1\t1\t1\t1\tx"]
    open(path, "w", encoding="utf8").write("\n".join(rows) + "\n")
    df = tables.read_frequencies(spark, path)
    assert [r["form"] for r in df.orderBy("row").collect()] == ["a", '"', "null", "b", "a"]
    filled = frequency.filled_ranks(df, ["row"], F.col("split"))
    assert [r["rank"] for r in filled.orderBy("row").collect()] == [0, 1, 1, 2, 2]
    unique = frequency.last_wins(filled.select("form", "freq", "rank", "row"), "form", ["row"])
    assert {r["form"]: r["freq"] for r in unique.collect()}["a"] == 5


def test_rankings(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    open(path, "w").write("feat,LDA,RF\nx,2,1\ny,1,2\n")
    got = {(r["model"], r["feat"]): r["rank"] for r in tables.read_rankings(spark, path, ["LDA", "RF"]).collect()}
    assert got == {("LDA", "x"): 2, ("LDA", "y"): 1, ("RF", "x"): 1, ("RF", "y"): 2}


def test_conllu_file(spark, tmp_path):
    block = "# doc_id = 7\n# sent_id = 0\n1-2\tzum\t_\t_\t_\t_\t_\t_\t_\t_\n1\tJá\tjá\tPRON\t_\tPerson=1|PronType=Prs\t2\t_\t_\t_\n2\t.\t.\tPUNCT\t_\t_\t0\t_\t_\t_"
    (tmp_path / "x.conllu").write_text(block + "\n\n" + block.replace("sent_id = 0", "sent_id = 1") + "\n\n", encoding="utf8")
    rows = conllu.read_conllu(spark, str(tmp_path / "x.conllu")).orderBy("sent_id", "word_id").collect()
    assert [(r["doc_id"], r["sent_id"], r["word_id"], r["head"]) for r in rows] == [(7, 0, 1, 2), (7, 0, 2, 0), (7, 1, 1, 2), (7, 1, 2, 0)]
    assert rows[0]["feats"] == {"Person": "1", "PronType": "Prs"} and rows[1]["feats"] is None


def test_names(spark):
    given = ["0007_Edika_a1-a2_title_003.txt", "00012_x.txt", "abc_x", "story-b1.txt", "a1.txt"]
    df = spark.createDataFrame([(n,) for n in given], "name string")
    n = F.col("name")
    rows = {
        r["name"]: r
        for r in df.select(
            "name", names.title(n).alias("t"), names.bare_title(n).alias("b"), names.class_of(n).alias("c"),
            names.trailing_level(n).alias("lv"), names.leading_title(n).alias("lt"),
        ).collect()
    }
    assert [rows[g]["t"] for g in given[:3]] == ["a1-a2_title", "CTDC", None]
    assert rows[given[0]]["b"] == "title" and [rows[g]["c"] for g in given] == [0, None, None, 1, 0]
    assert (rows["story-b1.txt"]["lv"], rows["story-b1.txt"]["lt"]) == ("b1", "story")
    assert (rows["a1.txt"]["lv"], rows["a1.txt"]["lt"]) == ("a1", "a1.tx")
    with pytest.raises(Exception, match="name of neither corpus"):
        df.select(names.bare_title(n, strict=True)).collect()
    assert spark.range(1).select(names.padded(F.lit(12345), 4).alias("p"), names.padded(F.lit(7), 3).alias("q")).first() == ("12345", "007")


def test_language_filter(spark):
    train = spark.createDataFrame(
        [("cs", "příliš žluťoučký kůň úpěl ďábelské ódy a pak šel domů spát " * 3), ("en", "the quick brown fox jumps over the lazy dog and then it goes home " * 3)],
        "lang string, text string",
    )
    docs = spark.createDataFrame(
        [(1, "žluťoučký kůň\nthe lazy dog\n\n8282\núpěl ódy")], "doc_id long, text string"
    )
    profiles = langid.language_profiles(train)
    kept = langid.keep_language(docs, profiles, ("cs", "en"), "cs", "doc_id", split_lines(F.col("text"))).collect()
    assert [r["text"] for r in kept] == ["žluťoučký kůň\núpěl ódy"]


@pytest.mark.parametrize("hot", [False, True])
def test_numbering_matches_a_plain_sort(spark, hot):
    random.seed(3)
    rows = [(i, "a" if hot and i % 3 else random.choice("abc"), random.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, part string, w int").repartition(7)
    import hashlib

    key = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    got = ranking.number_rows(df, ranking.seeded_key("id"), partition_by=["part"], tie=["id"], total="n").collect()
    for part in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == part), key=key)
        assert {r["id"]: r["position"] for r in got if r["part"] == part} == {i: n + 1 for n, i in enumerate(ids)}
        assert {r["n"] for r in got if r["part"] == part} == {len(ids)}
    summed = ranking.number_rows(df, ranking.seeded_key("id"), tie=["id"], weight=F.col("w"))
    before, want = 0, {}
    for i in sorted((r[0] for r in rows), key=key):
        want[i] = before
        before += rows[i][2]
    assert {r["id"]: r["position"] for r in summed.collect()} == want


def test_count_rank_and_forward_fill(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 3, 5, 1, 3, 3])], "id long, v long")
    assert [r["rank"] for r in ranking.count_rank(df, "v").orderBy("id").collect()] == [1, 3, 1, 6, 3, 3]
    random.seed(5)
    rows = [(i, i % 2, None if random.random() < 0.7 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, user int, v double").repartition(5)
    got = ranking.forward_fill(df, "v", ["i"], F.floor(F.col("i") / 16), ["user"], start=0.0)
    last = {0: 0.0, 1: 0.0}
    want = {}
    for i, user, v in rows:
        last[user] = v if v is not None else last[user]
        want[i] = last[user]
    assert {r["i"]: r["v"] for r in got.collect()} == want


def test_folds_are_ragged_and_checked(spark):
    pairs = [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]
    df = spark.createDataFrame([(l, g, f"{g}-{i}") for l, g in pairs for i in range(g + 1)], "label int, group int, name string")
    folds = groups.create_folds(df)
    got = {r["fold"]: (r["group_0"], r["group_1"], r["group_2"]) for r in groups.fold_tuples(folds).collect()}
    assert got == {0: (0, 3, 5), 1: (1, 4, None), 2: (2, None, None)}
    groups.validate_folds(df)
    bad = df.unionByName(spark.createDataFrame([(1, 0, "x")], df.schema))
    with pytest.raises(ValueError, match="more than one label: 0"):
        groups.validate_folds(bad)
    merged = groups.create_folds(df, n_folds=2)
    assert {r["fold"] for r in merged.collect()} == {0, 1}


def test_roles_do_not_overlap(spark):
    pairs = [(l, 10 * l + g) for l in range(3) for g in range(4 - l)]
    df = spark.createDataFrame([(l, g, f"{g}-{i}") for l, g in pairs for i in range(5)], "label int, group int, name string")
    folds = groups.create_folds(df)
    seen = []
    for fold in (1, 2, 3):
        rows = groups.train_validation_split(df, folds, fold).collect()
        val = {r["name"] for r in rows if r["role"] == "val"}
        train = {r["name"] for r in rows if r["role"] == "train"}
        test = {r["name"] for r in groups.with_fold(df, folds).where("fold = 0").collect()}
        assert not val & train and not test & (val | train)
        three = groups.three_way_split(df, folds, fold).collect()
        assert {r["name"] for r in three if r["role"] == "train"} == train and len(three) == df.count()
        seen += sorted(val)
    assert len(seen) == len(set(seen)) == df.count() - len(test)


def test_stratified_group_folds_are_even(spark):
    df = spark.createDataFrame([(g % 3, g) for g in range(42) for _ in range(10 + g % 3)], "label int, group int")
    rows = groups.stratified_group_folds(df, 7).collect()
    per = {}
    for r in rows:
        per.setdefault(r["fold"], []).append(r["main"])
    assert sorted(per) == list(range(7)) and all(sorted(v) == [0, 0, 1, 1, 2, 2] for v in per.values())


def plain_folds(mixes, k):
    """Fold of every ``(group, class counts)``, one group after the other, spreads by numpy over all folds."""
    import numpy as np

    order = sorted(mixes, key=lambda m: (sum(m[1]) ** 2 - len(m[1]) * sum(n * n for n in m[1]), m[1], m[0]))
    total = np.sum([m for _, m in mixes], axis=0)
    state, out = np.zeros((k, len(total))), {}
    for group, mix in order:
        def left(fold):
            trial = state.copy()
            trial[fold] += mix
            return round(float((trial.std(axis=0) * total.sum() / np.maximum(total, 1)).sum()), groups.DIGITS), state[fold].sum(), fold

        out[group] = min(map(left, range(k)), key=lambda t: t)[2]
        state[out[group]] += mix
    return out


def test_stratified_group_folds_equal_the_plain_greedy_way(spark):
    rng = random.Random(3)
    cases = [
        ([[0] * c + [rng.choice((1, 2, 2, 5))] + [0] * (2 - c) for c in rng.choices((0, 1, 2), (6, 3, 1), k=400)], 7),  # one label a group
        ([[rng.randrange(4), rng.randrange(9), 1] for _ in range(150)], 5),
        ([[40, 0], [1, 0], [1, 0], [0, 3]] + [[1, 0]] * 60, 3),  # the cycle begins only when the folds are level
        ([[2, 2]] * 2, 4),  # fewer groups than folds
    ]
    for vectors, k in cases:
        mixes = [(g, v) for g, v in enumerate(vectors)]
        rows = [(label, g) for g, v in mixes for label, n in enumerate(v) for _ in range(n)]
        df = spark.createDataFrame(rows, "label int, group int").repartition(5)
        got = {r["group"]: r["fold"] for r in groups.stratified_group_folds(df, k).collect()}
        assert got == plain_folds(mixes, k)
    assert groups.stratified_group_folds(df.limit(0), 3).count() == 0


def test_kinds_are_dealt_without_walking_over_every_group():
    first, cycle = groups.deal_kinds([([3, 0], 10**12), ([0, 1], 5)], 4)[0]
    assert len(first) == 4 and sorted(cycle) == [0, 1, 2, 3]


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1003).withColumn("label", F.when(F.col("id") < 800, 0).otherwise(1))
    parts = sampling.train_test_split(df, "id")
    assert parts.where("part = 'test'").count() == 201
    again = sampling.train_test_split(df.repartition(13), "id")
    assert parts.exceptAll(again).count() == 0
    strat = {(r["label"], r["part"]): r["count"] for r in sampling.stratified_split(df, "id", "label").groupBy("label", "part").count().collect()}
    assert strat[(0, "test")] + strat[(1, "test")] == 201 and strat[(0, "test")] == 160
    sizes = [r["count"] for r in sampling.k_folds(df, "id").groupBy("fold").count().collect()]
    assert sorted(sizes) == [100] * 7 + [101] * 3


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 3, 30_000), np.full(15_000, 7.0), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v), 1.0) for v in values], "a double, b double").repartition(11)
    got = {(r["column"], r["p"]): r["value"] for r in profile.exact_quantiles(df, ["a", "b"]).collect()}
    for p in profile.QUARTILES:
        assert got[("a", p)] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert got[("b", p)] == 1.0
    hist = profile.histograms(df, ["b"]).collect()
    assert sum(r["n"] for r in hist) == len(values) and len(hist) == 10


def test_quantiles_of_odd_columns(spark):
    import numpy as np

    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(4)
    columns = {
        "far": np.concatenate([rng.normal(0, 1, 995), [1e300, -1e300, 1e-300, 1.7e308, -1.7e308]]),
        "near_high": np.concatenate([-np.exp(rng.uniform(-600, 0, 998)), [-1e200, 0.0]]),
        "tiny": rng.integers(0, 3, 1000) * 5e-324,
        "constant": np.full(1000, -2.5),
        "open": np.concatenate([np.full(400, -inf), rng.normal(0, 1, 500), np.full(100, inf)]),
    }
    rows = [tuple(float(v[i]) for v in columns.values()) + (nan if i % 2 else None, nan if i % 3 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "none", "gaps"])).repartition(7)
    wanted = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {(r["column"], r["p"]): r["value"] for r in profile.exact_quantiles(df, df.columns, wanted).collect()}
    columns["gaps"] = np.arange(0, 1000, 3).astype(float)
    assert {c for c, _ in got} == set(columns)
    for c, values in columns.items():
        values = np.sort(values)
        for p in wanted:
            place = p * (len(values) - 1)
            a, b = values[int(np.floor(place))], values[int(np.ceil(place))]
            assert got[c, p] == (a if a == b else a + (b - a) * (place - np.floor(place))), (c, p)
    assert profile.exact_quantiles(df.limit(0), ["far"]).count() == 0


def test_selection_needs_few_passes_and_no_window(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") < 5, F.lit(1e250)).otherwise(F.sqrt("id")).alias("a"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("b")
    )
    long = profile._long(df, ["a", "b"])
    extent = {r["column"]: {**r.asDict(), "lowest": 0, "finite": 200_000} for r in long.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    found, passes = profile.select_ranks(long, {"a": [100_000], "b": [0, 199_999]}, extent)
    assert found == {("a", 100_000): 100_005**0.5, ("b", 0): 0.0, ("b", 199_999): 96.0} and passes <= 6
    plan = profile.describe(df, ["a", "b"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_capped_union(spark):
    books = spark.createDataFrame([("0001_P_a1_t_001.txt", "x"), ("0002_P_c2_t_001.txt", "y"), ("0003_P_b1_t_001.txt", "z")], "name string, text string")
    third = spark.createDataFrame([(f"{i:05d}_c.txt", "t") for i in range(9)], "name string, text string")
    rows = ingest.labelled_corpus(books, third, cap=4).collect()
    assert sorted((r["label"], r["name"]) for r in rows) == [(0, "0001_P_a1_t_001.txt"), (1, "0003_P_b1_t_001.txt")] + [(2, f"{i:05d}_c.txt") for i in range(4)]


def test_spread_takes_the_given_number(spark):
    assert tables.spread(spark.range(100), "id", 5).rdd.getNumPartitions() == 5
    assert isinstance(annotate.TOKEN_SCHEMA, T.StructType)


@pytest.mark.parametrize("number", [9_999, 10_000, 99_999, 100_000, 1_000_000])
def test_the_kind_of_a_name_does_not_depend_on_the_width_of_its_id(spark, number):
    book, third = f"{number:04d}_Edika_b1_title_001.txt", f"{number:05d}_ctdc.txt"
    df = spark.createDataFrame([(book,), (third,), (None,), ("abc_x",)], "name string")
    got = {r["name"]: (r["t"], r["b"]) for r in df.select("name", names.title(F.col("name")).alias("t"), names.bare_title(F.col("name")).alias("b")).collect()}
    assert got == {book: ("b1_title", "title"), third: ("CTDC", "CTDC"), None: (None, None), "abc_x": (None, None)}


def test_more_titles_than_reserved_numbers(spark):
    books = [(f"{i:04d}_P_a1_t{i % 40}_001.txt", 0) for i in range(200)]
    df = spark.createDataFrame(books + [(f"{i:05d}_ctdc.txt", 2) for i in range(100)], "name string, label int")
    rows = groups.with_groups(df).collect()
    groups.validate_folds(groups.with_groups(df))
    assert {r["group"] for r in rows if r["label"] == 0} == set(range(40)) and {r["group"] for r in rows if r["label"] == 2} == set(range(40, 50))
    assert len(rows) == 300


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "id long, label string")
    assert sampling.k_folds(df, "id").count() == 3 and sampling.train_test_split(df, "id").count() == 3
    assert sampling.shuffled(df, "id").count() == 3 and sampling.stratified_split(df, "id", "label").count() == 3
    events = spark.createDataFrame([(None, 1, None), (None, 2, 5.0), (7, None, 1.0), (7, 3, None)], "user long, ts long, value double")
    from textgrade.operators import ranking

    filled = ranking.forward_fill(events, "value", ["ts"], F.floor(F.col("ts") / 2), ["user"], start=0.0).collect()
    assert sorted(((r["user"], r["ts"], r["value"]) for r in filled), key=str) == sorted([(None, 1, 0.0), (None, 2, 5.0), (7, None, 1.0), (7, 3, 1.0)], key=str)


def test_letters_beyond_the_basic_plane(spark):
    from textgrade.operators import langid

    text = "a\U00010400b \U00020000"
    row = spark.createDataFrame([(text,)], "t string").select(langid.grams(langid.letters_only(F.col("t")), (2, 3)).alias("g")).first()
    plain = " " + text.replace("\U00010400", "\U00010428") + " "
    assert row["g"] == [plain[i : i + n] for n in (2, 3) for i in range(len(plain) - n + 1)]


def test_language_scores_equal_a_sum_gram_by_gram(spark):
    from textgrade.operators import langid

    random.seed(8)
    letters = "abcde\U00010428é"
    words = ["".join(random.choice(letters) for _ in range(random.randint(1, 6))) for _ in range(60)]
    grams = sorted({w[i : i + n] for w in words for n in (1, 2, 3, 5) for i in range(len(w) - n + 1)})
    weights = {(g, l): random.randint(1, 10**7) for g in grams for l in "xyz" if random.random() < 0.5}
    profiles = spark.createDataFrame([(l, g, w) for (g, l), w in weights.items()], "lang string, gram string, weight long")
    texts = [" ".join(random.sample(words, random.randint(1, 9))) for _ in range(80)] + [None, "", "7 8", "ZZ zz", "a" * 5000]
    texts += texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = langid.detect(docs, profiles, ["z", "y", "x"], ["id"], "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("ArrowEvalPython") == 1

    known = {g for g, _ in weights}
    expected = {}
    for i, text in enumerate(texts):
        clean = f" {' '.join((text or '').lower().split())} "
        if "7" in clean:
            continue
        hits = [clean[a : a + n] for n in (1, 2, 3, 5) for a in range(len(clean) - n + 1) if clean[a : a + n] in known]
        if hits:
            sums = {l: sum(weights.get((g, l), 0) for g in hits) for l in "xyz"}
            expected[i] = max("xyz", key=lambda l: (sums[l], -ord(l))), max(sums.values())
    assert {r["id"]: (r["lang_pred"], r["score"]) for r in found.collect()} == expected
    none = langid.detect(docs, profiles.limit(0), ["x"], ["id"], "t")
    assert none.columns == ["id", "lang_pred", "score"] and none.count() == 0
    assert langid.detect(docs.limit(0), profiles, ["x"], ["id"], "t").count() == 0


def test_files_are_read_whole_byte_for_byte(spark, tmp_path):
    """Plain files go by the reader of bytes, with the rows that the text reader gives."""
    import gzip

    from textgrade.sources.text import read_documents

    given = {"a.txt": "žluť\r\nx\n".encode(), "b.txt": b"\xef\xbb\xbfbom", "c.txt": b"bad \xff\xfe", "empty.txt": b"", "d.txt.gz": gzip.compress(b"packed"), "e.md": b"no"}
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    df = read_documents(spark, str(tmp_path))
    assert "binaryFile" in df._jdf.queryExecution().executedPlan().toString()
    shown = lambda d: sorted((r["file_name"], r["h"]) for r in d.selectExpr("file_name", "hex(text) AS h").collect())
    assert shown(df) == [(n, given[n].hex().upper()) for n in ("a.txt", "b.txt", "c.txt")]
    plain = spark.read.option("pathGlobFilter", "*.txt").text(str(tmp_path), wholetext=True)
    assert shown(df) == shown(plain.selectExpr("_metadata.file_name AS file_name", "value AS text"))
    assert [r["text"] for r in read_documents(spark, str(tmp_path), "*.gz").collect()] == ["packed"]
