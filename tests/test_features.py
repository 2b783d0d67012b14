"""Token features on the ten-word document with values worked out by hand."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textgrade.fixed_values import FEATURE_HEADERS
from textgrade.functions.text import normalized, split_lines, split_units, syllables
from textgrade.operators import annotate, features, frequency

TOKENS = """
0 1 Já já PRON Number=Sing|Person=1|PronType=Prs 2
0 2 hraju hrát VERB Mood=Ind|Number=Sing|Person=1 0
0 3 hru hra NOUN Case=Acc 2
0 4 , , PUNCT _ 2
0 5 hru hra NOUN Case=Acc 3
0 6 . . PUNCT _ 2
1 1 My my PRON Number=Plur|Person=1|PronType=Prs 3
1 2 bychom být AUX Mood=Cnd 3
1 3 hráli hrát VERB Number=Plur 0
1 4 ? ? PUNCT _ 3
"""

EXPECTED = {
    "n_tokens": 10, "n_sentences": 2, "words_per_sentence": 5, "mean_chars_per_word": 2.9, "max_chars_per_word": 6,
    "total_punctuation": 3, "punct_per_sentence": 1.5, "punct_token_ratio": 0.3, "non_sentence_end_punct": 1 / 3,
    "dialogue_punct_ratio": 0, "type_token_ratio": 0.9, "total_types": 9, "total_lemmas": 8,
    "pronoun_ratio": 0.2, "pronoun_1sg_ratio": 0.1, "pronoun_2sg_ratio": 0, "pronoun_3sg_ratio": 0,
    "pronoun_1pl_ratio": 0.1, "pronoun_2pl_ratio": 0, "pronoun_3pl_ratio": 0,
    "verbs_per_sentence": 1.5, "aux_per_sentence": 0.5, "indicatives_per_sentence": 0.5, "conditionals_per_sentence": 0.5,
    "verb_token_ratio": 0.3, "word_length": 26 / 7, "nouns_per_sentence": 1, "adjectives_per_sentence": 0,
    "adpositions_per_sentence": 0, "mean_dep_length": 1.9, "min_dep_length": 1, "max_dep_length": 4,
    "mean_dep_length_noun": 1.5, "max_dep_length_noun": 2, "mean_dep_length_adj": 0, "max_dep_length_adj": 0,
    "mean_dep_length_adv": 0, "mean_dep_length_verb": 2.5, "max_dep_length_verb": 3, "max_dep_length_intj": 0,
    "syllables_per_token": 1, "flesch_ease": 136.392, "flesch_kincaid_grade": -4.66, "auto_read_index": 0.6689,
    "coleman_liau_index": -4.99,
}


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [line.split() for line in TOKENS.strip().splitlines()]
    df = spark.createDataFrame(
        [(1, int(s), int(w), t, l, p, f, int(h)) for s, w, t, l, p, f, h in rows],
        "doc_id long, sent_id int, word_id int, text string, lemma string, upos string, f string, head int",
    )
    return df.withColumn("feats", annotate.feature_map(F.col("f"))).drop("f")


def test_every_feature_by_hand(tokens):
    names = list(features.feature_columns())
    row = features.document_features(tokens, names).first().asDict()
    for name, value in EXPECTED.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name


def test_exclude_root(tokens):
    row = features.document_features(tokens, ["mean_dep_length", "max_dep_length"], exclude_root=True).first()
    assert row["mean_dep_length"] == pytest.approx((1 + 1 + 2 + 2 + 4 + 2 + 1 + 1) / 8)
    assert row["max_dep_length"] == 4


def test_result_does_not_depend_on_partitioning(tokens):
    names = list(EXPECTED)
    one = features.document_features(tokens.repartition(1), names).first()
    many = features.document_features(tokens.repartition(17), names).first()
    assert one == many


def test_missing_feature_string_and_lemma(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, "On", None, "PRON", None, 0), (1, 0, 2, "je", "být", "AUX", None, 1)],
        "doc_id long, sent_id int, word_id int, text string, lemma string, upos string, feats map<string,string>, head int",
    )
    row = features.document_features(df, ["pronoun_ratio", "total_lemmas", "non_sentence_end_punct"]).first()
    assert row["pronoun_ratio"] == 0 and row["total_lemmas"] == 2 and row["non_sentence_end_punct"] is None


def test_frequency_lookup_skips_misses(spark, tokens):
    other = tokens.withColumn("doc_id", F.lit(2).cast("long")).withColumn("lemma", F.lit("?"))
    dictionary = spark.createDataFrame(
        [("já", 100.0, 5.0), ("hrát", 20.0, 40.0), ("být", 500.0, 1.0)], "form string, freq double, rank double"
    )
    counts = frequency.form_counts(tokens.unionByName(other))
    for head_rows in (0, 1, 100):  # all rows by key, mixed, all broadcast
        rows = {
            r["doc_id"]: r
            for r in frequency.look_up(counts, "lemma", dictionary, head_rows)
            .groupBy("doc_id")
            .agg(F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("freq")).alias("s"), F.max("rank").alias("m"))
            .collect()
        }
        assert list(rows) == [1]
        assert (rows[1]["hits"], rows[1]["s"], rows[1]["m"]) == (4, 640.0, 40.0)
    row = frequency.frequency_features(counts, "lemma", dictionary, "lemma").first()
    assert (row["mean_lemma_freq"], row["min_lemma_freq"]) == (160, 20)
    assert (row["mean_lemma_rank"], row["max_lemma_rank"]) == (21.5, 40)


def test_last_row_of_a_key_wins(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 3.0, 2)], "form string, freq double, row long")
    got = {r["form"]: r["freq"] for r in frequency.last_wins(df, "form", ["row"]).collect()}
    assert got == {"a": 2.0, "b": 3.0}


def brute_syllables(word):
    """The counting rule in plain steps."""
    vowels = "aeiuoyáéíóúůýěäëïöü"
    z = word.lower()
    for letter in "rlm":
        z = re.sub(letter + "+", letter, z)
    z = z.replace("neuro", "nero")
    if z in ("sedm", "osm", "vosm"):
        return 2
    if z == "hm":
        return 1
    n = i = 0
    while i < len(z):
        pair = z[i : i + 2]
        if pair == "ou" or (i == 0 and pair in ("eu", "au")):
            n, i = n + 1, i + 2
            continue
        before, after = z[i - 1 : i] if i else "", z[i + 1 : i + 2]
        is_syllabic = z[i] in "rl" and not (before and before in vowels) and not (after and after in vowels)
        n += z[i] in vowels or is_syllabic
        i += 1
    return n


SYLLABLES = {
    "neurologie": 5, "sedm": 2, "hmm": 1, "vlk": 1, "prst": 1, "auto": 2, "eufonie": 4, "louka": 2, "r": 1, "krtek": 2,
    "hra": 1, "čtvrt": 1, "Brno": 2, "louie": 3, "beauty": 4, ".": 0,
}


def test_syllables(spark):
    import itertools

    words = list(SYLLABLES) + ["".join(p) for n in range(1, 5) for p in itertools.product("aeourlmnh", repeat=n)]
    words += ["neurro", "sedmm", "vosm", "Osm", "osmm", "neuneuro", "eur", "aur", "prrl", "rrolla", "nosm", "vvosm"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", syllables(F.col("w")).alias("n")).collect()
    for r in got:
        assert r["n"] == brute_syllables(r["w"]), r["w"]
    table = {r["w"]: r["n"] for r in got}
    assert {w: table[w] for w in SYLLABLES} == SYLLABLES


def test_rule_annotator_heads_and_sentences(spark):
    df = spark.createDataFrame([(1, "en", "She is running fast. Go!\nNo verb here"), (2, "xx", "...")], "doc_id long, lang string, text string")
    rows = annotate.annotate_rules(df).where("doc_id = 1").orderBy("sent_id", "word_id").collect()
    assert [(r["text"], r["upos"], r["head"]) for r in rows[:5]] == [
        ("She", "PRON", 0), ("is", "AUX", 0), ("running", "VERB", 2), ("fast", "ADJ", 3), (".", "PUNCT", 3),
    ]
    assert rows[0]["feats"]["Person"] == "3" and rows[1]["feats"] == {"Mood": "Ind"}
    assert {r["doc_types"] for r in rows} == {10}


def test_pluggable_tagger(spark):
    def tagger(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (d, 0, i + 1, w, w.lower(), "X", {"K": "V"}, 0)
            for d, text in zip(batch["doc_id"], batch["text"])
            for i, w in enumerate(text.split())
        ]
        return pd.DataFrame(rows, columns=annotate.TOKEN_SCHEMA.names)

    df = spark.createDataFrame([(1, "A b"), (2, "c")], "doc_id long, text string")
    got = annotate.annotate(df, tagger)
    assert got.count() == 3 and got.schema == annotate.TOKEN_SCHEMA


def test_text_helpers(spark):
    df = spark.createDataFrame([("a b\x0cc­d\x0c", "x\ny\n\nz")], "t string, l string")
    row = df.select(split_units(normalized(F.col("t"))).alias("u"), split_lines(F.col("l")).alias("l")).first()
    assert row["u"] == ["a b", "cd", ""]
    assert row["l"] == ["x\n", "y\n", "\n", "z"]


def test_feature_file_headers():
    assert len(FEATURE_HEADERS) == 44 and list(FEATURE_HEADERS.values()) == list(features.FEATURE_NAMES)


def test_small_dictionaries_cost_no_shuffle_of_forms(spark):
    """Lookups in a dictionary that fits the head add up tokens where they are: one shuffle of sums by document."""
    rows = [(1, "a b a c"), (2, "b b"), (2, "a z"), (3, "z"), (None, "a")]
    tokens = annotate.tokenize(spark.createDataFrame(rows, "doc_id long, text string"))
    dictionary = spark.createDataFrame([("a", 9, 1), ("b", 4, 2)], "form string, freq long, rank long")
    found = frequency.frequency_features(frequency.form_uses(tokens), "text", dictionary, "word")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {1: (22 / 3, 4.0, 4 / 3, 2.0), 2: (17 / 3, 4.0, 5 / 3, 2.0)}
    counted = frequency.frequency_features(frequency.form_counts(tokens), "text", dictionary, "word")
    assert {r["doc_id"]: tuple(r)[1:] for r in counted.collect()} == got


def test_conllu_blocks_without_a_shuffle(spark):
    """A sentence's lines are joined where they are, also across batches; repeated sentences are blocks of their own."""
    from textgrade.sources.conllu import to_blocks

    lines = [(d, s, w, f"{d}-{s}-{w}") for d in (1, 1, None, 2) for s in range(4) for w in range(1, 8)]
    df = spark.createDataFrame(lines, "doc_id long, sent_id int, word_id int, line string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        blocks = to_blocks(df)
        assert "Exchange hashpartitioning" not in blocks._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(map(str, r)) for r in blocks.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(str(d), str(s), "\n".join(f"{d}-{s}-{w}" for w in range(1, 8))) for d in (1, 1, None, 2) for s in range(4)]
    assert got == sorted(want)
