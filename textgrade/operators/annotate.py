"""Token tables: one row per word, from any tagger or from a rule annotator in SQL.

Columns of a token table: ``doc_id, sent_id, word_id, text, lemma, upos, feats, head`` with
``feats`` a string map. Two document-level columns, ``doc_types`` and ``doc_lemmas`` (distinct
forms and lemmas), are optional; :mod:`textgrade.operators.features` uses them when present.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgrade.fixed_values import ENDINGS, LEXICON
from textgrade.functions.text import is_punctuation, sentences, tokens

TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sent_id", T.IntegerType()),
        T.StructField("word_id", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("upos", T.StringType()),
        T.StructField("feats", T.MapType(T.StringType(), T.StringType())),
        T.StructField("head", T.IntegerType()),
    ]
)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of rows; the hook for a user's own per-batch function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def annotate(df: DataFrame, tagger: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Token table from a tagger that turns a batch of ``doc_id, text`` rows into token rows."""
    return map_batches(df.select("doc_id", "text"), tagger, TOKEN_SCHEMA)


def feature_map(feats: Column) -> Column:
    """``Key=Val|Key=Val`` to a map; ``_`` and the empty string to NULL."""
    return F.when((feats != "_") & (feats != ""), F.str_to_map(feats, F.lit("\\|"), F.lit("=")))


def lexicon_rows() -> list[tuple[str, str, str, str]]:
    return [(lang, form, upos, feats) for lang, upos, feats, forms in LEXICON for form in forms.split()]


def lexicon(spark: SparkSession) -> DataFrame:
    """Closed-class forms with features; a fixed list, so always small enough to broadcast."""
    rows = spark.createDataFrame(
        [r for r in lexicon_rows() if r[3]], "_lang string, _form string, _upos string, _feats string"
    )
    return F.broadcast(rows.select("_lang", "_form", feature_map(F.col("_feats")).alias("_feats")))


def ending_matches(form: Column, ending: str) -> Column:
    return F.endswith(form, F.lit(ending)) & (F.length(form) >= len(ending) + 2)


def _is_number(form: Column) -> Column:
    """Digits alone; the comparison spares most words the regular expression."""
    return form.between("0", "9~") & form.rlike("^[0-9]+$")


def part_of_speech(lang: Column, form: Column) -> Column:
    """UPOS of a lower-cased form: punctuation, closed-class list, number, ending, else noun."""
    languages = sorted({row[0] for row in LEXICON})
    by_language = None
    for language in languages:
        rules: Column | None = None
        for upos in sorted({row[1] for row in LEXICON if row[0] == language}):
            forms = [f for row in LEXICON if row[:2] == (language, upos) for f in row[3].split()]
            hit = form.isin(forms)
            rules = F.when(hit, upos) if rules is None else rules.when(hit, upos)
        # most words are in no list: one look finds that out for all of them
        listed = [f for row in LEXICON if row[0] == language for f in row[3].split()]
        rules = F.when(form.isin(listed), rules).when(_is_number(form), "NUM")
        for lang_of_ending, ending, upos, _ in ENDINGS:
            if lang_of_ending == language:
                rules = rules.when(ending_matches(form, ending), upos)
        rules = rules.otherwise("NOUN")
        by_language = F.when(lang == language, rules) if by_language is None else by_language.when(lang == language, rules)
    other = F.when(_is_number(form), "NUM").otherwise("NOUN")
    return F.when(is_punctuation(form), "PUNCT").otherwise(by_language.otherwise(other))


def _ending_features(lang: Column, form: Column, upos: Column) -> Column:
    """Features an ending carries; only verbs found by ending have any."""
    col: Column | None = None
    for language, ending, pos, feats in ENDINGS:
        if pos != "VERB":
            continue
        hit = (lang == language) & (upos == "VERB") & ending_matches(form, ending)
        value = feature_map(F.lit(feats)) if feats else F.lit(None).cast("map<string,string>")
        col = F.when(hit, value) if col is None else col.when(hit, value)
    return col


def _sentence_rows(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per sentence with its words; the document's vocabulary sizes ride along.

    The outer explode keeps the optimizer from adding a filter that would tokenize a second time.
    """
    split = df.select(
        "doc_id", *keep, F.transform(sentences(F.col("text")), lambda s: tokens(s)).alias("_sentences")
    )
    words = F.flatten("_sentences")
    sized = split.select(
        "doc_id",
        *keep,
        "_sentences",
        F.size(F.array_distinct(words)).alias("doc_types"),
        F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("doc_lemmas"),
    )
    return sized.select(
        "doc_id", *keep, "doc_types", "doc_lemmas", F.posexplode_outer("_sentences").alias("sent_id", "_words")
    )


def tokenize(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sentences and words of ``doc_id, text`` rows, ``upos`` known only for punctuation.

    Rows stay in the partition of their document: nothing is shuffled.
    """
    per_sentence = _sentence_rows(df, keep)
    per_word = per_sentence.select(
        "doc_id", *keep, "doc_types", "doc_lemmas", "sent_id", F.posexplode("_words").alias("_at", "text")
    )
    return per_word.select(
        "doc_id",
        *keep,
        "sent_id",
        (F.col("_at") + 1).alias("word_id"),
        "text",
        F.lower("text").alias("lemma"),
        F.when(is_punctuation(F.col("text")), "PUNCT").alias("upos"),
        "doc_types",
        "doc_lemmas",
    )


def annotate_rules(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rule-based token table of ``doc_id, lang, text`` rows, all in SQL functions.

    The head of a word is the last verb or auxiliary before it in its sentence, 0 when there is
    none. Verb positions cut a sentence into stretches that share a head, so the heads are laid out
    stretch by stretch, in time linear in the sentence and without a window over tokens.
    """
    per_sentence = _sentence_rows(df, ("lang", *keep)).where(F.size("_words") > 0)
    tagged = per_sentence.withColumn("_forms", F.transform("_words", lambda w: F.lower(w))).withColumn(
        "_upos", F.transform("_forms", lambda form: part_of_speech(F.col("lang"), form))
    )
    size = F.size("_words")
    verbs = F.filter(
        F.sequence(F.lit(1), size), lambda i: F.element_at("_upos", i).isin("VERB", "AUX")
    )
    stretched = tagged.withColumn("_verbs", verbs).withColumn(
        "_heads",
        F.flatten(
            F.zip_with(
                F.concat(F.array(F.lit(0)), F.col("_verbs")),
                F.concat(F.col("_verbs"), F.array(size)),
                lambda start, end: F.array_repeat(start, end - start),
            )
        ),
    )
    per_word = stretched.select(
        "doc_id",
        "lang",
        *keep,
        "doc_types",
        "doc_lemmas",
        "sent_id",
        F.posexplode(F.arrays_zip(F.col("_words").alias("w"), F.col("_forms").alias("l"), F.col("_upos").alias("p"), F.col("_heads").alias("h"))).alias(
            "_at", "_t"
        ),
    ).select(
        "doc_id",
        "lang",
        *keep,
        "sent_id",
        (F.col("_at") + 1).alias("word_id"),
        F.col("_t.w").alias("text"),
        F.col("_t.l").alias("lemma"),
        F.col("_t.p").alias("upos"),
        F.col("_t.h").alias("head"),
        "doc_types",
        "doc_lemmas",
    )
    closed = lexicon(df.sparkSession)
    found = per_word.join(closed, (F.col("lang") == F.col("_lang")) & (F.col("lemma") == F.col("_form")), "left")
    feats = F.coalesce("_feats", _ending_features(F.col("lang"), F.col("lemma"), F.col("upos")))
    return found.select(
        "doc_id", *keep, "sent_id", "word_id", "text", "lemma", "upos", feats.alias("feats"), "head",
        "doc_types", "doc_lemmas",
    )
