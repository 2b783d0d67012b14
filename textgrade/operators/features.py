"""Document features: one grouped aggregation over the token table, then plain arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrade.fixed_values import DIALOGUE_MARKS, FEATURE_HEADERS, SENTENCE_END_MARKS
from textgrade.functions import readability
from textgrade.functions.text import syllables

DEPENDENCY_CLASSES = ("NOUN", "ADJ", "ADV", "VERB", "INTJ")
PERSONS = {"1sg": ("1", "Sing"), "2sg": ("2", "Sing"), "3sg": ("3", "Sing"), "1pl": ("1", "Plur"), "2pl": ("2", "Plur"), "3pl": ("3", "Plur")}


def _upos(*classes: str) -> Column:
    return F.col("upos").isin(*classes)


def _feat(key: str) -> Column:
    return F.try_element_at("feats", F.lit(key))


def _personal_pronoun() -> Column:
    return _upos("PRON") & (F.lower(_feat("PronType")) == "prs")


def _distance() -> Column:
    return F.abs(F.col("word_id") - F.col("head"))


def _counted(condition: Column) -> Column:
    return F.count_if(condition)


def token_aggregates(columns: Sequence[str]) -> dict[str, Column]:
    """Sums, counts and extremes over one document's tokens; everything a feature is built from."""
    length = F.length("text")
    punct, word = _upos("PUNCT"), ~F.coalesce(_upos("PUNCT"), F.lit(False))
    aggs = {
        "n_tokens": F.count("*"),
        "n_sentences": _counted(F.col("word_id") == 1),
        "sum_chars": F.sum(length),
        "top_chars": F.max(length),
        "n_punct": _counted(punct),
        "n_inner_punct": _counted(punct & ~F.col("text").isin(*SENTENCE_END_MARKS)),
        "n_dialogue": _counted(F.col("text").isin(*DIALOGUE_MARKS)),
        "sum_word_chars": F.sum(F.when(word, length)),
        "n_words": _counted(word),
        "sum_syllables": F.sum(syllables(F.col("text"))),
        "n_types": F.max("doc_types") if "doc_types" in columns else F.count_distinct("text"),
        # a missing lemma counts as one more lemma
        "n_lemmas": F.max("doc_lemmas")
        if "doc_lemmas" in columns
        else F.count_distinct("lemma") + F.max(F.col("lemma").isNull().cast("int")),
        "n_verb_aux": _counted(_upos("VERB", "AUX")),
        "n_aux": _counted(_upos("AUX")),
        "n_noun": _counted(_upos("NOUN")),
        "n_adj": _counted(_upos("ADJ")),
        "n_adp": _counted(_upos("ADP")),
    }
    if "feats" in columns:
        aggs["n_pron"] = _counted(_personal_pronoun())
        for key, (person, number) in PERSONS.items():
            aggs[f"n_pron_{key}"] = _counted(
                _personal_pronoun() & (_feat("Person") == person) & (_feat("Number") == number)
            )
        aggs["n_ind"] = _counted(_upos("VERB") & (_feat("Mood") == "Ind"))
        aggs["n_cnd"] = _counted(_upos("AUX") & (_feat("Mood") == "Cnd"))
    if "head" in columns:
        aggs["sum_dep"] = F.sum(_distance())
        aggs["n_dep"] = F.count(_distance())
        aggs["top_dep"] = F.max(_distance())
        aggs["low_dep"] = F.min(_distance())
        for pos in DEPENDENCY_CLASSES:
            aggs[f"sum_dep_{pos}"] = F.sum(F.when(_upos(pos), _distance()))
            aggs[f"n_dep_{pos}"] = F.count(F.when(_upos(pos), _distance()))
            aggs[f"top_dep_{pos}"] = F.max(F.when(_upos(pos), _distance()))
    return aggs


def _ratio(top: str, bottom: str) -> Column:
    return F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))


def feature_columns() -> dict[str, Column]:
    """Feature name -> expression over :func:`token_aggregates`."""
    wps, cpw, syl = _ratio("n_tokens", "n_sentences"), _ratio("sum_chars", "n_tokens"), _ratio("sum_syllables", "n_tokens")
    feats = {
        "words_per_sentence": wps,
        "n_tokens": F.col("n_tokens"),
        "n_sentences": F.col("n_sentences"),
        "mean_chars_per_word": cpw,
        "max_chars_per_word": F.col("top_chars").cast("double"),
        "total_punctuation": F.col("n_punct"),
        "punct_per_sentence": _ratio("n_punct", "n_sentences"),
        "punct_token_ratio": _ratio("n_punct", "n_tokens"),
        "non_sentence_end_punct": _ratio("n_inner_punct", "n_punct"),
        "dialogue_punct_ratio": _ratio("n_dialogue", "n_tokens"),
        "type_token_ratio": _ratio("n_types", "n_tokens"),
        "total_types": F.col("n_types").cast("long"),
        "total_lemmas": F.col("n_lemmas").cast("long"),
        "pronoun_ratio": _ratio("n_pron", "n_tokens"),
    }
    for key in PERSONS:
        feats[f"pronoun_{key}_ratio"] = _ratio(f"n_pron_{key}", "n_tokens")
    feats |= {
        "verbs_per_sentence": _ratio("n_verb_aux", "n_sentences"),
        "aux_per_sentence": _ratio("n_aux", "n_sentences"),
        "indicatives_per_sentence": _ratio("n_ind", "n_sentences"),
        "conditionals_per_sentence": _ratio("n_cnd", "n_sentences"),
        "verb_token_ratio": _ratio("n_verb_aux", "n_tokens"),
        "word_length": _ratio("sum_word_chars", "n_words"),
        "nouns_per_sentence": _ratio("n_noun", "n_sentences"),
        "adjectives_per_sentence": _ratio("n_adj", "n_sentences"),
        "adpositions_per_sentence": _ratio("n_adp", "n_sentences"),
        "mean_dep_length": _ratio("sum_dep", "n_dep"),
        "max_dep_length": F.col("top_dep").cast("double"),
        "min_dep_length": F.col("low_dep").cast("double"),
    }
    for pos in DEPENDENCY_CLASSES:
        feats[f"mean_dep_length_{pos.lower()}"] = F.coalesce(_ratio(f"sum_dep_{pos}", f"n_dep_{pos}"), F.lit(0.0))
        feats[f"max_dep_length_{pos.lower()}"] = F.coalesce(F.col(f"top_dep_{pos}").cast("double"), F.lit(0.0))
    feats |= {
        "syllables_per_token": syl,
        "flesch_ease": readability.flesch_ease(wps, syl),
        "flesch_kincaid_grade": readability.flesch_kincaid_grade(wps, syl),
        "auto_read_index": readability.auto_read_index(wps, cpw),
        "coleman_liau_index": readability.coleman_liau_index(wps, cpw),
    }
    return feats


def document_features(tokens: DataFrame, names: Sequence[str], exclude_root: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """The named features, one row per ``doc_id``.

    Partial aggregation leaves one row per document and task before the only shuffle. With
    ``exclude_root`` words whose head is 0 have no dependency length. ``more`` are named aggregates that ride along.
    """
    if exclude_root:
        tokens = tokens.withColumn("head", F.when(F.col("head") != 0, F.col("head")))
    aggs = token_aggregates(tokens.columns)
    grouped = tokens.groupBy("doc_id").agg(*[col.alias(name) for name, col in aggs.items()], *more)
    feats = feature_columns()
    return grouped.select("doc_id", *[feats[n].alias(n) for n in names], *grouped.columns[len(aggs) + 1 :])


FEATURE_NAMES = tuple(FEATURE_HEADERS.values())
TOKEN_FEATURE_NAMES = tuple(n for n in FEATURE_NAMES if not n.endswith(("_freq", "_rank")))


def csv_layout(features: DataFrame) -> DataFrame:
    """Feature table in the column order and with the headers of the feature file."""
    named = [F.col(col).alias(header) for header, col in FEATURE_HEADERS.items()]
    return features.select("name", *named, "group", "label")
