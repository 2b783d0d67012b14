"""Queries over ``documents``: tokens, features, readability, frequency, the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrade.fixed_values import ENDINGS, LEXICON, SENTENCE_PATTERN, TOKEN_PATTERN, VOWELS
from textgrade.functions import names
from textgrade.functions.text import syllables
from textgrade.operators import annotate, features, frequency, groups
from textgrade.plans.registry import register, rounded, sql_rounded
from textgrade.sources.conllu import feature_string, parse_blocks, to_blocks, to_line
from textgrade.sources.tables import read_table, spread

# --- the same annotation in SQL --------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lexicon_sql() -> str:
    rows = []
    for lang, form, upos, feats in annotate.lexicon_rows():
        got = dict(pair.split("=") for pair in feats.split("|")) if feats else {}
        cells = [got.get(k) for k in ("PronType", "Person", "Number", "Mood")]
        rows.append("(" + ", ".join([_quoted(lang), _quoted(form), _quoted(upos)] + [_quoted(c) if c else "NULL" for c in cells]) + ")")
    return ", ".join(rows)


def _ending_sql(value: int, otherwise: str) -> str:
    whens = []
    for row in ENDINGS:
        lang, ending, upos, feats = row
        hit = f"t.lang = {_quoted(lang)} AND ends_with(t.lemma, {_quoted(ending)}) AND length(t.lemma) >= {len(ending) + 2}"
        if value == 2:
            whens.append(f"WHEN {hit} THEN {_quoted(upos)}")
        else:
            mood = dict(p.split("=") for p in feats.split("|")).get("Mood") if feats else None
            whens.append(f"WHEN {hit} THEN {_quoted(mood) if mood and upos == 'VERB' else 'NULL'}")
    return "CASE " + " ".join(whens) + f" ELSE {otherwise} END"


_LANGUAGES = ", ".join(_quoted(l) for l in sorted({r[0] for r in LEXICON}))

WORDS_SQL = f"""
sents AS (
  SELECT doc_id, lang, unnest(s) AS s, unnest(range(len(s))) AS sent_id
  FROM (SELECT doc_id, lang, regexp_extract_all(text, {_quoted(SENTENCE_PATTERN)}) AS s FROM documents)
),
words AS (
  SELECT doc_id, lang, sent_id, unnest(w) AS text, unnest(range(1, len(w) + 1)) AS word_id
  FROM (SELECT doc_id, lang, sent_id, regexp_extract_all(s, {_quoted(TOKEN_PATTERN)}) AS w FROM sents)
)"""

TOKENS_SQL = f"""{WORDS_SQL},
lexicon(lang, form, upos, ptype, person, number, mood) AS (VALUES {_lexicon_sql()}),
tagged AS (
  SELECT t.doc_id, t.sent_id, t.word_id, t.text, t.lemma,
    CASE WHEN NOT regexp_matches(t.text, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT'
         WHEN x.upos IS NOT NULL THEN x.upos
         WHEN regexp_matches(t.lemma, '^[0-9]+$') THEN 'NUM'
         ELSE {_ending_sql(2, "'NOUN'")} END AS upos,
    x.ptype, x.person, x.number,
    CASE WHEN x.upos IS NOT NULL THEN x.mood
         WHEN regexp_matches(t.lemma, '^[0-9]+$') THEN NULL
         ELSE {_ending_sql(3, "NULL")} END AS mood
  FROM (SELECT *, lower(text) AS lemma FROM words) t
  LEFT JOIN lexicon x ON x.lang = t.lang AND x.form = t.lemma
),
tokens AS (
  SELECT *, coalesce(max(CASE WHEN upos IN ('VERB', 'AUX') THEN word_id END) OVER (
    PARTITION BY doc_id, sent_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head
  FROM tagged
)"""

SYLLABLES_SQL = """
CASE WHEN z IN ('sedm', 'osm', 'vosm') THEN 2 WHEN z = 'hm' THEN 1 ELSE
  len(regexp_extract_all(z, '^eu|^au|ou|[V]'))
  + len(list_filter(range(1, length(z) + 1), lambda i: z[i] IN ('r', 'l')
      AND NOT regexp_matches(CASE WHEN i > 1 THEN z[i - 1] ELSE '' END, '[V]')
      AND NOT regexp_matches(z[i + 1], '[V]'))) END""".replace("V", VOWELS)
COLLAPSED_SQL = (
    "replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'r+', 'r', 'g'), 'l+', 'l', 'g'), 'm+', 'm', 'g'),"
    " 'neuro', 'nero')"
)

_D = "::DOUBLE"


def _r(top: str, bottom: str) -> str:
    return f"(({top})::DOUBLE / nullif({bottom}, 0)::DOUBLE)"


_N, _S = "count(*)", "count(*) FILTER (WHERE word_id = 1)"
_WPS, _CPW = _r(_N, _S), _r("sum(length(text))", _N)
_SYL = _r("sum(syl)", _N)


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


_PUNCT = "upos = 'PUNCT'"
_PRS = "upos = 'PRON' AND lower(ptype) = 'prs'"
FEATURE_SQL: dict[str, str] = {
    "words_per_sentence": _WPS,
    "n_tokens": _N,
    "n_sentences": _S,
    "mean_chars_per_word": _CPW,
    "max_chars_per_word": "max(length(text))::DOUBLE",
    "total_punctuation": _cnt(_PUNCT),
    "punct_per_sentence": _r(_cnt(_PUNCT), _S),
    "punct_token_ratio": _r(_cnt(_PUNCT), _N),
    "non_sentence_end_punct": _r(_cnt(_PUNCT + " AND text NOT IN ('.', '?', '!')"), _cnt(_PUNCT)),
    "dialogue_punct_ratio": _r(_cnt("text IN ('„', '\"', '“')"), _N),
    "type_token_ratio": _r("count(DISTINCT text)", _N),
    "total_types": "count(DISTINCT text)",
    "total_lemmas": "count(DISTINCT lemma)",
    "pronoun_ratio": _r(_cnt(_PRS), _N),
    **{
        f"pronoun_{key}_ratio": _r(_cnt(f"{_PRS} AND person = '{p}' AND number = '{n}'"), _N)
        for key, (p, n) in features.PERSONS.items()
    },
    "verbs_per_sentence": _r(_cnt("upos IN ('VERB', 'AUX')"), _S),
    "aux_per_sentence": _r(_cnt("upos = 'AUX'"), _S),
    "indicatives_per_sentence": _r(_cnt("upos = 'VERB' AND mood = 'Ind'"), _S),
    "conditionals_per_sentence": _r(_cnt("upos = 'AUX' AND mood = 'Cnd'"), _S),
    "verb_token_ratio": _r(_cnt("upos IN ('VERB', 'AUX')"), _N),
    "word_length": _r("sum(length(text)) FILTER (WHERE upos <> 'PUNCT')", _cnt("upos <> 'PUNCT'")),
    "nouns_per_sentence": _r(_cnt("upos = 'NOUN'"), _S),
    "adjectives_per_sentence": _r(_cnt("upos = 'ADJ'"), _S),
    "adpositions_per_sentence": _r(_cnt("upos = 'ADP'"), _S),
    "mean_dep_length": _r("sum(abs(word_id - head))", _N),
    "max_dep_length": "max(abs(word_id - head))::DOUBLE",
    "min_dep_length": "min(abs(word_id - head))::DOUBLE",
    **{
        f"mean_dep_length_{p.lower()}": f"coalesce({_r(f'sum(abs(word_id - head)) FILTER (WHERE upos = {_quoted(p)})', _cnt(f'upos = {_quoted(p)}'))}, 0)::DOUBLE"
        for p in features.DEPENDENCY_CLASSES
    },
    **{
        f"max_dep_length_{p.lower()}": f"coalesce(max(abs(word_id - head)) FILTER (WHERE upos = {_quoted(p)}), 0)::DOUBLE"
        for p in features.DEPENDENCY_CLASSES
    },
    "syllables_per_token": _SYL,
    "flesch_ease": f"206.935::DOUBLE - {_WPS} * 1.672::DOUBLE - {_SYL} * 62.183::DOUBLE",
    "flesch_kincaid_grade": f"{_WPS} * 0.52::DOUBLE + {_SYL} * 9.133::DOUBLE - 16.393::DOUBLE",
    "auto_read_index": f"{_WPS} * 3.666::DOUBLE + {_CPW} * 0.631::DOUBLE - 19.491::DOUBLE",
    "coleman_liau_index": f"{_CPW} * 0.047::DOUBLE * 100 - (1::DOUBLE / {_WPS}) * 0.286::DOUBLE * 100 - 12.9::DOUBLE",
}
_COUNTS = {"n_tokens", "n_sentences", "total_punctuation", "total_types", "total_lemmas"}
_SYLLABIC = {"syllables_per_token", "flesch_ease", "flesch_kincaid_grade"}
# built from words and punctuation alone: no tagging needed
_SURFACE = {
    "words_per_sentence", "n_tokens", "n_sentences", "mean_chars_per_word", "max_chars_per_word", "total_punctuation",
    "punct_per_sentence", "punct_token_ratio", "non_sentence_end_punct", "dialogue_punct_ratio", "type_token_ratio",
    "total_types", "total_lemmas", "word_length", "auto_read_index", "coleman_liau_index", *_SYLLABIC,
}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt out first only where the session asks for it."""
    docs = read_table(spark, folder, "documents")
    partitions = spark.conf.get("spark.textgrade.documentPartitions", "")
    return spread(docs, "doc_id", int(partitions)) if partitions else docs


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.annotate_rules(documents(spark, folder))


def _tokens_for(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    return annotate.tokenize(df) if set(wanted) <= _SURFACE else annotate.annotate_rules(df)


def _show(name: str):
    return F.col(name) if name in _COUNTS else rounded(name).alias(name)


def feature_query(wanted: tuple[str, ...]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        feats = features.document_features(_tokens_for(documents(spark, folder), wanted), wanted)
        return feats.select("doc_id", *[_show(n) for n in wanted])

    return run


def feature_sql(wanted: tuple[str, ...], from_: str = "tokens") -> str:
    columns = ", ".join(f"{FEATURE_SQL[n] if n in _COUNTS else sql_rounded(FEATURE_SQL[n])} AS {n}" for n in wanted)
    tokens, source = TOKENS_SQL, "tokens"
    if set(wanted) & _SYLLABIC:
        source = f"(SELECT *, {SYLLABLES_SQL} AS syl FROM (SELECT *, {COLLAPSED_SQL} AS z FROM tokens))"
    return f"WITH {tokens} SELECT doc_id, {columns} FROM {source} GROUP BY doc_id"


_SETS = {
    "readability_scores": (
        "words_per_sentence", "mean_chars_per_word", "type_token_ratio", "syllables_per_token",
        "flesch_ease", "flesch_kincaid_grade", "auto_read_index", "coleman_liau_index",
    ),
    "surface_features": (
        "n_tokens", "n_sentences", "max_chars_per_word", "total_punctuation", "punct_per_sentence", "punct_token_ratio",
        "non_sentence_end_punct", "dialogue_punct_ratio", "word_length",
    ),
    "lexical_diversity": ("type_token_ratio", "total_types", "total_lemmas"),
    "pos_features": ("nouns_per_sentence", "adjectives_per_sentence", "adpositions_per_sentence", "word_length"),
    "verb_features": (
        "verbs_per_sentence", "aux_per_sentence", "indicatives_per_sentence", "conditionals_per_sentence", "verb_token_ratio",
    ),
    "pronoun_features": ("pronoun_ratio", *[f"pronoun_{k}_ratio" for k in features.PERSONS]),
    "dependency_features": (
        "mean_dep_length", "max_dep_length", "min_dep_length",
        *[f"{m}_dep_length_{p.lower()}" for p in features.DEPENDENCY_CLASSES for m in ("mean", "max")],
    ),
}

for _name, _wanted in _SETS.items():
    register(_name, feature_query(_wanted), feature_sql(_wanted))
for _name in FEATURE_SQL:
    register(_name, feature_query((_name,)), feature_sql((_name,)))


# --- the token table itself ---------------------------------------------------------------------

def _token_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = token_table(spark, folder)
    return t.select(
        "doc_id", "sent_id", "word_id", "text", "lemma", "upos", "head",
        *[F.try_element_at("feats", F.lit(k)).alias(c) for k, c in
          (("PronType", "pron_type"), ("Person", "person"), ("Number", "number"), ("Mood", "mood"))],
    )


register(
    "annotated_tokens",
    _token_rows,
    f"WITH {TOKENS_SQL} SELECT doc_id, sent_id::INTEGER AS sent_id, word_id::INTEGER AS word_id, text, lemma, upos,"
    " head::INTEGER AS head, ptype AS pron_type, person, number, mood FROM tokens",
)
register(
    "flattened_words",
    lambda spark, folder: annotate.tokenize(documents(spark, folder)).select("doc_id", "sent_id", "word_id", "text"),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_id::INTEGER AS sent_id, word_id::INTEGER AS word_id, text FROM words",
)


def _class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_table(spark, folder).groupBy("upos").agg(F.count("*").alias("n"))


register("upos_counts", _class_counts, f"WITH {TOKENS_SQL} SELECT upos, count(*) AS n FROM tokens GROUP BY upos")


def _word_syllables(spark: SparkSession, folder: str) -> DataFrame:
    words = annotate.tokenize(documents(spark, folder))
    return words.groupBy("text").agg(F.count("*").alias("n")).select("text", "n", syllables(F.col("text")).alias("syllables"))


register(
    "word_syllables",
    _word_syllables,
    f"WITH {WORDS_SQL} SELECT text, n, ({SYLLABLES_SQL})::INTEGER AS syllables FROM (SELECT *, {COLLAPSED_SQL} AS z FROM"
    " (SELECT text, count(*) AS n FROM words GROUP BY text))",
)


def _conllu_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Token rows written as CoNLL-U blocks and parsed back, counted per class."""
    t = token_table(spark, folder)
    line = to_line(feature_string(F.col("feats")))
    parsed = parse_blocks(to_blocks(t.select("doc_id", "sent_id", "word_id", line.alias("line"))))
    return parsed.groupBy("doc_id", "upos").agg(
        F.count("*").alias("n"),
        F.sum("head").alias("sum_head"),
        F.count_if(F.try_element_at("feats", F.lit("PronType")) == "Prs").alias("n_personal"),
    )


register(
    "conllu_parsed",
    _conllu_round_trip,
    f"WITH {TOKENS_SQL} SELECT doc_id, upos, count(*) AS n, sum(head)::BIGINT AS sum_head,"
    " count(*) FILTER (WHERE ptype = 'Prs') AS n_personal FROM tokens GROUP BY doc_id, upos",
)

# --- frequency dictionary -----------------------------------------------------------------------

# The dictionary is that of another collection, so that lookups can miss.
DICTIONARY_WORDS_SQL = (
    WORDS_SQL.replace("sents", "other_sents").replace("words", "other_words").replace("FROM documents", "FROM (SELECT item_id AS doc_id, 'en' AS lang, text FROM benchmark)")
)


def _dictionary_sql(form: str) -> str:
    return f"""
counts_{form} AS (SELECT doc_id, {form} AS form, count(*) AS n FROM (SELECT *, lower(text) AS lemma FROM words) GROUP BY ALL),
dict_{form} AS (SELECT form, freq, rank() OVER (ORDER BY freq DESC) AS rank
  FROM (SELECT {form} AS form, count(*) AS freq FROM (SELECT *, lower(text) AS lemma FROM other_words) GROUP BY ALL))"""


def _lookup_sql(form: str, prefix: str) -> str:
    return f"""
looked_{prefix} AS (SELECT doc_id,
  {_r('sum(n * freq)', 'sum(n)')} AS mean_{prefix}_freq, min(freq)::DOUBLE AS min_{prefix}_freq,
  {_r('sum(n * rank)', 'sum(n)')} AS mean_{prefix}_rank, max(rank)::DOUBLE AS max_{prefix}_rank
  FROM counts_{form} JOIN dict_{form} USING (form) GROUP BY doc_id)"""


def dictionary_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Form counts of the collection that dictionaries are made of."""
    other = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("lang"))
    return frequency.form_counts(annotate.tokenize(other))


def _frequency(counts: DataFrame, others: DataFrame, form: str, prefix: str) -> DataFrame:
    return frequency.frequency_features(counts, form, frequency.dictionary_from_counts(others, form), prefix)


_FREQ_NAMES = {p: [f"{m}_{p}_{w}" for w, ms in (("freq", ("mean", "min")), ("rank", ("mean", "max"))) for m in ms] for p in ("lemma", "word")}

for _prefix, _form in (("lemma", "lemma"), ("word", "text")):

    def _run(spark: SparkSession, folder: str, form: str = _form, prefix: str = _prefix, only: str | None = None) -> DataFrame:
        counts = frequency.form_uses(annotate.tokenize(documents(spark, folder)))
        feats = _frequency(counts, dictionary_counts(spark, folder), form, prefix)
        return feats.select("doc_id", *[rounded(c).alias(c) for c in ([only] if only else _FREQ_NAMES[prefix])])

    def _sql(columns: list[str], form: str = _form, prefix: str = _prefix) -> str:
        shown = ", ".join(f"{sql_rounded(c)} AS {c}" for c in columns)
        return f"WITH {WORDS_SQL}, {DICTIONARY_WORDS_SQL}, {_dictionary_sql(form)}, {_lookup_sql(form, prefix)} SELECT doc_id, {shown} FROM looked_{prefix}"

    register(f"{_prefix}_frequency_features", _run, _sql(_FREQ_NAMES[_prefix]))
    for _column in _FREQ_NAMES[_prefix]:
        register(_column, lambda s, f, run=_run, c=_column: run(s, f, only=c), _sql([_column]))

    def _dictionary(spark: SparkSession, folder: str, form: str = _form) -> DataFrame:
        return frequency.dictionary_from_counts(dictionary_counts(spark, folder), form)

    register(
        f"{_prefix}_dictionary",
        _dictionary,
        f"WITH {WORDS_SQL}, {DICTIONARY_WORDS_SQL}, {_dictionary_sql(_form)} SELECT form, freq::BIGINT AS freq, rank FROM dict_{_form}",
    )


def _last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary of sources in which the last document of a source wins."""
    docs = read_table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return frequency.last_wins(docs, "source", ["doc_id"])


register(
    "last_value_dictionary",
    _last_wins,
    "SELECT source, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source",
)

# --- feature table ---------------------------------------------------------------------------------

# Names as the corpus has them: books of class 0 and 1 with a 4-digit id, the third corpus with 5.
# The class follows from the source, so every group has one class.
NAMED_SQL = """
named AS (
  SELECT *, CASE WHEN label = 2 THEN format('{:05d}_ctdc.txt', doc_id)
    ELSE format('{:04d}_Edika_{}_{}_{:03d}.txt', doc_id % 10000, CASE WHEN label = 0 THEN 'a1-a2' ELSE 'b1' END, source, doc_id) END AS name
  FROM (SELECT *, replace(source, 'src', '')::INTEGER % 3 AS label FROM documents)
)"""


def named_documents(df: DataFrame) -> DataFrame:
    """Documents with ``label`` and a file name in the corpus format."""
    labelled = df.withColumn("label", F.pmod(F.replace("source", F.lit("src"), F.lit("")).cast("int"), F.lit(3)))
    level = F.when(F.col("label") == 0, "a1-a2").otherwise("b1")
    book = names.chapter_name(F.pmod("doc_id", F.lit(10000)), level, F.col("source"), F.col("doc_id"))
    third = F.concat(names.padded(F.col("doc_id"), 5), F.lit("_ctdc.txt"))
    return labelled.withColumn("name", F.when(F.col("label") == 2, third).otherwise(book))


GROUPED_SQL = """
titled AS (SELECT *, CASE WHEN label = 2 THEN 'CTDC' ELSE split_part(name, '_', 3) || '_' || split_part(name, '_', 4) END AS title FROM named),
title_group AS (SELECT title, row_number() OVER (ORDER BY md5(title || '|42')) - 1 AS grp FROM (SELECT DISTINCT title FROM titled WHERE title <> 'CTDC')),
turn AS (SELECT name, greatest(31, (SELECT count(*) FROM title_group)) + (row_number() OVER (ORDER BY md5(name || '|42')) - 1) % 10 AS grp FROM titled WHERE title = 'CTDC'),
grouped AS (SELECT titled.*, coalesce(title_group.grp, turn.grp)::INTEGER AS "group" FROM titled
  LEFT JOIN title_group USING (title) LEFT JOIN turn USING (name))"""


def feature_table(df: DataFrame, others: DataFrame) -> DataFrame:
    """All 44 features with name, group and label; a document without words keeps its row."""
    named = groups.with_groups(named_documents(df.select("doc_id", "lang", "source")))
    tokens = annotate.annotate_rules(df)
    dictionaries = {prefix: (form, frequency.dictionary_from_counts(others, form)) for prefix, form in (("lemma", "lemma"), ("word", "text"))}
    # what fits a broadcast is looked up in the pass that adds up the tokens
    here = {p for p, (_, dictionary) in dictionaries.items() if frequency.fits_head(dictionary)}
    more: list = []
    for prefix, (form, dictionary) in dictionaries.items():
        if prefix in here:
            tokens = frequency.with_entries(tokens, form, dictionary, prefix)
            hit = F.when(F.col(f"{prefix}_freq").isNotNull(), F.lit(1).cast("long"))
            more += frequency.frequency_aggregates(prefix, hit, f"{prefix}_freq", f"{prefix}_rank")
    parts = [features.document_features(tokens, features.TOKEN_FEATURE_NAMES, more=more)]
    counts = frequency.form_uses(annotate.tokenize(df))
    parts += [frequency.frequency_features(counts, form, d, p) for p, (form, d) in dictionaries.items() if p not in here]
    joined = reduce(lambda left, right: left.join(right, "doc_id", "left"), parts, named)
    return joined.select("doc_id", "name", *features.FEATURE_NAMES, "group", "label")


def _feature_table(spark: SparkSession, folder: str) -> DataFrame:
    table = feature_table(documents(spark, folder), dictionary_counts(spark, folder))
    return table.select("name", *[rounded(n).alias(n) for n in features.FEATURE_NAMES], "group", "label")


def _feature_table_sql() -> str:
    from_tokens = ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in features.TOKEN_FEATURE_NAMES)
    shown = ", ".join(f"{sql_rounded(n)} AS {n}" for n in features.FEATURE_NAMES)
    return f"""WITH {TOKENS_SQL}, {NAMED_SQL}, {GROUPED_SQL},
{DICTIONARY_WORDS_SQL}, {_dictionary_sql('lemma')}, {_dictionary_sql('text')}, {_lookup_sql('lemma', 'lemma')}, {_lookup_sql('text', 'word')},
base AS (SELECT doc_id, {from_tokens} FROM tokens GROUP BY doc_id)
SELECT name, {shown}, "group", label FROM grouped LEFT JOIN base USING (doc_id) LEFT JOIN looked_lemma USING (doc_id)
LEFT JOIN looked_word USING (doc_id)"""


register("feature_table", _feature_table, _feature_table_sql())


def _feature_file(spark: SparkSession, folder: str) -> DataFrame:
    """Feature table with the headers of the feature file."""
    return features.csv_layout(_feature_table(spark, folder))


def _feature_file_sql() -> str:
    from textgrade.fixed_values import FEATURE_HEADERS

    shown = ", ".join(f'{c} AS "{h}"' for h, c in FEATURE_HEADERS.items())
    return f'SELECT name, {shown}, "group", label FROM ({_feature_table_sql()})'


register("feature_file_layout", _feature_file, _feature_file_sql())
