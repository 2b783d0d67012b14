"""Queries for ingest, language identification, groups, folds, splits and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrade.fixed_values import THIRD_CLASS_CAP
from textgrade.functions import names
from textgrade.functions.text import normalized, split_lines, split_units
from textgrade.operators import frequency, groups, ingest, langid, profile, ranking, sampling
from textgrade.plans.document_features import GROUPED_SQL, NAMED_SQL, documents, named_documents
from textgrade.plans.registry import register, rounded, sql_rounded
from textgrade.session import kept
from textgrade.sources.tables import read_table

# --- units, chapters, names -----------------------------------------------------------------------

FILES_SQL = """files AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'a1-a2_' ELSE 'b1_' END || source || '-' || doc_id || '.txt' AS file_name FROM documents)"""
MIXED_SQL = """mixed AS (SELECT doc_id, source || '-' || doc_id || CASE lang WHEN 'en' THEN '-a1-a2' WHEN 'fr' THEN '-b1' ELSE '' END || '.txt' AS file_name FROM documents)"""


def book_files(df: DataFrame) -> DataFrame:
    """Documents under names such as ``a1-a2_title.txt``."""
    level = F.when(F.col("lang") == "en", "a1-a2_").otherwise("b1_")
    name = F.concat(level, F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return df.select("doc_id", "text", name.alias("file_name"))


def mixed_files(df: DataFrame) -> DataFrame:
    """Names such as ``title-a1-a2.txt``, some without a level."""
    level = F.when(F.col("lang") == "en", "-a1-a2").when(F.col("lang") == "fr", "-b1").otherwise("")
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), level, F.lit(".txt"))
    return df.select("doc_id", name.alias("file_name"))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    df = documents(spark, folder)
    return ingest.units(df, split_units(F.col("text"), "\n"), ["doc_id"])


register(
    "split_units",
    _units,
    "SELECT doc_id, unnest(range(1, len(u) + 1))::INTEGER AS unit_id, unnest(u) AS unit"
    " FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents)",
)
register(
    "unit_numbers",
    lambda s, f: _units(s, f).select("doc_id", "unit_id", F.length("unit").alias("n_chars")),
    "SELECT doc_id, unnest(range(1, len(u) + 1))::INTEGER AS unit_id, length(unnest(u))::INTEGER AS n_chars"
    " FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents)",
)
register(
    "normalized_text",
    lambda s, f: documents(s, f).select("doc_id", normalized(F.col("text")).alias("text")),
    "SELECT doc_id, replace(replace(text, chr(160), ' '), chr(173), '') AS text FROM documents",
)
register(
    "numbered_chapters",
    lambda s, f: ingest.numbered_chapters(documents(s, f).select("doc_id", "text"), "doc_id", "\n").select(
        "doc_id", "chapter", "global_id", F.length("text").alias("n_chars")
    ),
    """WITH u AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents),
o AS (SELECT doc_id, u, sum(len(u)) OVER (ORDER BY md5(doc_id || '|42') ROWS UNBOUNDED PRECEDING) - len(u) AS start FROM u)
SELECT doc_id, unnest(range(1, len(u) + 1))::INTEGER AS chapter, (start + unnest(range(1, len(u) + 1)))::BIGINT AS global_id,
  length(unnest(u))::INTEGER AS n_chars FROM o""",
)
_CHAPTERS_SQL = f"""{FILES_SQL},
u AS (SELECT file_name, string_split(text, chr(10)) AS u FROM files),
o AS (SELECT file_name, u, sum(len(u)) OVER (ORDER BY md5(file_name || '|42') ROWS UNBOUNDED PRECEDING) - len(u) AS start FROM u),
c AS (SELECT file_name, unnest(range(1, len(u) + 1)) AS chapter, start + unnest(range(1, len(u) + 1)) AS global_id, unnest(u) AS text FROM o),
chapters AS (SELECT format('{{:04d}}_Edika_{{}}_{{}}_{{:03d}}.txt', global_id::BIGINT, split_part(file_name, '_', 1),
  replace(split_part(file_name, '_', 2), '.txt', ''), chapter) AS name, text FROM c)"""
register(
    "chapter_files",
    lambda s, f: ingest.chapter_corpus(book_files(documents(s, f)).select("file_name", "text"), delimiter="\n"),
    f"WITH {_CHAPTERS_SQL} SELECT name, text FROM chapters",
)
register(
    "pad_names",
    lambda s, f: read_table(s, f, "lineitem").select(
        "l_orderkey", "l_linenumber", names.padded(F.col("l_partkey"), 4).alias("id4"), names.padded(F.col("l_suppkey"), 3).alias("id3")
    ),
    "SELECT l_orderkey, l_linenumber, format('{:04d}', l_partkey) AS id4, format('{:03d}', l_suppkey) AS id3 FROM lineitem",
)
register(
    "parse_names",
    lambda s, f: mixed_files(read_table(s, f, "documents")).select(
        "file_name", names.trailing_level(F.col("file_name")).alias("level"), names.leading_title(F.col("file_name")).alias("title")
    ),
    f"""WITH {MIXED_SQL}, p AS (SELECT file_name, CASE WHEN contains(file_name, 'a1') THEN instr(file_name, 'a1')
  WHEN contains(file_name, 'b1') THEN instr(file_name, 'b1') ELSE 1 END AS p FROM mixed)
SELECT file_name, substring(file_name, p, length(file_name) - 4 - p + 1) AS level,
  CASE WHEN p > 1 THEN substring(file_name, 1, p - 2) ELSE substring(file_name, 1, length(file_name) - 1) END AS title FROM p""",
)
register(
    "label_by_name",
    lambda s, f: ingest.label_by_name(mixed_files(read_table(s, f, "documents")).withColumnRenamed("file_name", "name")),
    f"WITH {MIXED_SQL} SELECT doc_id, file_name AS name, CASE WHEN contains(file_name, 'a1') THEN 0 ELSE 1 END::INTEGER AS label"
    " FROM mixed WHERE contains(file_name, 'a1') OR contains(file_name, 'b1')",
)
_TITLE_SQL = "CASE WHEN label <> 2 THEN split_part(name, '_', 3) || '_' || split_part(name, '_', 4) ELSE 'CTDC' END"


def named(spark: SparkSession, folder: str) -> DataFrame:
    return named_documents(read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"))


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    return groups.with_groups(named(spark, folder))


register(
    "book_titles",
    lambda s, f: named(s, f).select("name", names.title(F.col("name")).alias("title")),
    f"WITH {NAMED_SQL} SELECT name, {_TITLE_SQL} AS title FROM named",
)
register(
    "bare_titles",
    lambda s, f: named(s, f).select("name", names.bare_title(F.col("name"), strict=True).alias("title")),
    f"WITH {NAMED_SQL} SELECT name, CASE WHEN label = 2 THEN 'CTDC' ELSE split_part(name, '_', 4) END AS title FROM named",
)
register(
    "titles_distinct",
    lambda s, f: named(s, f).select(names.title(F.col("name")).alias("title")).distinct(),
    f"WITH {NAMED_SQL} SELECT DISTINCT {_TITLE_SQL} AS title FROM named",
)


def _listed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    keys = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"))
    return read_table(spark, folder, "documents").select("doc_id", "source", "n_chars"), keys


register(
    "allow_list",
    lambda s, f: ingest.allow_names(*_listed(s, f), "doc_id"),
    "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
)
register(
    "deny_list",
    lambda s, f: ingest.deny_names(*_listed(s, f), "doc_id"),
    "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)",
)


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    df = named_documents(read_table(spark, folder, "documents"))
    books, third = df.where("label <> 2"), df.where("label = 2")
    return ingest.labelled_corpus(books, third, cap=THIRD_CLASS_CAP)


register(
    "corpus_union_capped",
    _corpus,
    f"""WITH {NAMED_SQL} SELECT label::INTEGER AS label, name, text FROM named WHERE label <> 2
UNION ALL (SELECT 2 AS label, name, text FROM named WHERE label = 2 ORDER BY name LIMIT 230)""",
)
register(
    "named_texts",
    lambda s, f: named_documents(read_table(s, f, "documents")).select("name", "text"),
    f"WITH {NAMED_SQL} SELECT name, text FROM named",
)
register(
    "features_with_text",
    lambda s, f: read_table(s, f, "labels").join(read_table(s, f, "documents").select("doc_id", "text"), "doc_id", "left"),
    "SELECT doc_id, quality, toxic, text FROM labels LEFT JOIN (SELECT doc_id, text FROM documents) USING (doc_id)",
)

# --- language identification --------------------------------------------------------------------------

LANGUAGES = ("de", "en", "es", "fr")
_CLEAN = "trim(regexp_replace(lower({}), '[^\\p{{L}}]+', ' ', 'g'))"


def _grams_sql(name: str, source: str, keys: str) -> str:
    sizes = " UNION ALL ".join(
        f"SELECT {keys}, unnest(list_transform(range(1, greatest(length(t) - {n} + 2, 1)), lambda i: substring(t, i, {n}))) AS gram FROM {name}_t"
        for n in langid.GRAM_SIZES
    )
    return f"{name}_t AS (SELECT *, ' ' || c || ' ' AS t FROM {source} WHERE c <> ''), {name} AS ({sizes})"


PROFILES_SQL = f"""
labelled AS (SELECT lang, {_CLEAN.format('text')} AS c FROM documents),
{_grams_sql('lg', 'labelled', 'lang')},
lgc AS (SELECT lang, gram, count(*) AS n FROM lg GROUP BY ALL),
profiles AS (SELECT lang, gram, n, floor(ln((n::DOUBLE / total::DOUBLE) / 1e-6::DOUBLE) * 1000000 + 0.5::DOUBLE)::BIGINT AS weight
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM lgc)
  WHERE place <= {langid.PROFILE_SIZE})"""
DETECT_SQL = f"""
lines AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS unit_id, unnest(u) AS unit FROM
  (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u FROM documents)),
clean AS (SELECT doc_id, unit_id, {_CLEAN.format('unit')} AS c FROM lines),
{_grams_sql('ug', 'clean', 'doc_id, unit_id')},
sums AS (SELECT doc_id, unit_id, lang, sum(weight)::BIGINT AS score FROM ug JOIN profiles USING (gram) GROUP BY ALL),
found AS (SELECT doc_id, unit_id, arg_max(lang, struct_pack(score, o := -ascii(lang) * 1000 - ascii(lang[2]))) AS lang_pred, max(score) AS score FROM sums GROUP BY ALL)"""


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_profiles(documents(spark, folder))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.units(documents(spark, folder), split_lines(F.col("text")), ["doc_id"])


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    return langid.detect(_lines(spark, folder), _profiles(spark, folder), LANGUAGES, ["doc_id", "unit_id"], "unit")


register("language_profiles", _profiles, f"WITH {PROFILES_SQL} SELECT lang, gram, n, weight FROM profiles")
register(
    "language_detect",
    _detected,
    f"WITH {PROFILES_SQL}, {DETECT_SQL} SELECT doc_id, unit_id::INTEGER AS unit_id, lang_pred, score FROM found",
)
_LEARNT, _SCORED = "md5(doc_id || '|42') < '8'", "md5(doc_id || '|42') >= '8'"


def _accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of one half of the documents, by hash, under profiles of the other half."""
    docs = documents(spark, folder)
    half = ranking.seeded_key("doc_id") < "8"
    lines = ingest.units(docs.where(~half), split_lines(F.col("text")), ["doc_id"])
    found = langid.detect(lines, langid.language_profiles(docs.where(half)), LANGUAGES, ["doc_id", "unit_id"], "unit")
    right = F.count_if(F.col("lang") == F.col("lang_pred")).alias("n_right")
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), right)


register(
    "language_accuracy",
    _accuracy,
    f"WITH {PROFILES_SQL.replace('AS c FROM documents)', f'AS c FROM documents WHERE {_LEARNT})')},"
    f" {DETECT_SQL.replace('AS u FROM documents)', f'AS u FROM documents WHERE {_SCORED})')}"
    " SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = lang_pred) AS n_right FROM found JOIN documents USING (doc_id) GROUP BY lang",
)
register(
    "language_lines",
    lambda s, f: _detected(s, f).where(F.col("lang_pred") == "fr").select("doc_id", "unit_id"),
    f"WITH {PROFILES_SQL}, {DETECT_SQL} SELECT doc_id, unit_id::INTEGER AS unit_id FROM found WHERE lang_pred = 'fr'",
)
register(
    "language_kept_text",
    lambda s, f: langid.keep_language(documents(s, f), _profiles(s, f), LANGUAGES, "fr", "doc_id", split_lines(F.col("text"))),
    f"""WITH {PROFILES_SQL}, {DETECT_SQL}
SELECT doc_id, string_agg(unit, '' ORDER BY unit_id) AS text FROM lines JOIN found USING (doc_id, unit_id) WHERE lang_pred = 'fr' GROUP BY doc_id""",
)
register(
    "reassemble_text",
    lambda s, f: ingest.reassembled(_lines(s, f), "doc_id", "unit_id", "unit"),
    "SELECT doc_id, text FROM documents",
)

# --- groups, folds, roles -----------------------------------------------------------------------------

_G = f"{NAMED_SQL}, {GROUPED_SQL}"
register(
    "title_groups",
    lambda s, f: groups.title_groups(named(s, f)),
    f'WITH {_G} SELECT title, grp::INTEGER AS "group" FROM title_group',
)
register(
    "round_robin_groups",
    lambda s, f: groups.round_robin_groups(named(s, f)).select("name", "group"),
    f'WITH {_G} SELECT name, grp::INTEGER AS "group" FROM turn',
)
register(
    "document_groups",
    lambda s, f: grouped(s, f).select("doc_id", "name", "label", "group"),
    f'WITH {_G} SELECT doc_id, name, label, "group" FROM grouped',
)
register(
    "groups_per_label",
    lambda s, f: grouped(s, f).select("label", "group").distinct(),
    f'WITH {_G} SELECT DISTINCT label, "group" FROM grouped',
)
register(
    "group_labels",
    lambda s, f: groups.group_labels(_slim(s, f)),
    f'WITH {_G} SELECT "group", max(label) AS label FROM grouped GROUP BY ALL',
)
register(
    "group_titles",
    lambda s, f: groups.group_titles(_slim(s, f)),
    f'WITH {_G} SELECT "group", arg_max(title, name) AS title FROM grouped GROUP BY ALL',
)
register(
    "group_label_conflicts",
    lambda s, f: groups.label_conflicts(
        read_table(s, f, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderstatus").alias("label"))
    ),
    'SELECT o_custkey AS "group", count(DISTINCT o_orderstatus) AS n_labels FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1',
)
register(
    "documents_with_group_names",
    lambda s, f: groups.lookup_by_group(
        _slim(s, f).select("doc_id", "name", "group"), groups.group_labels(_slim(s, f)), groups.group_titles(_slim(s, f))
    ),
    f"""WITH {_G} SELECT doc_id, name, "group", label, title FROM (SELECT doc_id, name, "group" FROM grouped)
LEFT JOIN (SELECT "group", max(label) AS label, arg_max(title, name) AS title FROM grouped GROUP BY ALL) USING ("group")""",
)
register(
    "class_c_dropped",
    lambda s, f: grouped(s, f).where("label <> 2").select("doc_id", "label", "group"),
    f'WITH {_G} SELECT doc_id, label, "group" FROM grouped WHERE label <> 2',
)
FOLDS_SQL = """
folds AS (SELECT (row_number() OVER (PARTITION BY label ORDER BY "group") - 1)::INTEGER AS fold, label, "group"
  FROM (SELECT DISTINCT label, "group" FROM grouped)),
roled AS (SELECT doc_id, name, grouped."group", grouped.label, folds.fold FROM grouped JOIN folds USING ("group"))"""
BINARY_FOLDS_SQL = FOLDS_SQL.replace("FROM grouped)", "FROM grouped WHERE label IN (0, 1))")
_F = f"{_G}, {FOLDS_SQL}"


def _slim(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, name, label, group`` of every document, shared by the queries of a session."""
    rows = lambda: grouped(spark, folder).select("doc_id", "name", "label", "group")
    return kept(spark, "group rows", f"{folder}/documents.parquet", rows)


def _folds(spark: SparkSession, folder: str) -> DataFrame:
    """``fold, label, group``, shared by the queries of a session; its written size decides whether a join broadcasts it."""
    return kept(spark, "folds", f"{folder}/documents.parquet", lambda: groups.create_folds(_slim(spark, folder)))


register(
    "group_folds",
    lambda s, f: _folds(s, f),
    f'WITH {_F} SELECT fold, label, "group" FROM folds',
)
register(
    "binary_folds",
    lambda s, f: groups.create_folds(_slim(s, f), labels=(0, 1)),
    f'WITH {_G}, {BINARY_FOLDS_SQL} SELECT fold, label, "group" FROM folds',
)
register(
    "fold_tuples",
    lambda s, f: groups.fold_tuples(_folds(s, f)),
    f"""WITH {_F} SELECT fold, max("group") FILTER (WHERE label = 0) AS group_0, max("group") FILTER (WHERE label = 1) AS group_1,
  max("group") FILTER (WHERE label = 2) AS group_2 FROM folds GROUP BY fold""",
)
register(
    "train_validation_rows",
    lambda s, f: groups.train_validation_split(_slim(s, f), _folds(s, f), 1).select("doc_id", "fold", "role"),
    f"WITH {_F} SELECT doc_id, fold, CASE WHEN fold = 1 THEN 'val' ELSE 'train' END AS role FROM roled WHERE fold <> 0",
)
register(
    "three_way_rows",
    lambda s, f: groups.three_way_split(_slim(s, f), _folds(s, f), 1).select("doc_id", "role"),
    f"WITH {_F} SELECT doc_id, CASE fold WHEN 1 THEN 'val' WHEN 0 THEN 'test' ELSE 'train' END AS role FROM roled",
)
register(
    "fold_group_rows",
    lambda s, f: _slim(s, f).join(_folds(s, f).where("fold = 1"), "group", "left_semi").select("doc_id", "group"),
    f'WITH {_F} SELECT doc_id, "group" FROM roled WHERE fold = 1',
)
register(
    "rows_outside_fold",
    lambda s, f: _slim(s, f).join(_folds(s, f).where("fold in (0, 1)"), "group", "left_anti").select("doc_id", "group"),
    f'WITH {_F} SELECT doc_id, "group" FROM roled WHERE fold NOT IN (0, 1)',
)
register(
    "fold_sizes",
    lambda s, f: groups.fold_sizes(_slim(s, f), _folds(s, f)),
    f"""WITH {_F}, c AS (SELECT fold, count(*) AS n_val FROM roled WHERE fold <> 0 GROUP BY fold)
SELECT fold, n_val, (SELECT sum(n_val) FROM c)::BIGINT - n_val AS n_train FROM c""",
)
register(
    "folds_but_one",
    lambda s, f: _folds(s, f).where("fold not in (0, 1)"),
    f'WITH {_F} SELECT fold, label, "group" FROM folds WHERE fold NOT IN (0, 1)',
)
register(
    "training_groups",
    lambda s, f: groups.training_groups(_folds(s, f), 1),
    f'WITH {_F} SELECT DISTINCT "group" FROM folds WHERE fold NOT IN (0, 1)',
)
register(
    "group_label_union",
    lambda s, f: ranking_union(s, f),
    f'WITH {_G} SELECT "group", max(label) AS label FROM grouped GROUP BY ALL',
)
register(
    "stratified_group_folds",
    lambda s, f: groups.stratified_group_folds(_slim(s, f), 7).select("group", "fold"),
    f"""WITH RECURSIVE {_G},
counts AS (SELECT "group" AS grp, {", ".join(f"count(*) FILTER (label = {i}) AS v{i}" for i in (0, 1, 2))} FROM grouped GROUP BY ALL),
totals AS (SELECT sum(v0) AS t0, sum(v1) AS t1, sum(v2) AS t2, t0 + t1 + t2 AS t FROM counts),
placed AS (SELECT *, row_number() OVER (ORDER BY 3 * (v0 * v0 + v1 * v1 + v2 * v2) - (v0 + v1 + v2) ** 2 DESC, v0, v1, v2, grp) AS i FROM counts),
walk AS (
SELECT 0::BIGINT AS i, NULL::INTEGER AS grp, 0::BIGINT AS pick, [0::BIGINT FOR g IN range(7)] AS s0, [0::BIGINT FOR g IN range(7)] AS s1, [0::BIGINT FOR g IN range(7)] AS s2
UNION ALL
SELECT i, grp, pick, {", ".join(f"[s{i}[g] + CASE WHEN g = pick THEN v{i} ELSE 0 END FOR g IN range(1, 8)]" for i in (0, 1, 2))}
FROM (SELECT placed.*, s0, s1, s2, list_sort([struct_pack(spread := round({" + ".join(f"list_aggregate([s{i}[g] + CASE WHEN g = f THEN v{i} ELSE 0 END FOR g IN range(1, 8)], 'stddev_pop') * t / greatest(t{i}, 1)" for i in (0, 1, 2))}, 6),
n := s0[f] + s1[f] + s2[f], f := f) FOR f IN range(1, 8)])[1].f AS pick FROM walk JOIN placed ON placed.i = walk.i + 1 CROSS JOIN totals) AS step)
SELECT grp AS "group", (pick - 1)::INTEGER AS fold FROM walk WHERE i > 0""",
)


def ranking_union(spark: SparkSession, folder: str) -> DataFrame:
    """Group labels as the union of one dictionary per class, the later class winning."""
    rows = _slim(spark, folder)
    blocks = [
        rows.where(F.col("label") == label).select("group", "label", F.lit(label).alias("priority")).distinct() for label in (0, 1, 2)
    ]
    united = blocks[0].unionByName(blocks[1]).unionByName(blocks[2])
    return frequency.last_wins(united, "group", ["priority"])


# --- shuffles, folds, splits ----------------------------------------------------------------------------

_SHUFFLED = "row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id)"


def _doc_keys(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "lang")


register(
    "seeded_shuffle",
    lambda s, f: sampling.shuffled(_doc_keys(s, f), "doc_id"),
    f"SELECT doc_id, lang, {_SHUFFLED} AS position FROM documents",
)
register(
    "kfold_assign",
    lambda s, f: sampling.k_folds(_doc_keys(s, f), "doc_id"),
    f"SELECT doc_id, lang, (({_SHUFFLED} - 1) % 10)::INTEGER AS fold FROM documents",
)
register(
    "hash_folds",
    lambda s, f: sampling.hash_folds(_doc_keys(s, f), "doc_id"),
    "SELECT doc_id, lang, (('0x' || substring(md5(doc_id || '|42'), 1, 8))::BIGINT % 10)::INTEGER AS fold FROM documents",
)
register(
    "split_train_test",
    lambda s, f: sampling.train_test_split(_doc_keys(s, f), "doc_id"),
    f"SELECT doc_id, lang, CASE WHEN p > n - ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part"
    f" FROM (SELECT doc_id, lang, {_SHUFFLED} AS p, count(*) OVER () AS n FROM documents)",
)
register(
    "split_stratified",
    lambda s, f: sampling.stratified_split(_doc_keys(s, f), "doc_id", "lang"),
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
b AS (SELECT lang, floor(n * 0.2::DOUBLE) AS base, round(n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE), 9) AS rest,
  ceil((SELECT sum(n) FROM c) * 0.2::DOUBLE) AS want FROM c),
q AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
SELECT doc_id, lang, CASE WHEN p <= quota THEN 'test' ELSE 'train' END AS part
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS p FROM documents) JOIN q USING (lang)""",
)
register(
    "head_rows",
    lambda s, f: sampling.head(read_table(s, f, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20",
)
register(
    "class_capped",
    lambda s, f: ingest.capped(
        read_table(s, f, "documents").select("doc_id", "lang", "source"), ["doc_id"], 230, ["lang"]
    ),
    "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 230",
)


def _rank_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last purchase value so far, 0 before the first."""
    events = read_table(spark, folder, "events")
    blank = events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("rank")
    )
    filled = ranking.forward_fill(
        blank, "rank", ["ts", "event_id"], F.date_trunc("hour", "ts"), ["user_id"], start=0.0
    )
    return filled.select("event_id", "user_id", "rank")


register(
    "rank_forward_fill",
    _rank_fill,
    """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS rank FROM events""",
)

# --- table profiles -------------------------------------------------------------------------------------

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _describe_sql(columns) -> str:
    parts = []
    for c in columns:
        q = ", ".join(f"{sql_rounded(f'quantile_cont({c}, {p})')} AS p{round(p * 100)}" for p in profile.QUARTILES)
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, {sql_rounded(f'avg({c})')} AS mean, {sql_rounded(f'stddev_samp({c})')} AS std,"
            f" min({c})::DOUBLE AS min, {q}, max({c})::DOUBLE AS max FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def _describe(spark: SparkSession, folder: str) -> DataFrame:
    d = profile.describe(read_table(spark, folder, "lineitem"), _MEASURES)
    return d.select("column", "count", *[rounded(c).alias(c) for c in ("mean", "std", "p25", "p50", "p75")], "min", "max")


register("describe_table", _describe, _describe_sql(_MEASURES))
register(
    "class_distribution",
    lambda s, f: profile.class_distribution(read_table(s, f, "lineitem"), "l_returnflag"),
    "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
register(
    "table_shape",
    lambda s, f: profile.table_shape(read_table(s, f, "lineitem")),
    "SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS n_columns",
)


def _histogram_sql(columns) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS \"column\", b::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(10)) AS b) LEFT JOIN"
            f" (SELECT least(floor(({c}::DOUBLE - lo) / (hi - lo) * 10), 9) AS b, count(*) AS n FROM lineitem,"
            f" (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem) GROUP BY 1) USING (b)"
        )
    return " UNION ALL ".join(parts)


register(
    "histograms",
    lambda s, f: profile.histograms(read_table(s, f, "lineitem"), _MEASURES),
    _histogram_sql(_MEASURES),
)
