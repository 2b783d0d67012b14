"""Registered queries of this subpackage and, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrade.llm import ann, audit, bpe, chat, forced, langid, linededup, merkle, minhash, packing, sharding, simhash, suffixdedup
from textgrade.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 8
RANKS, WORDS = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"  # vocabulary files


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two turns hold control strings, as read back."""
    planted = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digests(chat.format_chat(turns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that stood earlier."""
    out = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", sha.alias("kept_sha256"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    out = sharding.kd_shards(docs, sharding.default_dimensions(), shards=SHARDS)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op4_learned_partitions_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of passages that stand in a document with a smaller id."""
    out = suffixdedup.dedup_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS)))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return minhash.fingerprints_and_edits(read_table(spark, sf_dir, "documents"))


def op11_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by fragments between forced boundaries and decoded again."""
    return forced.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; in one of five texts capitals were changed since."""
    fields = [merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in merkle.PARTS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(read_table(spark, sf_dir, "documents"), F.when(changed, merkle.leaf_digest(*fields))).audit()


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in all 120 orders."""
    return audit.audit(audit.mask_counts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_line_dedup": op2_line_dedup,
    "op3_kd_sharding": op3_kd_sharding,
    "op4_learned_partitions_ann": op4_learned_partitions_ann,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_crf_language_id": op8_crf_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_fingerprints": op10_minhash_fingerprints,
    "op11_forced_boundary_bpe": op11_forced_boundary_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

_ESCAPED = "replace(text, chr(92), chr(92) || chr(92))"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

SQL: dict[str, str] = {
    "op1_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, {_ESCAPED} AS body, {_ESCAPED.replace("text", "role")} AS name,
    row_number() OVER w = 1 OR lag(role) OVER w <> role AS opens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN opens THEN length(name) + {len(chat.START) + len(chat.MESSAGE) + len(chat.END)}
    ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op2_line_dedup": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, pos, lead(line, {linededup.RUN - 1}) OVER w AS final, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN CURRENT ROW AND {linededup.RUN - 1} FOLLOWING) AS gram FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), repeated AS (
  SELECT doc_id, pos FROM windows WHERE final IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) > 1
), runs AS (
  SELECT doc_id, pos, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {linededup.RUN}, 0) AS opens FROM repeated
), gone AS (
  SELECT DISTINCT s.doc_id, s.i FROM solid s JOIN repeated r ON s.doc_id = r.doc_id AND s.pos BETWEEN r.pos AND r.pos + {linededup.RUN - 1}
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT k.doc_id, n_lines, n_removed, coalesce(r.n, 0) AS n_runs, sha256(k.text) AS kept_sha256
FROM kept k LEFT JOIN (SELECT doc_id, count(*) FILTER (opens) AS n FROM runs GROUP BY doc_id) r ON k.doc_id = r.doc_id""",
}


def _merkle_sql(levels: int = 8) -> str:
    """Trees of at most ``16 ** levels`` leaves, level by level; CRC-32 bit by bit, for there is no function."""
    field = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in merkle.PARTS) + ")"
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    bits = "list_transform(range(8 * length(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"  # fixed value: the polynomial

    def tree(name: str, base: str) -> str:
        """Levels ``name_0`` .. over ``base (tree, idx, h)``: siblings of each node and, at the end, its root."""
        out = f"{name}_0 AS (SELECT tree, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM {base})"
        for k in range(levels):
            out += f""", {name}_r{k} AS (SELECT *, string_agg(h, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}_{k}),
{name}_{k + 1} AS (SELECT tree, idx // 16 AS idx, CASE WHEN n > 1 THEN sha256(first(run)) ELSE first(h) END AS h, (n + 15) // 16 AS n
  FROM {name}_r{k} GROUP BY tree, idx // 16, n)"""
        return out

    def path(name: str, k: int) -> tuple[str, str]:
        before = f"substr({name}{k}.run, 1, 64 * ({name}{k}.idx % 16)::INTEGER)"
        after = f"substr({name}{k}.run, 64 * ({name}{k}.idx % 16)::INTEGER + 65)"
        return before, after

    def climb(name: str, source: str, key: str, idx: str) -> str:
        """Siblings and folded digest of each row of ``source``, a level at a time."""
        out, last = "", source
        for k in range(levels):
            before, after = path("t", k)
            out += f""", {name}_c{k} AS (SELECT s.* EXCLUDE (proof, folded),
  CASE WHEN t{k}.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof,
  CASE WHEN t{k}.n > 1 THEN sha256({before} || folded || {after}) ELSE folded END AS folded
  FROM {last} s JOIN {name}_r{k} t{k} ON t{k}.tree = s.{key} AND t{k}.idx = s.{idx} // {16**k})"""
            last = f"{name}_c{k}"
        return out

    return f"""
WITH docs AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf.replace('text', lower).replace(lower + '::VARCHAR', lower)} END AS changed FROM documents),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM docs),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM numbered),
leaves AS (SELECT tree, idx, leaf AS h FROM rows_), {tree("low", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS idx, h FROM low_{levels}), {tree("top", "subroots")},
start AS (SELECT doc_id, leaf, tree, idx, 0 AS one, '' AS proof, coalesce(changed, leaf) AS folded FROM rows_)
{climb("low", "start", "tree", "idx")}{climb("top", f"low_c{levels - 1}", "one", "tree")}
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
FROM top_c{levels - 1} c JOIN subroots s ON s.idx = c.tree, top_{levels} r"""


SQL["op12_merkle_manifest"] = _merkle_sql()
SQL["op13_filter_audit"] = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
marked AS (SELECT doc_id, part, [len(w) < {audit.MIN_WORDS}, 100 * len(list_distinct(w)) < {audit.DISTINCT} * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.UPPER} * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM words),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marked LEFT JOIN said USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
gone AS (SELECT part, filter_order, n, good, toxic, fails,
    coalesce(list_min(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN fails[i] THEN instr(filter_order, chr((64 + i)::INTEGER)) END),
      lambda x: x IS NOT NULL)), 6) AS goes FROM masks, orders),
steps AS (SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS filter,
    sum(n) FILTER (goes > step) AS kept, sum(n) FILTER (goes = step) AS removed,
    sum(n) FILTER (goes < step AND fails[ascii(substr(filter_order, step::INTEGER, 1)) - 64]) AS redundant,
    sum(n) FILTER (fails[ascii(substr(filter_order, step::INTEGER, 1)) - 64] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (goes = step) AS good_lost, sum(toxic) FILTER (goes = step) AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM steps"""
