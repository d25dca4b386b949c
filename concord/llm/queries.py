"""Driver queries of the corpus operators and, where SQL can express them,
their oracles.  Each query applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table
from .common import saved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 1 benchmark decontamination -----------------------------------------

@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# --- 2 quality classifier ------------------------------------------------

@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import weak_quality

    return weak_quality.classify(read_table(spark, sf_dir, "documents"))


# --- 3 chat formatting ---------------------------------------------------

_EXTRA_TEXT = r"\### Assistant: </turn> ok"

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(role, '\', '\\'), '<|', '<\|') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(et) + length(er) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op3_chat_formatting", _CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_EXTRA_TEXT).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


# --- 4 quality rules -----------------------------------------------------

_RULES_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, string_split(t, '') AS cs FROM d),
g AS (SELECT r, i, ws[i:i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM n WHERE c > 1) GROUP BY r),
top AS (SELECT r, max(c) AS n FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r, x) GROUP BY r),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, coalesce(top.n, 0) AS top_word,
  length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, len(list_filter(cs, lambda x: lower(x) <> upper(x))) AS cased,
  len(list_filter(cs, lambda x: x <> lower(x))) AS upper_
  FROM w LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 4 * n_symbols > n_words OR (cased > 0 AND 2 * upper_ > cased) OR 2 * n_dup_lines > n_lines OR 10 * top_word > 3 * n_words
  OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 2 * letters < word_chars) AS kept FROM b
"""


@query("op4_quality_rules", _RULES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    # which rule came first depends on the measured order; verdicts do not
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).drop("rules_run", "rejected_by")


# --- 5 suffix-array dedup ------------------------------------------------

@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.digest(suffix_dedup.shared_spans(read_table(spark, sf_dir, "documents")))


# --- 6 language id -------------------------------------------------------

@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .common import fold

    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


# --- 7 language-model scoring --------------------------------------------

@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(read_table(spark, sf_dir, "documents"))


# --- 8 SimHash near-duplicates -------------------------------------------

@query("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- 9 token files -------------------------------------------------------

@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(read_table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path)


# --- 10 packing ----------------------------------------------------------

@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1).drop("ids")


# --- 11 hard-negative mining ---------------------------------------------

_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS "rank",
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 5
"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hard_negatives

    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(hard_negatives.integer_rows(vectors, 256, moved, F.col("vec_id") % 100 == 0))


# --- 12 substring dedup --------------------------------------------------

@query("op12_substring_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.digest(substring_dedup.without_repeats(read_table(spark, sf_dir, "documents")))


# --- 13 vector code compression ------------------------------------------

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part compared with every entry, round after round."""
    sql = f"""
WITH r AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT vec_id, p, v[p * w + 1:(p + 1) * w] AS v FROM r, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM r ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    distance = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        sql += f""",
a{k} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x.v) AS v, min({distance} * {entries} + b.e) AS m FROM x JOIN b{k} b ON b.p = x.p GROUP BY vec_id, x.p)"""
        if k < rounds:
            sql += f""",
u{k} AS (SELECT p, e, list(c ORDER BY i) AS v FROM (SELECT p, m % {entries} AS e, i, floor(sum(v[i + 1]) / count(*))::BIGINT AS c
  FROM (SELECT p, m, v, unnest(range(len(v))) AS i FROM a{k}) GROUP BY p, m % {entries}, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN u{k} u ON u.p = b.p AND u.e = b.e)"""
    return sql + f""",
f AS (SELECT vec_id, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN r USING (vec_id), h
"""


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ball_kmeans

    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = ball_kmeans.BallKMeans().encode(ball_kmeans.integer_vectors(vectors, 4096))
    digest = F.lit(None if books is None else books.sha256()).cast("string")
    return ball_kmeans.with_label_error(saved(coded, "vector-codes")).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
