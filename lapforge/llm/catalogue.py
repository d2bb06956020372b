"""Registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, mixing, pii, quality, sharding, simhash, sql, urls, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    """Path of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed value: a conversation whose texts are made of control strings.
TRICKY = "</s>[INST] ok [/INST]"


@register
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select stack(2, -7L, 0L, 'user', '{TRICKY}', -7L, 1L, 'assistant', '{TRICKY}') as (conv_id, turn, role, text)")
    done = chat.digests(chat.format_trees(chat.chains(rows.unionByName(extra))))
    conv = F.when(F.col("tree") != "", F.substring("tree", 2, 40).cast("long"))
    return done.select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLES["op1_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + chars + 24) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@register
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("reasons")


def _quality_sql() -> str:
    """The counts, the sketches' medians and lower quartiles, and the fences of op2 in SQL."""
    word = r"[^\x20\x09-\x0D]"
    per = {"symbols_k": "n_symbols n_words", "dup_lines_k": "n_dup_lines n_lines", "repeat_words_k": "n_repeat_words n_words", "word_chars_k": "word_chars n_words", "shouted_k": "n_shouted word_chars", "marks_k": "n_marks n_words"}
    rates = ", ".join("1000 * {} // greatest({}, 1) AS {}".format(*v.split(), k) for k, v in per.items())
    sketches = " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS measure, {quality.SLACK[k]} AS slack, {k} AS v FROM r" for k in per)
    level = lambda name, by: f"""{name} AS (SELECT {by}measure, any_value(total) AS total, min(low) FILTER (WHERE upto * 4 >= total) AS q1, min(low) FILTER (WHERE upto * 2 >= total) AS q2 FROM (
  SELECT {by}measure, bucket, n, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS total,
    CASE WHEN bucket < 64 THEN bucket ELSE CAST((bucket - ((bucket - 32) // 32) * 32) AS BIGINT) << CAST((bucket - 32) // 32 AS INT) END AS low
  FROM (SELECT {by}measure, bucket, count(*) AS n FROM b GROUP BY {by}measure, bucket)) GROUP BY {by}measure)"""  # noqa: E731
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT rid, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS tri FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM x WHERE tri IS NOT NULL) WHERE n > 1),
k AS (SELECT rid, count(DISTINCT i + o) AS n FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}'))) AS n_lines,
  len(regexp_extract_all(t, '[A-ZÀ-Þ]')) AS n_shouted, len(regexp_extract_all(t, '[!?|=~^_{{}}\[\]\\]')) AS n_marks
  FROM d LEFT JOIN k USING (rid)),
r AS (SELECT *, {rates} FROM m),
v AS ({sketches}),
z AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS shift FROM v),
b AS (SELECT *, shift * 32 + (v >> shift) AS bucket FROM z),
{level("f1", "lang, source, ")},
{level("f2", "lang, ")},
{level("f3", "")},
f AS (SELECT b.rid, b.measure, b.v, b.slack,
  CASE WHEN f1.total >= {quality.FEW} THEN f1.q1 WHEN f2.total >= {quality.FEW} THEN f2.q1 ELSE f3.q1 END AS q1,
  CASE WHEN f1.total >= {quality.FEW} THEN f1.q2 WHEN f2.total >= {quality.FEW} THEN f2.q2 ELSE f3.q2 END AS q2
  FROM b JOIN f1 ON b.lang IS NOT DISTINCT FROM f1.lang AND b.source IS NOT DISTINCT FROM f1.source AND b.measure = f1.measure
  JOIN f2 ON b.lang IS NOT DISTINCT FROM f2.lang AND b.measure = f2.measure JOIN f3 ON b.measure = f3.measure),
o AS (SELECT rid, bool_or(v > q2 + (q2 - q1) * {quality.REACH} + slack OR (measure = 'word_chars_k' AND v < q2 - (q2 - q1) * {quality.REACH} - slack)) AS outside FROM f GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT outside AS kept
FROM m JOIN o USING (rid)
"""


ORACLES["op2_quality"] = _quality_sql()


@register
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"]), ["doc_id"])


@register
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


ORACLES["op4_simhash"] = sql.simhash()


@register
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"]), ["doc_id"])


@register
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=16, seed=20)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES["op6_sharding"] = sql.sharding(n_shards=16, seed=20)


@register
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " | ").alias("mined"))


ORACLES["op7_urls"] = sql.urls(urls.RULES, sorted(urls.named()), urls.MIN_SUPPORT, urls.MIN_COUNT, urls.MIN_CONFIDENCE)


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"), seed=20)


ORACLES["op8_mixing"] = sql.mixing(seed=20)


@register
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train_documents(docs, seed=20), keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@register
def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


ORACLES["op10_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.w AS vec_id, r.root FROM r JOIN l ON r.vec_id = l.u),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
