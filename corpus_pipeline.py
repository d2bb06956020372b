"""A training corpus from documents: identify, deduplicate, mask, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents, in their order and whatever their names; columns beyond those that a stage
names ride along. Rows are judged one by one unless a stage says otherwise, so repeated
rows get equal results. An empty table gives an empty one from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import bpe, langid, mixing, pii, shingles
from lapforge.llm.catalogue import vocabulary
from lapforge.llm.scratch import scope
from lapforge.llm.text import hidden, quoted

SEED = 20
#: A document whose commonest language has a smaller share of its letters is rejected.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Documents with letters, at least half of them in one language.

    Null and empty texts and those without letters go; so does every document where no
    document outside the held-out fold has a text and a language to learn from. Ties
    between languages count for the first by code point. Columns named like the
    operator's own (lang_pred, score) stay: the prediction is made beside them.
    """
    work = docs.toDF(*(hidden(f"c{i}") if c not in ("doc_id", "text", "lang") else c for i, c in enumerate(docs.columns)))
    found = langid.identify(work, langid.train_documents(work, seed=SEED))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select(*work.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 with five-word shingles at a similarity of 0.8: of every component of
    near copies the document of least doc_id stays.

    SimHash's candidates are joined by those of bands, as 64 bits miss most pairs near
    0.8, and all are verified by their whole sets of shingles. Documents without words
    (null texts too) are copies of each other. Of repeated rows one stays. Documents
    without an id stay only where their component has no id at all.
    """
    return shingles.drop_duplicates(docs, similarity=0.8, words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Texts with personal data replaced by its kind; n_chars follows the text.

    Every row stays. A null text stays null, with a null n_chars; an empty one stays empty.
    """
    masked = pii.mask(docs)
    return masked.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else quoted(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Each document as often as the mix takes it; those that it leaves out go.

    A null source is a source of its own, a null text has size 0. Rows that agree in
    doc_id and text are taken alike.
    """
    work = docs.toDF(*(hidden(f"c{i}") if c not in ("doc_id", "text", "source") else c for i, c in enumerate(docs.columns)))
    mixed = mixing.mix(work, seed=SEED)
    return mixed.select(*work.columns, F.explode(F.array_repeat(F.lit(0), F.col("mix_times"))).alias(hidden("pass"))).select(*work.columns).toDF(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Token ids of every text, with digests of the ids and of what they decode to.

    A null or empty text has no tokens.
    """
    keep = ["doc_id", "lang", "source"]
    return bpe.digests(bpe.round_trip(docs, vocabulary(), keep=keep), [*keep, "ids"])


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Trained models and merges by rank are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote for itself goes after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
