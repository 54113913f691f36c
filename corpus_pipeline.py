"""The corpus pipeline: toxicity, quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; labels
come from the input tables. A document's row is kept as it is, unless a stage removes passages from its text: then text
holds the kept words, joined by one space, and n_chars their characters. Documents that lose every word go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import minhash, packing, quality, substring, toxicity
from larkspur.llm.common import held, materialize, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def settled(result: DataFrame, before: set[str]) -> DataFrame:
    """result as a table in the shared folder; the tables made for it since before go."""
    out = materialize(result)
    release(before | {out.larkspur_path})
    return out


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity threshold rejects.

    Null and empty texts have no features and are judged by the bias alone, which keeps them. Equal texts have equal scores, so
    repeated rows stay or go together; a score at the threshold rejects. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the base limits or a learned rule.

    Null, empty and very short texts fail the base limits and go. Repeated rows stay or go together; a value on a
    learned threshold fulfils it. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.verdict(F.col("text"), rules)["kept"])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-duplicates.

    Documents without words are in no group and stay; so does every document with a null id. Rows that repeat an id
    stay or go with it. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    before = held()
    dropped = settled(minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), before)
    return docs.join(dropped, "doc_id", "left_anti")


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that stand in an earlier document, and documents of which nothing is left.

    Texts without such a passage stay as they are, null and empty ones, too; so does every document with a null id. Each of
    several rows of one id is cut on its own. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    before = held()
    cut = settled(substring.remove_repeats(docs).where("n_removed > 0").select("doc_id", "text_hash", "kept_text").distinct(), before)
    found = docs.withColumn("text_hash", F.xxhash64("text")).join(cut, ["doc_id", "text_hash"], "left").where(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
    whole = F.col("kept_text").isNull()
    return found.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 1024 ids; one row per piece.

    Null and empty texts are the end id alone. Repeated rows are packed one by one. An empty table gives no rows.
    """
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("packing", packing_stage),
]

#: Learned scores, similarity classes and tokens are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written as Parquet and read again by the next one."""
    docs, before = table(spark, sf_dir, "documents"), held()
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), before)
    return STAGES[-1][1](spark, docs, sf_dir)
