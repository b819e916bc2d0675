"""A corpus pipeline: toxicity, near-dedup, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; results are
written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import encode_documents
from quern.llm.common import scratch, table, written
from quern.llm.mixing import replicate, shuffled
from quern.llm.near_copies import near_components
from quern.llm.secrets import redact
from quern.llm.toxicity import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; all others stay as they are."""
    scored = score_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("_toxicity.predicted = 0").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-copy group stays: five words a shingle, Jaccard similarity 0.8 or more, transitively.

    It is the row with the smallest doc_id, a row without doc_id only where the group has no other. SimHash fingerprints link first, by
    op2's pigeonring filtering, and their pairs are confirmed; what its budget of 4 bits misses is found by an exact way between the groups it leaves.
    """
    docs = docs.select(*COLUMNS)
    # Nulls and values are written apart, each value with its length.
    texts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in COLUMNS]
    row = F.unhex(F.md5(F.concat(*texts)))
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("m")
    with scratch(spark) as keep:
        named = near_components(docs.withColumn("row", row)).join(docs.select("doc_id", row.alias("row")).distinct(), "row")
        kept = keep(written(named.groupBy("component").agg(best).select("m.row"), "kept"))
    return docs.withColumn("row", row).join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes [SECRET]; n_chars follows the text."""
    import public_tokenizers

    return redact(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or vanish by the Poisson counts of their sources' weights."""
    return shuffled(replicate(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each copy."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash_dedup", dedup), ("secret_scan", secrets), ("poisson_mix", mixing), ("bpe", tokens)]
#: Hashes, fingerprints and models of these stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
