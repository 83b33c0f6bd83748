"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Nulls, empty texts and
repeated rows are handled as the operators' docstrings say; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm.common import crc_fold
from semblance.llm.compact_windows import duplicate_passages, without_passages
from semblance.llm.language_crf import fit_crf, in_learned_languages
from semblance.llm.ngram_join import near_duplicates, one_of_each
from semblance.llm.packing import pack_documents
from semblance.llm.tiling import without_contaminated
from semblance.session import discard, kept

#: A text whose most probable language has a smaller mean marginal over its words is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no learned language explains."""
    model = fit_crf(docs.select("doc_id", "text", "lang").where(crc_fold("doc_id", 3) != 1))
    return in_learned_languages(docs, model, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of five-word shingles at 0.8 hold together."""
    return one_of_each(docs, near_duplicates(docs, n=5, percent=80))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; texts left without words go."""
    left = without_passages(docs, duplicate_passages(docs, n=5, least=50, percent=80))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a row for each piece, with its token ids' checksum."""
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("leaks", leaks), ("packed", packed)]

#: Iterated tiling, learned models and tokenizers are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """The last stage's rows. resume: a name for this run's tables in the shared folder; a run of the same name after a
    failure takes up the stages that are done. Such tables are the caller's to delete, other ones drop_kept()'s."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, kept(stage(spark, docs, sf_dir), f"{resume}/{name}" if resume else None)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
