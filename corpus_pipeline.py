"""The corpus pipeline: language ID, quality rules, near-duplicate removal, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the rows that stay: with the columns of ``documents``, but for the
last, which returns the encoded documents. Each result is written as Parquet and
read again as the next stage's input. Duplicates are texts linked by sets of
five-word shingles with a similarity of 0.8 or more; the smallest doc_id stays.
Rows without text go in the first two stages: in the first if their source is null
too (a source's language stands for them otherwise), else in the second, since they have no words. Rows that
repeat a doc_id stay or go together in the join and in mixing. Columns of the input keep their
values whatever their names. Every stage of an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import bpe, jaccard_join, language_id, mixing, quality_rules, token_files
from tabweave.llm.common import durable, small_or_not, table
from tabweave.llm.queries import tokenizer_file

#: Columns that the operators read by name.
NEEDED = ("doc_id", "text", "lang", "source")


def kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``judge`` marks ``kept``, with their own columns, which it sees under other names unless it needs them."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in NEEDED}
    judged = judge(docs.withColumnsRenamed(own))
    return judged.filter("kept").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose fused evidence names a language; sources stand in for hosts."""
    return kept(docs, lambda rows: language_id.identify(rows, language_id.fit(rows), F.col("text"), host=F.col("source")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and the threshold table."""
    return kept(docs, quality_rules.judge)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component; documents without words or id all stay, and so do all rows of a doc_id that stays."""
    groups = jaccard_join.components(docs, words=5, num=80, den=100)
    extra = durable(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(small_or_not(extra), "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the probabilities calibrated to the target weights."""
    return kept(docs, mixing.mix)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the ids (little-endian unsigned 32 bits), their number and digests."""
    out = bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), keys=("doc_id", "source", "lang"))
    return out.select("doc_id", "source", "lang", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language ID", known_language), ("quality rules", quality), ("n-gram Jaccard join", one_of_each_group), ("mixing", mixed), ("BPE encoding", encoded)]

#: Language ID, the join and the encoding are not expressible in SQL; tests/llm/test_pipeline.py holds the rows against plain versions of the stages after language ID,
#: and language ID has a plain version in test_stages.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        folder = token_files.scratch_folder(spark, f"pipeline-{k}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
