"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import bpe, fingerprints, hard_negatives, jaccard_join, language_id, lm_scoring, mixing, nearest, quality_classifier, quality_rules, token_files, url_filter, vector_codes
from tabweave.llm.common import crc_mod, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (host: its source) and every page (with its markup and address), judged in one way."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model, null = language_id.fit(docs), F.lit(None).cast("long")
    of_docs = language_id.identify(docs, model, F.col("text"), host=F.col("source"), carry=["doc_id"])
    html, url = F.col("html"), F.col("url")
    of_pages = language_id.identify(pages, model, language_id.page_text(html), language_id.url_host(url), language_id.url_suffix(url), language_id.page_declared(html), carry=["page_id"])
    return of_docs.withColumn("page_id", null).unionByName(of_pages.withColumn("doc_id", null))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.scratch_folder(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end=2)
    return token_files.read(spark, folder)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))  # every seventh row's label is moved by one
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.followed(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(vector_codes.compress(table(spark, sf_dir, "embeddings")))


QUERIES = {"op1_jaccard_join": op1_jaccard_join, "op2_language_id": op2_language_id, "op3_mixing": op3_mixing, "op4_nearest": op4_nearest, "op5_quality_rules": op5_quality_rules, "op6_lm_scoring": op6_lm_scoring, "op7_bpe": op7_bpe, "op8_url_filter": op8_url_filter, "op9_quality_classifier": op9_quality_classifier, "op10_token_files": op10_token_files, "op11_hard_negatives": op11_hard_negatives, "op12_fingerprints": op12_fingerprints, "op13_vector_codes": op13_vector_codes}

_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in quality_rules.STOP_WORDS.values() for w in words}))

ORACLES = {
    "op3_mixing": f"WITH {mixing.sql('documents')} SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, kept FROM mixed",
    "op5_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
        i AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
        g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS n FROM i),
        r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
                     len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs
              FROM w LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce({" AND ".join(r.sql().replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)") for r in quality_rules.THRESHOLDS)}, false) AS kept
        FROM b""",
    "op11_hard_negatives": hard_negatives.sql(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"),
    "op13_vector_codes": vector_codes.sql(),
}
