"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_edits
from .jaccard_join import jaccard_components
from .packing import pack
from .pii import pii_report
from .suffix_dedup import remove_repeats
from .token_count import token_counts
from .toxicity import held_out, learn, score_toxicity
from .warc import archive_and_index

#: The setting that holds the key of the pseudonyms; Spark itself redacts settings with this last word.
KEY_SETTING = "spark.histospark.pseudonym.secret"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the session's setting; without one, that of trials, which protects nothing."""
    return spark.conf.get(KEY_SETTING, None) or "only for trials"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), WORD_BPE)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), WORD_BPE)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_and_index(_table(spark, sf_dir, "pages"), min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_order")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), WORD_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """,
}
