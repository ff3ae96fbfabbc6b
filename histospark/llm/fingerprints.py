"""Exact document fingerprints: canonical text, two xxhash64 lanes, bytes compared inside equal buckets.

The canonical text is NFKC, case-folded, NFKC again, with each run of white space as one space and none at the ends. All
of it is in SQL functions: ICU, which Spark carries for its collations, is called by the SQL function ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import content_groups, hash_lanes
from .storage import numbered, stored

#: Documents whose ids share all but the lowest six bits are ordered together: at most 64 different ids.
DOC_BITS = 6
KEY_BITS = 10


def canonical(text: Column) -> Column:
    """The canonical form of a text; null as the empty text."""
    composed = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\s\x{85}\p{Z}]+", " "))


def _hex(content: Column) -> Column:
    one, two = hash_lanes(content)
    return F.lower(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))


def successors(keys: DataFrame) -> DataFrame:
    """For distinct long keys ``k``: the next larger one as ``next``; the smallest for the largest.

    Keys are ordered in blocks that share their high bits, and the blocks in the same way, until few are left; so no
    task sorts more than 2^KEY_BITS keys but the last, which has 4096 at most.
    """
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    if low is None:
        return keys.select("k", F.col("k").alias("next"))
    if (high >> KEY_BITS) - (low >> KEY_BITS) < 4096:
        blocks = keys.select(F.shiftright("k", KEY_BITS).alias("u")).distinct()
        above = blocks.select("u", F.coalesce(F.lead("u").over(Window.orderBy("u")), F.lit(low >> KEY_BITS)).alias("v"))
    else:
        above = successors(keys.select(F.shiftright("k", KEY_BITS).alias("k")).distinct()).toDF("u", "v")
    placed = keys.withColumn("u", F.shiftright("k", KEY_BITS))
    firsts = placed.groupBy("u").agg(F.min("k").alias("first")).select(F.col("u").alias("v"), "first")
    after = above.join(firsts, "v").select("u", "first")
    led = placed.withColumn("lead", F.lead("k").over(Window.partitionBy("u").orderBy("k")))
    return led.join(after, "u").select("k", F.coalesce("lead", "first").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (_id, _text) with _next, the text of the document that follows by id; the first follows the last.

    Texts move once, to the block of their id; besides, each block's first text moves to the block before. Where ids repeat, rows are sorted by id
    and a hash of their text first, and their places in that order stand for the ids, so that a block has 64 rows in any case.
    """
    docs, row = numbered(docs, "_id", "_text")
    if row:
        docs = stored(docs.select("_id", "_text").orderBy("_id", F.xxhash64("_text")).withColumn("_k", F.monotonically_increasing_id()), "ordered-rows")
    else:
        docs = docs.withColumn("_k", F.col("_id"))
    blocked = docs.withColumn("_block", F.shiftright("_k", DOC_BITS))
    order = Window.partitionBy("_block").orderBy("_k")
    placed = blocked.select(
        "*",
        F.lead("_text").over(order).alias("_lead"),
        F.lag(F.lit(1)).over(order).isNull().alias("_first"),
        F.lead(F.lit(1)).over(order).isNull().alias("_last"),
    )
    order_of_blocks = stored(successors(blocked.select(F.col("_block").alias("k")).distinct()), "block-order")
    guests = placed.where("_first").select(F.col("_block").alias("next"), F.col("_text").alias("_guest"))
    guests = guests.join(order_of_blocks, "next").select(F.col("k").alias("_block"), "_guest")
    return placed.join(guests, "_block", "left").select("_id", "_text", F.when(F.col("_last"), F.col("_guest")).otherwise(F.col("_lead")).alias("_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint, group_id (smallest id with the same canonical bytes), group_size of every document.

    Null and empty texts have the canonical text "". Rows that repeat an id are rows like any other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), canonical(F.col(text_col)).alias("_content"))
    groups = content_groups(rows, {"fingerprint": _hex(F.col("_content"))})
    return groups.select(F.col("_id").alias(id_col), "fingerprint", F.col("_keep").alias("group_id"), F.col("_size").alias("group_size"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by id. An exact digest knows equal from different only: likeness is 1 where fingerprints and canonical bytes are
    equal, else 0. Returns ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    group_id, group_size. Null texts count as empty. Documents without an id have no place in the order and are followed by
    themselves; rows with the same id follow each other in the order of a hash of their texts. An empty table gives an empty result; texts of
    any length are handled whole, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ordered = with_next(rows.where("_id IS NOT NULL"))
    paired = ordered.unionByName(rows.where("_id IS NULL").withColumn("_next", F.col("_text")))
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("_next", F.lit(1), half))
    both = paired.select("_id", "_text", "_next", edited.alias("_edited"))
    forms = both.select("*", canonical(F.col("_text")).alias("_content"), canonical(F.col("_edited")).alias("_ce"), canonical(F.col("_next")).alias("_cn"))
    measured = stored(
        forms.select(
            "_id",
            F.length("_text").cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            _hex(F.col("_ce")).alias("edited_fingerprint"),
            _hex(F.col("_content")).alias("fingerprint"),
            (F.col("_content") == F.col("_ce")).cast("double").alias("near_edited"),
            (F.col("_content") == F.col("_cn")).cast("double").alias("near_next"),
        ),
        "fingerprint-edits",
    )
    groups = fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("_i"), F.col("fingerprint").alias("_f"), "group_id", "group_size").distinct()
    on = measured["_id"].eqNullSafe(groups["_i"]) & (measured["fingerprint"] == groups["_f"])
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size"]
    return measured.join(groups, on).select(F.col("_id").alias(id_col), *names)
