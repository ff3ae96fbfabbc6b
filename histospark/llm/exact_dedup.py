"""Exact deduplication by content hash with byte comparison, in DataFrame expressions only.

Rows are grouped by a 128-bit hash of their content (two xxhash64 lanes with different seeds). Group sizes and
smallest ids are aggregated in two steps: first by (hash, salt), where the salt is taken from the id, then by hash.
The totals go back along the same salted key, so that the copies of one content, be they a third of all rows,
are spread over SALTS keys on the way in and on the way back. Only ids and hashes move for this.

Bytes are compared inside each group of two or more: the contents of such groups are reduced to the distinct ones,
map-side first, and a hash that is left with more than one is a collision. A bitmap of FILTER_BITS bits, half a megabyte
however many rows there are, keeps most contents without a copy out of that shuffle; the join behind it is exact. Colliding hashes, if any, are grouped once
more by hash and content, and that grouping replaces the other for their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import numbered, stored

SALTS = 128
FILTER_BITS = 1 << 22
KEY = ["_h1", "_h2"]


def hash_lanes(content: Column) -> tuple[Column, Column]:
    """Two 64-bit lanes of one 128-bit content hash; the second has another seed."""
    return F.xxhash64(content), F.xxhash64(F.lit("second lane"), content)


def whitespace_folded(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def content_groups(rows: DataFrame, extra: dict[str, Column] | None = None, lanes=hash_lanes) -> DataFrame:
    """Group ``rows`` (_id, _content, and _row where ids alone don't tell rows apart) by content.

    Returns one row per input row: _id, _row, _h1, _h2, _keep (smallest id of equal contents), _size (rows with that content),
    and the columns of ``extra``, which are computed from _id and _content in the same pass; with _row also _keep_row, the smallest number among the
    rows of _keep, so that one row of each content has both. Repeated ids are rows like any other. A null id is never the
    smallest unless a group has no other.
    """
    one, two = lanes(F.col("_content"))
    own = [c for c in ("_id", "_row") if c in rows.columns]
    salt = F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")
    hashed = rows.withColumns({"_h1": one, "_h2": two, "_salt": salt})
    narrow = stored(hashed.select(*own, *KEY, "_salt", *[c.alias(n) for n, c in (extra or {}).items()]), "content-keys")
    partial = narrow.groupBy(*KEY, "_salt").agg(_first(own).alias("_least"), F.count(F.lit(1)).alias("_n"))
    total = partial.groupBy(*KEY).agg(F.min("_least").alias("_all"), F.sum("_n").alias("_size"))
    kept = _named("_all", own)
    spread = stored(partial.join(total, KEY).select(*KEY, "_salt", *kept, "_size"), "content-groups")
    grouped = narrow.join(spread, [*KEY, "_salt"]).drop("_salt")

    repeated = spread.where("_size > 1")
    contents = _likely(hashed.select(*KEY, "_salt", "_content"), repeated).join(repeated.select(*KEY, "_salt"), [*KEY, "_salt"])
    distinct = contents.select(*KEY, "_content").distinct()
    collided = stored(distinct.groupBy(*KEY).count().where("count > 1").select(*KEY), "content-collisions")
    if collided.isEmpty():
        return grouped
    return _regrouped(grouped, hashed, collided, own)


def _first(own: list[str]) -> Column:
    """The smallest id; with row numbers, the smallest pair, in which null ids come last."""
    return F.min("_id") if own == ["_id"] else F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))


def _named(column: str, own: list[str]) -> list[Column]:
    """_keep, and _keep_row if there are row numbers, of what ``_first`` made."""
    if own == ["_id"]:
        return [F.col(column).alias("_keep")]
    return [F.col(f"{column}._id").alias("_keep"), F.col(f"{column}._row").alias("_keep_row")]


def _likely(hashed: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``hashed`` whose bit is set by some row of ``repeated``. The broadcast is of FILTER_BITS bits at most, in
    rows of 2^15 bits."""
    place = F.pmod(F.col("_h1"), F.lit(FILTER_BITS))
    bits = repeated.select(F.floor(place / 32768).alias("_part"), F.expr(f"pmod(_h1, {FILTER_BITS}) % 32768").alias("_bit"))
    maps = F.broadcast(bits.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map")))
    byte = F.expr(f"cast(conv(hex(substring(_map, cast(pmod(_h1, {FILTER_BITS}) % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr(f"cast(pmod(_h1, {FILTER_BITS}) % 8 as int)")
    near = hashed.withColumn("_part", F.floor(place / 32768)).join(maps, "_part")
    return near.where(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1).drop("_part", "_map")


def _regrouped(grouped: DataFrame, hashed: DataFrame, collided: DataFrame, own: list[str]) -> DataFrame:
    """Replace what is kept and the size for the rows of colliding hashes by a grouping on hash and bytes."""
    rows = hashed.select(*own, *KEY, "_content").join(collided, KEY, "left_semi")
    exact = rows.groupBy(*KEY, "_content").agg(_first(own).alias("_k"), F.count(F.lit(1)).alias("_s"))
    fixed = rows.join(exact, [*KEY, "_content"]).groupBy(*own, *KEY).agg(F.min("_k").alias("_k"), F.max("_s").alias("_s"))
    kept = [c for c in grouped.columns if c.startswith("_keep")]
    right = fixed.select(*[F.col(c).alias(f"r{c}") for c in (*own, *KEY)], *[c.alias(f"n{k}") for c, k in zip(_named("_k", own), kept, strict=True)], "_s")
    on = (grouped["_h1"] == right["r_h1"]) & (grouped["_h2"] == right["r_h2"])
    for c in own:
        on &= grouped[c].eqNullSafe(right[f"r{c}"])
    rest = [c for c in grouped.columns if c not in (*kept, "_size")]
    chosen = [F.when(F.col("_s").isNotNull(), F.col(f"n{k}")).otherwise(F.col(k)).alias(k) for k in kept]
    return grouped.join(right, on, "left").select(*rest, *chosen, F.coalesce("_s", "_size").alias("_size"))


def _decided(docs: DataFrame, row: str | None, id_col: str, text_col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """The groups of ``docs`` by folded text, with _kept: true for one row of each group. ``row`` is the column that ``numbered`` added."""
    own = [F.col(id_col).alias("_id")] + ([F.col(row).alias("_row")] if row else [])
    groups = content_groups(docs.select(*own, whitespace_folded(F.col(text_col)).alias("_content")), extra)
    kept = F.col("_id").eqNullSafe(F.col("_keep"))
    return groups.withColumn("_kept", kept & (F.col("_row") == F.col("_keep_row")) if row else kept)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: which document of its equals stays.

    Texts are equal when they are identical after each run of ASCII white space became one space; null counts as empty.
    Returns ``id_col``, keep_id, group_size, kept, text_sha256. Other columns of ``docs``, whatever their names, are
    not read. An empty table gives an empty result; a text of any length is one row and is only hashed and compared. Exactly one row of
    each group is kept: of rows that repeat the id that stays, one. Null ids are kept only in groups without any other id.
    """
    narrow, row = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    out = _decided(narrow, row, "_id", "_text", {"text_sha256": F.sha2(F.col("_content"), 256)})
    return out.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), "text_sha256")


def without_rows(docs: DataFrame, row: str | None, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``gone`` (_id, and _row if ``row`` names the numbers in ``docs``), without the numbers. The join is with what goes, the
    lesser part."""
    left = gone.select(F.col("_id").alias("_gone"), *[F.col("_row").alias("_gone_row")] * bool(row))
    on = docs[id_col].eqNullSafe(left["_gone"])
    if not row:
        return docs.join(left, on, "left_anti")
    return docs.join(left, on & (docs[row] == left["_gone_row"]), "left_anti").drop(row)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay, with all their columns: one row of each text (as ``exact_dedup`` has equal texts), that with the smallest
    id. Decided by row, so rows that repeat an id stay or go each by its own text, and of equal rows one stays. Null and empty texts are one text.
    An empty table stays empty."""
    rows, row = numbered(docs, id_col, text_col)
    return without_rows(rows, row, id_col, _decided(rows, row, id_col, text_col).where("NOT _kept"))
