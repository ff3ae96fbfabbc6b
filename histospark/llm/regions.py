"""Regions of sets, joined by Jaccard distance: in one task, or split into Voronoi cells where they are too large for one.

Distance is one less similarity, a metric, and sets link within RADIUS. A region is a table of sets of which each has a
label, so that sets with one label are known to be connected, and of which some are at home: links are to be found between
all pairs of which one set at least is at home.

A region of more than REGION_ENTRIES shingles is split. Pivots are drawn from it, one of a label at most. A set has its home in the
cell of its nearest pivot, if that is within REACH, and else in the rest. The set x of a cell of pivot p and a set y linked with it have
d(y, p) <= d(x, p) + RADIUS, so y is also needed in the cells of all pivots within REACH + RADIUS and within 2 * RADIUS of its own nearest
distance, and in the rest if no pivot is within REACH - RADIUS: there it is a guest. Sets within RADIUS of a pivot take its label, and a
region with one label left is done. Cells are regions in their turn. Where cells together hold more than GROWTH times what the region
holds, the region is not separable by pivots, and blocks of its sets meet each other, but for pairs of blocks of its most common label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import stored

RADIUS, REACH = 0.25, 0.5
PIVOTS = 64
REGION_ENTRIES = 1_000_000
GROWTH = 4
DEPTH = 6
#: Distances are compared with this to spare, so that rounding only ever adds guests.
SPARE = 1e-6
MEMBER = "region long, set_id long, n long, label long, home boolean, hashes binary"
COLUMNS = [c.split()[0] for c in MEMBER.split(", ")]


def least_common(n: int) -> int:
    """How many shingles a similar partner has of a set of n at least: three quarters, rounded up."""
    return -(-3 * n // 4)


def commons(own: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many elements each of the sets that lie one after the other in ``flat`` has in common with ``own``."""
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    return np.add.reduceat((own[at] == flat).astype(np.int64), first)


class Region:
    """The sets of a region, with the links found so far."""

    def __init__(self, sets: list[np.ndarray], labels: list[int] | None = None) -> None:
        self.sets = sets
        self.n = np.array([len(s) for s in sets])
        self.flat = np.concatenate(sets)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        seen: dict[int, int] = {}
        self.parent = [seen.setdefault(x, k) for k, x in enumerate(range(len(sets)) if labels is None else labels)]

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(x) for x in range(len(self.sets))), np.int64, len(self.sets))

    def join(self) -> list[int]:
        """Link all similar sets; the root of each. Pivots are taken as long as they gather their neighbourhood; what they leave outside the largest
        component is compared with what shares a rare shingle at a place where similar sets can."""
        count = len(self.sets)
        loose, far = np.ones(count, bool), []
        while len(far) < PIVOTS and loose.any():
            p = int(np.flatnonzero(loose)[0])
            common = commons(self.sets[p], self.flat, self.first)
            union = self.n + self.n[p] - common
            near = np.flatnonzero(100 * common >= 75 * union)
            for x in near.tolist():
                self.link(p, x)
            gained = int(loose[near].sum())
            loose[near] = False
            far.append(1 - common / union)
            if gained == 1 and len(far) >= 8 and len(far) * 4 > count - int(loose.sum()):
                break
        roots = self.roots()
        largest = np.bincount(roots).argmax()
        self._compare(np.flatnonzero(roots != largest).tolist(), np.array(far, np.float32))
        return self.roots().tolist()

    def _index(self):
        """(token, set, place) of the entries by which similar sets can meet first, with what sizes the partner has at most; by token.

        Tokens are ordered from rare to common in all sets alike. Two similar sets of sizes a and b have 3/7 (a + b) in common at least, so
        that their first common token is followed by that many in both. The smaller of them can therefore have it only where a
        partner of its own size could, and tokens that no set has so far to the front lead nowhere."""
        values, place, often = np.unique(self.flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, often))] = np.arange(len(values))
        owner = np.repeat(np.arange(len(self.sets)), self.n)
        token, common = rank[place], often[place] > 1
        order = np.lexsort((token, owner))
        token, common = token[order], common[order]
        n = self.n[owner]
        at = np.arange(len(owner)) - self.first[owner]
        keep = common & (at <= n - least_common(n))
        token, owner, n, at = token[keep], owner[keep], n[keep], at[keep]
        most = np.minimum(4 * n // 3, 7 * (n - at) // 3 - n)
        order = np.lexsort((n, token))
        token, owner, n, most = token[order], owner[order], n[order], most[order]
        if not len(token):
            return token, owner, most
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        run = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
        smallest = np.minimum.reduceat(np.where(most >= n, n, np.iinfo(np.int64).max), begin)[run]
        useful = (smallest <= most) & (np.diff(np.append(begin, len(token)))[run] > 1)
        return token[useful], owner[useful], most[useful]

    def _compare(self, probes: list[int], far: np.ndarray) -> None:
        """Compare each probe with the sets that it can be similar to and is not yet connected with; ``far`` has the distances to the pivots, which of
        two similar sets differ by RADIUS at most."""
        if not probes:
            return
        token, owner, most = self._index()
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(token))
        run = np.searchsorted(begin, np.arange(len(token)), "right") - 1
        own = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[own], np.arange(len(self.sets) + 1))
        for x in probes:
            entries = own[at[x] : at[x + 1]]
            met = []
            for e in entries.tolist():
                part = slice(begin[run[e]], stop[run[e]])
                met.append(owner[part][(self.n[owner[part]] <= most[e]) & (most[part] >= self.n[x])])
            if not met:
                continue
            others = np.unique(np.concatenate(met))
            if len(far):
                others = others[(np.abs(far[:, others] - far[:, x : x + 1]) <= RADIUS + SPARE).all(axis=0)]
            for y in others.tolist():
                if self.root(x) == self.root(y):
                    continue
                common = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
                if 100 * common >= 75 * (len(self.sets[x]) + len(self.sets[y]) - common):
                    self.link(x, y)


def _sets(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def _joined(table: pa.Table) -> pa.Table:
    """(set_id, root) of a region's sets."""
    table = table.sort_by([("n", "descending"), ("set_id", "ascending")])
    ids = table.column("set_id").to_pylist()
    roots = Region(_sets(table.column("hashes").to_pylist()), table.column("label").to_pylist()).join()
    return pa.table({"set_id": pa.array(ids, pa.int64()), "root": pa.array([ids[r] for r in roots], pa.int64())})


def _measured(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """MEMBER rows with far, the distances to the region's pivots that are more than RADIUS from those before them, and linked, the ids of pivots
    within RADIUS."""
    if not members.num_rows or not pivots.num_rows:
        return pa.table({**{c: members.column(c).slice(0, 0) for c in COLUMNS}, "far": pa.array([], pa.binary()), "linked": pa.array([], pa.list_(pa.int64()))})
    pivots = pivots.sort_by("set_id")
    ids, all_sets = pivots.column("set_id").to_pylist(), _sets(pivots.column("hashes").to_pylist())
    kept: list[int] = []
    for k, s in enumerate(all_sets):
        common = [len(np.intersect1d(s, all_sets[j], assume_unique=True)) for j in kept]
        if not any(100 * c >= 75 * (len(s) + len(all_sets[j]) - c) for c, j in zip(common, kept, strict=True)):
            kept.append(k)
    sets = _sets(members.column("hashes").to_pylist())
    n = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
    far, near = np.zeros((len(sets), len(kept)), np.float32), np.zeros((len(sets), len(kept)), bool)
    for c, k in enumerate(kept):
        common = commons(all_sets[k], flat, first)
        union = n + len(all_sets[k]) - common
        far[:, c], near[:, c] = 1 - common / union, 100 * common >= 75 * union
    linked = [[ids[kept[c]] for c in np.flatnonzero(row)] for row in near]
    # Pivots that are left out for their nearness to another are linked with it as members of the region.
    return pa.table({**{c: members.column(c) for c in COLUMNS}, "far": pa.array([row.tobytes() for row in far], pa.binary()), "linked": pa.array(linked, pa.list_(pa.int64()))})


def cells(far: np.ndarray, home: bool) -> list[tuple[int, bool]]:
    """(cell, at home) of a set with these distances to the pivots; cell -1 is the rest."""
    nearest = int(far.argmin())
    least = float(far[nearest])
    own = nearest if least <= REACH else -1
    needed = np.flatnonzero(far <= min(REACH + RADIUS, least + 2 * RADIUS) + SPARE).tolist()
    if least > REACH - RADIUS - SPARE:
        needed.append(-1)
    return [(c, home and c == own) for c in {own, *needed}]


def _dealt(batches):
    """Rows (above, *MEMBER) of the cells; a cell's number is a hash of its region's and its place."""
    names = ["above", *COLUMNS]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*COLUMNS, "far"]}
        out: list[tuple] = []
        for region, set_id, n, label, home, hashes, far in zip(*columns.values(), strict=True):
            for cell, own in cells(np.frombuffer(far, np.float32), home):
                out.append((region, _numbered(region, cell), set_id, n, label, own, hashes))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names)


def _numbered(region: int, cell: int) -> int:
    mixed = (region * 0x9E3779B97F4A7C15 + (cell + 2) * 0xC4CEB9FE1A85EC53) & (1 << 64) - 1
    mixed = (mixed ^ mixed >> 31) * 0xFF51AFD7ED558CCD & (1 << 64) - 1
    return (mixed ^ mixed >> 29) - (1 << 63)


def _weights(members: DataFrame) -> DataFrame:
    """Of regions with work left: (region, weight), the number of shingles."""
    agg = members.groupBy("region").agg(F.sum("n").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("home").alias("some"))
    return agg.where("low != high AND some").select("region", "weight")


def _blocks(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows of ``members`` with the blocks' meeting (one, two, kind) for each meeting that they take part in. Of the region's most common label blocks
    don't meet each other."""
    sizes = members.groupBy("region", "label").agg(F.sum("n").alias("w"))
    top = sizes.groupBy("region").agg(F.max(F.struct("w", "label")).alias("t"), F.sum("w").alias("all"))
    block = REGION_ENTRIES // 2
    plan = top.join(weights.select("region"), "region").select(
        "region", F.col("t.label").alias("top"), F.ceil(F.greatest(F.lit(1), F.col("t.w")) / block).cast("int").alias("many"), F.ceil(F.greatest(F.lit(1), F.col("all") - F.col("t.w")) / block).cast("int").alias("few")
    )
    rows = members.join(plan, "region")
    is_top = F.col("label") == F.col("top")
    own = F.pmod(F.xxhash64("set_id", F.lit(7)), F.when(is_top, F.col("many")).otherwise(F.col("few"))).cast("int")
    with_top = lambda own_is_one: F.transform(F.sequence(F.lit(0), F.col("few" if not own_is_one else "many") - 1), lambda j: F.struct((F.col("own") if own_is_one else j).alias("one"), (j if own_is_one else F.col("own")).alias("two"), F.lit(1).alias("kind")))
    among = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: F.struct(F.least("own", j).alias("one"), F.greatest("own", j).alias("two"), F.lit(0).alias("kind")))
    meetings = F.when(is_top, with_top(False)).otherwise(F.concat(among, with_top(True)))
    return rows.withColumn("own", own).withColumn("m", F.explode(meetings)).select(*COLUMNS, "m.one", "m.two", "m.kind")


def joined(members: DataFrame) -> DataFrame:
    """(set_id, root) such that sets (MEMBER) are connected if and only if links of regions connect them. Each row of the table is an
    edge; with regions that had to be split, a set has several."""
    schema = "set_id long, root long"
    edges = []
    for depth in range(DEPTH + 1):
        weights = stored(_weights(members), "region-weights")
        if weights.isEmpty():
            break
        fit = members.join(weights.where(f"weight <= {REGION_ENTRIES}").select("region"), "region", "left_semi")
        edges.append(stored(fit.select(*COLUMNS).groupBy("region").applyInArrow(_joined, schema), "region-links"))
        large = weights.where(f"weight > {REGION_ENTRIES}")
        if large.isEmpty():
            break
        members = members.join(large.select("region"), "region", "left_semi").select(*COLUMNS)
        if depth == DEPTH:
            edges.append(_by_blocks(members, large))
            break
        measured = _by_pivots(members, large, depth)
        edges.append(stored(measured.select("set_id", F.explode("linked").alias("root")).where("set_id != root").distinct(), "pivot-links"))
        known = components(edges[-1].select(F.col("set_id").alias("a"), F.col("root").alias("b")))
        fresh = measured.join(known, measured["set_id"] == known["node"], "left").withColumn("label", F.coalesce("root", "label")).select(*COLUMNS, "far")
        fresh = stored(fresh, "labelled-members")
        left = _weights(fresh).select("region")
        dealt = stored(fresh.join(left, "region", "left_semi").mapInArrow(_dealt, "above long, " + MEMBER), "cells")
        after = dealt.groupBy(F.col("above").alias("region")).agg(F.sum("n").alias("after"))
        grown = stored(after.join(weights, "region").where(f"after > {GROWTH} * weight").select("region", "weight"), "grown-regions")
        if not grown.isEmpty():
            edges.append(_by_blocks(fresh.join(grown.select("region"), "region", "left_semi").select(*COLUMNS), grown))
        members = dealt.join(grown, dealt["above"] == grown["region"], "left_anti").select(*COLUMNS)
    if not edges:
        return members.sparkSession.createDataFrame([], schema)
    out = edges[0]
    if len(edges) == 1:
        return out
    for more in edges[1:]:
        out = out.unionByName(more)
    found = components(out.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    return found.select(F.col("node").alias("set_id"), "root")


def _by_blocks(members: DataFrame, weights: DataFrame) -> DataFrame:
    met = _blocks(members, weights).groupBy("region", "one", "two", "kind")
    return stored(met.applyInArrow(lambda t: _joined(t.drop_columns(["one", "two", "kind"])), "set_id long, root long"), "block-links")


def _by_pivots(members: DataFrame, weights: DataFrame, depth: int) -> DataFrame:
    """MEMBER rows with far and linked, by shares of a region: its pivots go to each of them."""
    one = members.where("home").groupBy("region", "label").agg(F.min(F.struct(F.xxhash64("set_id", F.lit(depth)).alias("h"), "set_id")).alias("p"))
    chosen = one.groupBy("region", F.pmod("p.h", F.lit(PIVOTS)).alias("class")).agg(F.min("p").alias("p")).select("region", F.col("p.set_id").alias("set_id"))
    shares = weights.select("region", F.ceil(F.col("weight") / REGION_ENTRIES).cast("int").alias("shares"))
    pivots = members.join(chosen, ["region", "set_id"], "left_semi").dropDuplicates(["region", "set_id"]).select("region", "set_id", "hashes")
    pivots = stored(pivots.join(shares, "region").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares"), "pivots")
    dealt = members.join(shares, "region").withColumn("share", F.pmod(F.xxhash64("set_id"), F.col("shares")).cast("int")).drop("shares")
    both = dealt.groupBy("region", "share").cogroup(pivots.groupBy("region", "share"))
    return stored(both.applyInArrow(_measured, MEMBER + ", far binary, linked array<long>"), "pivot-distances")
