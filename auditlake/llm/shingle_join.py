"""Jaccard join of documents on word shingles, with R-trees over counts of hashed groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.llm.shared import components, map_rows, slices, small_or_salted, staged
from auditlake.operators.durable import durable, shuffles_removed

#: Growth of the size classes, and parts of a group (see ``Levels``).
GROWTH, PARTS = 1.25, 3
#: Group hashes that are put together before the shuffle, and words and sets that a task remembers.
BATCH, WORDS = 300_000, 50_000
#: Sets whose counts are made at once.
ROWS = 1024
#: Counts of a document's point, points and shingles of a tile, and entries of a tree node.
COUNTS, TILE_POINTS, TILE, FANOUT = 512, 8192, 2_000_000, 32

PACKED = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]
    + [("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("text_hash", pa.int64())]
)
FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("text_hash", pa.int64()), ("other", pa.int64()), ("counts", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
HASHES, DOCUMENT, EDGES = 0, 1, 2

#: Odd numbers that mix 64-bit hashes.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[3]
    h = (h ^ (h >> np.uint64(29))) * MIX[4]
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_sets(texts: list[str | None], n: int, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each text begins.

    A text's words are lower-cased (A-Z) and stand between ASCII white space; a text with fewer than
    ``n`` words has its whole sequence as one shingle, one without words none.
    """
    words = [(t or "").encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    parts = []
    for w, end, count in zip(words, ends.tolist(), counts.tolist(), strict=True):
        own = flat[end - count : end]
        if count >= n:
            h = np.zeros(count - n + 1, np.uint64)
            for k in range(n):
                h = (h + own[k : count - n + 1 + k]) * MIX[0] + MIX[1]
        else:
            h = np.zeros(min(1, count), np.uint64)
            for k in range(count):
                h = (h + own[k : k + 1]) * MIX[0] + MIX[1]
            h += np.full(1, count, np.uint64) * MIX[5]
        h = mixed(h)
        h.sort()
        parts.append(h)
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    sizes = np.array([len(p) for p in parts], np.int64)
    doc = np.repeat(np.arange(len(parts)), sizes)
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(parts))))).astype(np.int64)
    return h[first], starts


def group_counts(h: np.ndarray, starts: np.ndarray, groups: int = COUNTS) -> np.ndarray:
    """For each set, how many of its shingles fall into each of ``groups`` hashed groups."""
    sets, sizes = len(starts) - 1, np.diff(starts)
    out = np.empty((sets, groups), np.uint8 if sizes.max(initial=0) < 256 else np.uint32)
    for k in range(0, sets, ROWS):  # counts are made as wide numbers, some sets at a time
        own, n = h[starts[k] : starts[min(k + ROWS, sets)]], min(ROWS, sets - k)
        part = ((own >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        out[k : k + n] = np.bincount(part + np.repeat(np.arange(n), sizes[k : k + n]) * groups, minlength=n * groups).reshape(n, groups)
    return out


class Levels:
    """Size classes, and the number of hashed groups in which sets of a class are compared.

    Sets of sizes a and b link if ``percent`` of their union is shared, so they differ in at most
    d = (a + b)(100 - percent) / (100 + percent) shingles. If shingles are dealt by their hash into
    more than d / 2 groups, some group differs in one shingle at most; if each group is divided into
    PARTS parts, all parts of it but one are the same on both sides. So documents that link share,
    for some group, all parts but one: that is what is compared. Parts that agree because they are
    empty don't count: with ``spare`` groups more than needed, a set with up to that many groups
    where all parts but one may be empty still agrees elsewhere; sets with more such groups give the
    empty ones as well.

    A pair is compared in the class of its larger set; a set that may be the smaller one of a pair of
    the next class is also compared there.
    """

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * max(GROWTH, 100 / percent))))
        self.edges = np.array(edges, np.int64)
        most = 2 * (self.edges[1:] - 1) * (100 - percent) // (100 + percent)
        needed = most // 2 + 1
        self.spare = np.array([spare_groups(int(n), int(e) * percent / 100) for n, e in zip(needed, self.edges[:-1], strict=True)], np.int64)
        self.groups = needed + self.spare

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of sets with a class to compare them in: their own, and for some the next."""
        own = np.searchsorted(self.edges, sizes, side="right") - 1
        some = np.flatnonzero(sizes > 0)
        border = np.flatnonzero((sizes > 0) & (100 * sizes >= self.percent * self.edges[own + 1]))
        return [(some, own[some]), (border, own[border] + 1)]


def spare_groups(needed: int, size: float) -> int:
    """So many more groups that few sets have more groups with empty parts; any number gives right results."""
    best, least = 0, 2.0
    for spare in range(12):
        groups = needed + spare
        empty = min(1.0, PARTS * math.exp(-size / groups * (PARTS - 1) / PARTS))
        more = 1 - sum(math.comb(groups, k) * empty**k * (1 - empty) ** (groups - k) for k in range(spare + 1)) if groups < 1000 else float(groups * empty > spare)
        if more < min(least, 1e-2):
            return spare
        best, least = (spare, more) if more < least else (best, least)
    return best


def group_hashes(h: np.ndarray, starts: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each group of every set without one of its parts, and the set each belongs to."""
    sizes, hashes, rows = np.diff(starts), [], []
    for which, level in levels.of(sizes):
        if not len(which):
            continue
        own, groups = sizes[which], levels.groups[level]
        at = np.repeat(starts[which] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())
        base = np.concatenate(([0], np.cumsum(groups * PARTS)))
        part = (((h[at] >> np.uint64(32)) * np.repeat(groups * PARTS, own).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], own)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, counts = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.int64)
        sums[part[begin]] = np.add.reduceat(mixed(h[at] * MIX[1]), begin)
        counts[part[begin]] = np.diff(np.append(begin, len(part)))
        sums, counts, of = sums.reshape(-1, PARTS), counts.reshape(-1, PARTS), np.repeat(np.arange(len(which)), groups)
        number = np.arange(len(of)) - np.repeat(base[:-1] // PARTS, groups)
        name = mixed(((number << 8) + np.repeat(level, groups)).astype(np.uint64) * MIX[2] + MIX[6])
        found = mixed(sums.sum(axis=1, dtype=np.uint64)[:, None] - sums + name[:, None] + np.arange(PARTS, dtype=np.uint64) * MIX[5])
        empty = counts.sum(axis=1)[:, None] == counts
        few = np.bincount(of, weights=empty.any(axis=1), minlength=len(which)) <= levels.spare[level]
        keep = ~empty | ~few[of][:, None]
        hashes.append(found[keep])
        rows.append(np.repeat(which[of], PARTS).reshape(-1, PARTS)[keep])
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def node_ids(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each set that is not empty, 0 for the others: equal sets are one node."""
    sizes = np.diff(starts)
    sums = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        sums[some] = mixed(np.add.reduceat(mixed(h * MIX[2]), starts[:-1][some]) + sizes[some].astype(np.uint64) * MIX[6])
    return sums.view(np.int64)


def stars(hashes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join nodes that share a hash to the smallest of them: hashes with that node alone, and the edges (smallest, other)."""
    order = np.lexsort((nodes, hashes))
    hashes, nodes = hashes[order], nodes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    lowest = nodes[first][np.cumsum(first) - 1]
    edge = ~first & (nodes != lowest)
    return hashes[first], nodes[first], lowest[edge], nodes[edge]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def hash_documents(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int) -> Iterator[list[tuple]]:
    """Rows for the shuffle: a row per document, and packed group hashes and edges per bucket of hashes.

    Copies of a set within the task are hashed once, and hashes that several sets of a batch share
    become edges to the smallest, so that no hash goes into the shuffle more than once per batch.
    """
    known, levels, seen, kept, count = Words(), Levels(percent), set(), [], 0

    def packed() -> list[tuple]:
        hashes, nodes, a, b = stars(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]))
        a, b = distinct_pairs(a, b)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        # the upper half of a hash says the bucket; the lower half tells hashes of a bucket apart well enough for candidates
        low = hashes.astype(np.uint32)
        rows = [(k, HASHES, low[i:j].tobytes(), nodes[i:j].tobytes(), None, None, None, None) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        spread = max(1, -(-len(a) // buckets))
        rows += [(k, EDGES, a[i : i + spread].tobytes(), b[i : i + spread].tobytes(), None, None, None, None) for k, i in enumerate(range(0, len(a), spread))]
        return rows

    for part in slices(batches):
        texts = part.column("text").to_pylist()
        h, starts = shingle_sets(texts, n, known)
        nodes, sizes = node_ids(h, starts), np.diff(starts)
        new = np.array([x != 0 and x not in seen and not seen.add(x) for x in nodes.tolist()], bool)
        if len(seen) > WORDS:
            seen.clear()
        hashes, rows = group_hashes(h, starts, levels)
        mine = new[rows]
        kept.append((hashes[mine], nodes[rows[mine]]))
        some = [None if s == 0 else x for x, s in zip(nodes.tolist(), sizes.tolist(), strict=True)]
        keys, text_hash = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
        points = [c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes() if x else None for c, x in zip(group_counts(h, starts), new.tolist(), strict=True)]
        yield [((count + k) % buckets, DOCUMENT, p, None, *r) for k, (p, *r) in enumerate(zip(points, keys, some, sizes.tolist(), text_hash, strict=True))]
        count += len(texts)
        if sum(len(k[0]) for k in kept) > BATCH:
            yield packed()
            kept = []
    if kept:
        yield packed()


def join_bucket(group: pa.Table) -> pa.Table:
    """Documents as they are, and edges between nodes that share a group hash: those of the rows, and those found here."""
    kinds = group.column("kind").to_numpy()
    read = lambda name, kind, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in group.column(name).filter(pa.array(kinds == kind)).to_pylist())])
    _, _, a, b = stars(read("left", HASHES, np.uint32), read("right", HASHES, np.int64))
    a, b = distinct_pairs(np.concatenate([a, read("left", EDGES, np.int64)]), np.concatenate([b, read("right", EDGES, np.int64)]))
    docs = group.filter(pa.array(kinds == DOCUMENT))
    none = lambda k: pa.nulls(k, pa.int64())
    docs = pa.table([*(docs.column(c) for c in FOUND.names[:5]), none(docs.num_rows), docs.column("left")], schema=FOUND)
    edges = [pa.array(np.full(len(a), EDGES), pa.int32()), none(len(a)), pa.array(a), none(len(a)), none(len(a)), pa.array(b), pa.nulls(len(a), pa.binary())]
    edges = pa.table(edges, schema=FOUND)
    return pa.concat_tables([docs, edges])


class CountTree:
    """A packed R-tree over count vectors. A box keeps the largest count of each group and the least and largest set size below it.

    Points can be marked with the component they are in (``mark``); boxes whose points are all in one component are then passed over for it.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((counts.argmax(axis=1), sizes))
        self.fanout, self.levels = fanout, []
        high, low_size, high_size = counts[self.order], sizes[self.order], sizes[self.order]
        while True:
            self.levels.append((high, low_size, high_size))
            if len(high) <= fanout:
                break
            cuts = np.arange(0, len(high), fanout)
            high, low_size, high_size = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_size, cuts), np.maximum.reduceat(high_size, cuts)

    def mark(self, root: np.ndarray) -> None:
        """Note the component of every point, and the least and largest one of every box."""
        low = high = root[self.order]
        self.marks = [(low, high)]
        for _ in self.levels[1:]:
            cuts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.marks.append((low, high))

    def candidates(self, counts: np.ndarray, size: int, percent: int, component: int | None = None) -> np.ndarray:
        """Points that may share enough with a point: the sum of the smaller counts bounds the overlap from above. Those marked with ``component`` are left out."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_size, high_size = self.levels[depth]
            if component is not None:
                low, last = self.marks[depth]
                at = at[(low[at] != component) | (last[at] != component)]
            bound = np.minimum(high[at], counts).sum(axis=1, dtype=np.int64)
            fits = ((100 + percent) * bound >= percent * (size + low_size[at])) & (100 * high_size[at] >= percent * size) & (100 * size >= percent * low_size[at])
            at = at[fits]
            if depth:
                at = (at[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    sums = np.concatenate(([0], np.cumsum(one[place] == flat)))
    ends = np.cumsum([len(x) for x in others])
    return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]


def spanning_links(counts: np.ndarray, sizes: np.ndarray, sides: np.ndarray, percent: int, confirm=None) -> list[tuple[int, int]]:
    """Links that connect what links connect: pairs of places, none between places that others connect already.

    Sides 0 and 1 are compared with each other, side 2 with itself. A link is a pair that passes the
    bound of the tree and that ``confirm`` (place, places) confirms. Points nearest to the middle come
    first, as the text that others were copied from tends to be there and its links leave little to do.
    """
    usual = np.concatenate([np.median(counts[:, k : k + 32], axis=0) for k in range(0, counts.shape[1], 32)]).astype(np.int32)
    middle = np.concatenate([np.abs(counts[k : k + ROWS].astype(np.int32) - usual).sum(axis=1) for k in range(0, len(counts), ROWS)])
    both = sides[0] == 2
    points = np.arange(len(counts)) if both else np.flatnonzero(sides == 1)
    tree = CountTree(counts[points], sizes[points])
    root, done, links, new = np.arange(len(counts)), np.zeros(len(counts), bool), [], True

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = int(root[k])
        return k

    asking = np.arange(len(counts)) if both else np.flatnonzero(sides == 0)
    for k in asking[np.argsort(middle[asking], kind="stable")].tolist():
        done[k] = True
        if new:
            while (root[root] != root).any():
                root = root[root]
            if (root == root[0]).all():
                break
            tree.mark(root[points])
            new = False
        near = points[tree.candidates(counts[k], int(sizes[k]), percent, int(root[k]))]
        near = near[~done[near]]
        for at in range(0, len(near), 1024):
            some = near[at : at + 1024]
            for j in (some[confirm(k, some)] if confirm else some).tolist():
                u, v = find(k), find(j)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    links.append((k, j))
                    new = True
    return links


def linked_points(counts: list[bytes], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links by the bound alone."""
    points = np.stack([np.frombuffer(c, np.uint8 if len(c) == COUNTS else np.uint32) for c in counts])
    return spanning_links(points, points.sum(axis=1, dtype=np.int64), sides, percent)


def linked_sets(hashes: list[bytes], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links of sets that share ``percent`` of their union."""
    sets = [np.frombuffer(x, np.uint64) for x in hashes]
    sizes = np.array([len(s) for s in sets])

    def confirm(k: int, others: np.ndarray) -> np.ndarray:
        return (100 + percent) * shared_counts(sets[k], [sets[x] for x in others.tolist()]) >= percent * (sizes[k] + sizes[others])

    if len(sets) == 2:
        return [(0, 1)] if confirm(0, np.array([1]))[0] else []
    counts = group_counts(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes))))
    return spanning_links(counts, sizes, sides, percent, confirm)


def link_groups(group: pa.Table, column: str, linked, percent: int) -> pa.Table:
    """Links within the groups of candidates (or between the two tiles of one) that a task holds."""
    group = group.combine_chunks()
    super_, node, side = (group.column(c).to_numpy() for c in ("super", "node", "side"))
    values = group.column(column)
    order = np.lexsort((node, super_))
    cuts = np.flatnonzero(np.concatenate(([True], super_[order][1:] != super_[order][:-1], [True])))
    a, b = [], []
    for i, j in zip(cuts, cuts[1:], strict=False):
        own = order[i:j]
        own = own[np.concatenate(([True], node[own][1:] != node[own][:-1]))]  # a set may come from several tasks
        if len(own) > 1 and (side[own[0]] == 2 or len(set(side[own].tolist())) == 2):
            for x, y in linked([values[k].as_py() for k in own.tolist()], side[own], percent):
                a.append(node[own[x]])
                b.append(node[own[y]])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def tasks_of(members: DataFrame, weight: Column, most: int, percent: int) -> DataFrame:
    """Written members (node, super, n, ...) with their task: small groups share one, a group of more than ``most`` weight is cut into tiles.

    What a task holds grows with shingles (8 bytes each) and with points (a byte a count), so a set of few shingles weighs as much as its counts.
    A tile holds sets of neighbouring sizes ``n`` (or, of a size that many have, a part), so that a set meets only the tiles of
    sizes that it may link with: the larger a group, the fewer of its tiles. ``ks`` are those tiles.
    """
    with shuffles_removed(members.sparkSession):
        total = members.agg(F.sum(weight)).first()[0] or 0
    together = F.pmod(F.xxhash64("super"), F.lit(total // most * 2 + 16))
    large = durable(members.groupBy("super").agg(F.sum(weight).alias("all")).where(F.col("all") > most).select("super"))
    sizes = small_or_salted(members, large, ["super"], "inner").groupBy("super", "n").agg(F.sum(weight).alias("weight"))
    # sizes of much weight have tiles of their own, numbered downwards from -1; the others share tiles from 0 on
    sizes = sizes.withColumn("own", F.when(F.col("weight") * 4 >= most, F.ceil(F.col("weight") / F.lit(most)).cast("long")))
    smaller = Window.partitionBy("super").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(smaller), F.lit(0))
    first = F.when(F.col("own").isNotNull(), -1 - before(F.col("own"))).otherwise(F.floor(before(F.when(F.col("own").isNull(), F.col("weight"))) / F.lit(most)))
    cut = durable(sizes.select("super", "n", first.cast("long").alias("first"), F.coalesce("own", F.lit(1)).cast("long").alias("own")))
    tiles = cut.select("super", "n", F.explode(F.sequence(F.col("first") - F.col("own") + 1, "first")).alias("tile")).groupBy("super", "tile")
    tiles = durable(tiles.agg(F.min("n").alias("low"), F.max("n").alias("high")))
    others = tiles.select("super", F.col("tile").alias("k"), F.col("low").alias("k_low"), F.col("high").alias("k_high"))
    near = tiles.join(others, "super").where(f"100 * high >= {percent} * k_low and 100 * k_high >= {percent} * low")
    ks = durable(near.groupBy("super", "tile").agg(F.collect_list("k").alias("ks")))
    tile = F.coalesce(F.col("first") - F.pmod(F.xxhash64("node"), F.col("own")), F.lit(0).cast("long"))
    placed = small_or_salted(members, cut, ["super", "n"], "left").withColumns({"whole": F.when(F.col("first").isNull(), together), "tile": tile}).drop("first", "own")
    alone = F.array(F.lit(0).cast("long"))
    return small_or_salted(placed, ks, ["super", "tile"], "left").withColumn("ks", F.when(F.col("whole").isNull(), F.col("ks")).otherwise(alone))


def links_of(rows: DataFrame, column: str, linked, percent: int) -> DataFrame:
    """Spanning links of rows with the columns of ``tasks_of`` and one to compare by. Every two tiles of a group that may hold a link meet in one task."""
    step = F.struct(F.least(F.col("tile"), F.col("k")).alias("i"), F.greatest(F.col("tile"), F.col("k")).alias("j"))
    dealt = rows.withColumn("k", F.explode("ks")).withColumn("t", step)
    side = F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("tile") == F.col("t.i"), 0).otherwise(1)
    dealt = dealt.select(F.coalesce("whole", "super").alias("task"), F.col("whole").isNull().alias("tiled"), "t.i", "t.j", side.alias("side"), "super", "node", column)
    return dealt.groupBy("task", "tiled", "i", "j").applyInArrow(lambda group: link_groups(group, column, linked, percent), from_arrow_schema(LINKS))


def candidate_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Shingle sets of the nodes (node, text_hash, ...): their texts are found by hash and shingled again, a copy once per task."""
    known = ("node", "super", "whole", "tile", "ks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        words, seen = Words(), set()
        for part in slices(batches):
            new = [k for k, x in enumerate(part.column("node").to_pylist()) if x not in seen and not seen.add(x)]
            if len(seen) > WORDS:
                seen.clear()
            part = part.take(pa.array(new, pa.int64()))
            h, starts = shingle_sets(part.column("text").to_pylist(), n, words)
            sets = [h[i:j].tobytes() for i, j in zip(starts, starts[1:], strict=False)]
            yield list(zip(*(part.column(c).to_pylist() for c in known), sets, strict=True))

    schema = pa.schema([("node", pa.int64()), ("super", pa.int64()), ("whole", pa.int64()), ("tile", pa.int64()), ("ks", pa.list_(pa.int64())), ("hashes", pa.binary())])
    return map_rows(small_or_salted(docs.select("text", "text_hash"), nodes, ["text_hash"], "inner").select("text", *known), work, schema)


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85, tile_points: int = TILE_POINTS, tile_shingles: int = TILE) -> DataFrame:
    """Documents (doc_id, text) that link when their ``n``-word shingle sets share ``percent`` of their union.

    1. Texts become sets of shingle hashes, dealt by hash into groups (``Levels``); sets that agree in
       nearly all of a group are candidates. Group hashes are shuffled packed, each once per batch.
    2. Candidates are put together as connected components of that relation, which holds every link.
       The group counts of their sets are points of an R-tree in each component; the sum of the
       smaller counts bounds the overlap. Pairs that pass the bound make narrower components.
    3. The sets of those are fetched, and pairs that pass the bound are compared exactly, unless links
       found before connect them. Components with many points or shingles are compared tile by tile.
    4. Links give the final components.

    Gives a row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, its own included; null ids count as largest), and text_hash and component, which name the
    text and the group. Null texts and texts without words have no shingles and link with nothing.
    Rows that repeat link with each other; other columns are not read; an empty table gives no rows.
    Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = map_rows(rows, partial(hash_documents, n=n, percent=percent, buckets=buckets), PACKED)
    found = staged(hashed.groupBy("bucket").applyInArrow(join_bucket, from_arrow_schema(FOUND)), "shingles")
    each = found.where(F.col("kind") == DOCUMENT).select("doc_id", "node", "n_shingles", "text_hash")
    supers = components(found.where(F.col("kind") == EDGES).select(F.col("node").alias("a"), F.col("other").alias("b")))
    points = found.where("counts is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n"), F.max("counts").alias("counts"))
    members = durable(supers.withColumnRenamed("component", "super").join(points, "node"))
    near = staged(links_of(tasks_of(members, F.lit(1), tile_points, percent), "counts", linked_points, percent), "near")
    groups = components(near).withColumnRenamed("component", "super")
    tasks = durable(tasks_of(durable(groups.join(members.select("node", "n", "text_hash"), "node")), F.greatest("n", F.lit(COUNTS // 8)), tile_shingles, percent))
    links = staged(links_of(candidate_sets(rows, tasks.drop("n"), n), "hashes", linked_sets, percent), "links")
    reached = durable(components(links))
    grouped = durable(small_or_salted(each, reached, ["node"], "left").withColumn("component", F.coalesce("component", "node")))
    smallest = durable(grouped.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return small_or_salted(grouped, smallest, ["component"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component"
    )


def without_near_copies(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of ``link_documents``: the one with the smallest doc_id, then text hash.

    All columns are kept. Texts stay where they are unless more groups lose documents than can be
    sent to all executors. Of rows that repeat the one that stays, one is kept.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text")]
    linked = durable(link_documents(docs, n, percent).where("component is not null"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = durable(linked.groupBy("component").agg(F.min(own).alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")
    is_first = (F.col("first.text_hash") == F.col("text_hash")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    judged = small_or_salted(linked, stays, ["component"], "inner").select(id_, F.col("text_hash").alias("_text"), is_first.alias("stays"))
    counts = durable(judged.groupBy("_id", "_text").agg(F.max("stays").alias("stays"), F.count("*").alias("copies")).where("not stays or copies > 1"))
    rows = small_or_salted(docs.select(F.struct("*").alias("_doc"), *key), counts, ["_id", "_text"], "left")
    single = rows.where("copies is null").select("_doc.*")
    repeated = rows.where("stays and copies > 1").dropDuplicates(["_id", "_text"]).select("_doc.*")
    return single.unionByName(repeated)
