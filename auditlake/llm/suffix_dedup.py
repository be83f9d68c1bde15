"""Removal of repeated byte strings of whole texts, found by sorting suffixes that are compared by hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.llm.shared import map_rows, slices, small_batches, staged

#: Bytes that a repeated string has at least, and of the grams that stand for it.
LENGTH, GRAM = 100, 24
#: Bytes of a block of texts, and of a stretch whose grams are hashed at once.
BLOCK, STRETCH = 4 << 20, 1 << 18
#: Places of a gram in all texts from which on its strings are looked for one by one.
HOT = 2048
#: Windows and bytes of spans that are compared at once, as far as groups allow.
WINDOWS, BYTES = 1 << 18, 1 << 21
#: Bytes of rows with blocks that go to a Python worker at once.
BATCH = "16m"

BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: A number for every byte.
LETTERS = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PACKED = pa.list_(pa.struct([("bucket", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())]))
BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("tie", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("data", pa.binary()), ("grams", PACKED)]
)
SHARED = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("total", pa.binary())])
#: Spans of texts: the key of their group, windows before the gram, windows, place in the block, and what orders documents.
SPAN = [("key", "<u8"), ("lead", "<i4"), ("windows", "<i4"), ("at", "<i8"), ("doc_id", "<i8"), ("none", "<i1"), ("tie", "<i8"), ("offset", "<i8")]
RUNS = pa.binary()
SPANS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("spans", pa.binary()), ("data", pa.binary())])
LOCAL = pa.schema([("block", pa.int64()), ("runs", RUNS), ("cold", pa.list_(pa.struct(list(SPANS)[1:]))), ("hot", pa.struct(list(SPANS)[2:])), ("hot_keys", PACKED)])
FLAGS = pa.schema([("block", pa.int64()), ("runs", RUNS)])
KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)


KNOWN_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    if len(KNOWN_POWERS.get(base, ())) < size:
        out = np.full(1 << size.bit_length(), base, np.uint64)
        out[0] = 1
        KNOWN_POWERS[base] = out.cumprod(dtype=np.uint64)
    return KNOWN_POWERS[base]


class Prefixes:
    """Bytes with polynomial hashes of all their prefixes, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.back = powers(INVERSE, len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), (LETTERS[data] * powers(BASE, len(data) + 1)[: len(data)]).cumsum(dtype=np.uint64)))

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def grams(self, length: int) -> np.ndarray:
        """Mixed hashes of all stretches of one length."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.data) - length + 1])

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, up to ``most``, two suffixes share from their start: binary search over hashes of their prefixes."""
        same = np.where(self.hash(a, most) == self.hash(b, most), most, 0)
        left = np.flatnonzero(same == 0)
        x, y, step = a[left], b[left], 1 << (most.bit_length() - 1)
        known = np.zeros(len(left), np.int64)
        while step:
            fits = known + step <= most
            p, q = np.where(fits, x + known, 0), np.where(fits, y + known, 0)
            known += step * (fits & (self.hash(p, step) == self.hash(q, step)))
            step >>= 1
        same[left] = known
        return same

    def compare(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``a``, cut at ``length``, is before, like or after that at ``b``."""
        same = self.common(a, b, length)
        over = same >= length
        last = len(self.data) - 1
        return np.where(over, 0, np.sign(self.data[np.minimum(a + same, last)].astype(np.int16) - self.data[np.minimum(b + same, last)]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sort_suffixes(text: Prefixes, start: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """A stable mergesort of suffixes, cut at ``length``, within segments (equal neighbours of ``segment``); gives their order.

    All segments are merged at once: every suffix finds its place among the run it is merged with by
    binary search, and every comparison is one of hashes.
    """
    n = len(start)
    order, slot = np.arange(n), np.arange(n)
    edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sizes = np.diff(np.append(edge, n))
    first, end = np.repeat(edge, sizes), np.repeat(edge + sizes, sizes)
    width = 1
    while width < sizes.max(initial=0):
        run = (slot - first) // width
        pair = first + (run - run % 2) * width
        left = run % 2 == 0
        sibling = np.where(left, pair + width, pair)
        own = np.flatnonzero(sibling < end)
        low, high = sibling[own], np.minimum(sibling[own] + width, end[own])
        at, before = start[order[own]], left[own]
        open_ = np.arange(len(own))
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            sign = text.compare(start[order[middle]], at[open_], length)
            right = (sign < 0) | ((sign == 0) & ~before[open_])
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        merged = order.copy()
        merged[pair[own] + (own - first[own]) % width + low - sibling[own]] = order[own]
        order = merged
        width *= 2
    return order


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether strings of one length are equal, and whether the first is not after the second: byte by byte."""
    equal, ordered = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 13):
        some = slice(i, i + (1 << 13))
        x, y = (data[p[some, None] + np.arange(length)] for p in (a, b))
        differ = x != y
        equal[some] = ~differ.any(axis=1)
        k, rows = differ.argmax(axis=1), np.arange(len(x))
        ordered[some] = equal[some] | (x[rows, k] < y[rows, k])
    return equal, ordered


def equal_windows(text: Prefixes, start: np.ndarray, segment: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within segments and a class for each in that order; equal strings have one class.

    Neighbours are verified byte by byte. If all are in order the sort is right, whatever hashes
    collided; a segment that is not in order is sorted by its bytes.
    """
    order = sort_suffixes(text, start, segment, length)
    sorted_ = start[order]
    inside = segment[1:] == segment[:-1]
    equal, ordered = np.zeros(len(start), bool), np.ones(len(start), bool)
    where = np.flatnonzero(inside) + 1
    equal[where], ordered[where] = same_bytes(text.data, sorted_[where - 1], sorted_[where], length)
    for wrong in np.unique(segment[~ordered]):
        own = np.flatnonzero(segment == wrong)
        string = {int(k): text.data[start[k] : start[k] + length].tobytes() for k in own}
        order[own] = sorted(own.tolist(), key=string.__getitem__)
        equal[own[1:]] = [string[int(a)] == string[int(b)] for a, b in zip(order[own[:-1]], order[own[1:]], strict=True)]
    return order, (~equal).cumsum()


def repeated(data: np.ndarray, spans: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of each span, one span after the other, also starts earlier in another one.

    Only windows at the same distance from the gram of spans with the same key can be equal. Spans
    that are equal as wholes are told by hash and verified; the windows of one span of each kind are
    sorted as suffixes. ``begin`` is the place of spans in ``data``.
    """
    windows = spans["windows"].astype(np.int64)
    starts = windows.cumsum() - windows
    out = np.zeros(int(windows.sum()), bool)
    if not len(spans):
        return out
    rank = ranks(spans["none"], spans["doc_id"], spans["tie"], spans["offset"])
    whole = span_hashes(data, begin, windows + length - 1)
    order = np.lexsort((rank, whole, windows, spans["lead"], spans["key"]))
    kind = changes(*(v[order] for v in (whole, windows, spans["lead"], spans["key"])))
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(np.diff(kind, prepend=-1))][kind]
    for n in np.unique(windows):
        some = np.flatnonzero((windows == n) & (first != np.arange(len(first))))
        equal, _ = same_bytes(data, begin[some], begin[first[some]], int(n) + length - 1)
        first[some[~equal]] = some[~equal]
    # windows of spans that are the first of their kind, where a key has several kinds
    single = np.flatnonzero(first == np.arange(len(first)))
    single = single[np.lexsort((rank[single], spans["key"][single]))]
    group = changes(spans["key"][single])
    single = single[np.bincount(group)[group] > 1]
    sizes = windows[single] + length - 1
    text = Prefixes(cut_out(data, begin[single], sizes))
    place_of = np.zeros(len(spans), np.int64)
    place_of[single] = sizes.cumsum() - sizes
    which = np.repeat(single, windows[single])
    step = np.arange(len(which)) - np.repeat(windows[single].cumsum() - windows[single], windows[single])
    lead = spans["lead"][which] - step
    place = np.lexsort((rank[which] + step, lead, spans["key"][which]))
    which, step, lead = which[place], step[place], lead[place]
    segment = changes(lead, spans["key"][which])
    many = np.bincount(segment)[segment] > 1 if len(segment) else np.zeros(0, bool)
    which, step, segment = which[many], step[many], segment[many]
    order, classes = equal_windows(text, place_of[which] + step, segment, length)
    own_rank = (rank[which] + step)[order]
    least = own_rank[np.flatnonzero(np.diff(classes, prepend=-1))][classes - classes[0]] if len(classes) else own_rank
    out[(starts[which] + step)[order]] = own_rank > least
    # and all copies of such spans
    copies = np.flatnonzero(first != np.arange(len(first)))
    which = np.repeat(copies, windows[copies])
    step = np.arange(len(which)) - np.repeat(windows[copies].cumsum() - windows[copies], windows[copies])
    out[starts[which] + step] = out[starts[first[which]] + step] | (rank[which] > rank[first[which]])
    return out


def span_hashes(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of whole spans, as many at once as BYTES allow."""
    out, total, at = [np.zeros(0, np.uint64)], sizes.cumsum(), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES, "right")), at + 1)
        own = sizes[at:to]
        out.append(Prefixes(cut_out(data, begin[at:to], own)).hash(own.cumsum() - own, own))
        at = to
    return np.concatenate(out)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal rows, from 0."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new.cumsum()


def by_value(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each value and where it is."""
    order = np.argsort(values, kind="stable")
    each, at = np.unique(values[order], return_index=True)
    return list(zip(each.tolist(), np.split(order, at[1:]), strict=True)) if len(each) else []


def ranks(none: np.ndarray, doc_id: np.ndarray, tie: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Places in the order of documents (null ids last, ties by their texts' hash) and of bytes in them, so that windows of one document keep their distances."""
    order = np.lexsort((offset, tie, doc_id, none))
    doc = changes(none[order], doc_id[order], tie[order])
    out = np.empty(len(order), np.int64)
    out[order] = (doc << 40) + offset[order]
    return out


def gram_spans(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes within documents, as spans that have the same least gram: first window, windows, windows before the gram, its hash.

    Equal windows have the same gram at the same place, as it is the leftmost of those with the least hash.
    """
    n, bits = len(data), np.uint64(STRETCH.bit_length())
    inside = np.zeros(n + 1, np.int32)
    ends = sizes.cumsum()
    some = sizes >= length
    np.add.at(inside, (ends - sizes)[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    inside = inside.cumsum()[:n] > 0
    found = []
    for at in range(0, n - length + 1, STRETCH):
        piece = data[at : at + STRETCH + length - 1]
        h = Prefixes(piece).grams(gram)
        least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        width, reach = 1, length - gram + 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        valid = inside[at : at + len(place)]
        first = valid.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        first = np.flatnonzero(first)
        last = valid.copy()
        last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
        windows = np.flatnonzero(last) - first + 1
        found.append((at + first, windows, place[first] - first, h[place[first]]))
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else none


def pack(keys: np.ndarray, times: np.ndarray, buckets: int) -> list[dict]:
    """Distinct keys of a block and how often it has them, by bucket."""
    keys, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, times, len(keys)).astype("<u4")
    return [{"bucket": b, "keys": keys[k].tobytes(), "times": total[k].tobytes()} for b, k in by_value(keys % np.uint64(buckets))]


def shared_keys(blocks: DataFrame, column: str) -> DataFrame:
    """(block, keys, total): packed keys of a block that other blocks have too, and how often all have them.

    A key is shuffled once for each block that has it, however often it occurs there.
    """

    def meet(group: pa.Table) -> pa.Table:
        block = group.column("block").to_numpy()
        parts = [np.frombuffer(k.as_py(), "<u8") for k in group.column("keys")]
        times = np.concatenate([np.frombuffer(t.as_py(), "<u4") for t in group.column("times")])
        who = np.repeat(np.arange(len(block)), [len(p) for p in parts])
        keys, inverse, blocks_ = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        total = np.minimum(np.bincount(inverse, times, len(keys)), (1 << 32) - 1).astype("<u4")
        several = blocks_[inverse] > 1
        inverse = inverse[several]
        rows = [(int(block[w]), keys[inverse[k]].tobytes(), total[inverse[k]].tobytes()) for w, k in by_value(who[several])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), SHARED.types, strict=True)], schema=SHARED)

    each = blocks.select("block", F.explode(column).alias("part")).select("block", "part.*")
    found = each.groupBy("bucket").applyInArrow(meet, from_arrow_schema(SHARED))
    return found.groupBy("block").agg(F.collect_list(F.struct("keys", "total")).alias("shared"))


def unpacked(shared: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and totals of a block."""
    keys = np.frombuffer(b"".join(s["keys"] for s in shared or ()), "<u8")
    total = np.frombuffer(b"".join(s["total"] for s in shared or ()), "<u4")
    order = np.argsort(keys)
    return keys[order], total[order]


def among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether values are among sorted keys, and where."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return (keys[at] == values if len(keys) else np.zeros(len(values), bool)), at


def flagged_runs(at: np.ndarray, windows: np.ndarray, flags: np.ndarray) -> bytes:
    """Places of flagged windows in a block as runs (first, last)."""
    starts = windows.cumsum() - windows
    places = np.sort((np.repeat(at - starts, windows) + np.arange(len(flags)))[flags])
    edge = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    last = np.append(edge[1:], len(places)) - 1 if len(edge) else edge
    return np.stack((places[edge], places[last]), axis=1).astype("<i8").tobytes()


def unflagged_spans(spans: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """What is left of spans without flagged windows: a span for each run of the others."""
    windows = spans["windows"].astype(np.int64)
    which = np.repeat(np.arange(len(spans)), windows)
    step = np.arange(len(which)) - np.repeat(windows.cumsum() - windows, windows)
    free = np.flatnonzero(~flags)
    new = np.ones(len(free), bool)
    new[1:] = (which[free[1:]] != which[free[:-1]]) | (free[1:] != free[:-1] + 1)
    head = free[new]
    out = spans[which[head]].copy()
    for name, sign in (("lead", -1), ("at", 1), ("offset", 1)):
        out[name] += (sign * step[head]).astype(out[name].dtype)
    out["windows"] = np.diff(np.append(np.flatnonzero(new), len(free)))
    return out


def cut_out(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of some stretches, one after the other."""
    return data[np.repeat(begin - (sizes.cumsum() - sizes), sizes) + np.arange(int(sizes.sum()))]


def judged(data: np.ndarray, spans: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """``repeated`` for spans sorted by key, some whole keys at a time. Keys of a single span need no comparison."""
    windows = spans["windows"].astype(np.int64)
    total = windows.cumsum()
    ends = np.append(np.flatnonzero(spans["key"][1:] != spans["key"][:-1]) + 1, len(spans)) if len(spans) else np.zeros(0, np.int64)
    several = np.diff(ends, prepend=0) > 1
    out, at = [np.zeros(0, bool)], 0
    while at < len(spans):
        k = np.searchsorted(total[ends - 1], (total[at - 1] if at else 0) + WINDOWS, "right")
        to = max(int(ends[k - 1]) if k else 0, int(ends[np.searchsorted(ends, at, "right")]))
        first, last = np.searchsorted(ends, (at, to), "right")
        own = at + np.flatnonzero(np.repeat(several[first:last], np.diff(ends, prepend=0)[first:last]))
        flags = np.zeros(int(windows[at:to].sum()), bool)
        starts = windows[at:to].cumsum() - windows[at:to]
        n = windows[own]
        flags[np.repeat(starts[own - at] - (n.cumsum() - n), n) + np.arange(int(n.sum()))] = repeated(data, spans[own], begin[own], length)
        out.append(flags)
        at = to
    return np.concatenate(out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Remove every byte of (doc_id, text) that a string of ``length`` bytes covers which also starts earlier.

    Texts are UTF-8 bytes, matches don't cross documents, and strings are judged on the input. Earlier
    is a smaller doc_id, or an earlier start in the same document.

    1. Texts are put in blocks next to texts with the same least gram, so most copies share a block.
       A window of ``length`` bytes is found by its least gram; windows in a row with the same one are a span.
    2. Within a block, the windows of spans with the same gram are sorted as suffixes
       (``sort_suffixes``); of equal ones all but the first are flagged.
    3. Grams that other blocks have too are found by one packed shuffle. What is left of their spans
       is sent on by gram and sorted the same way. A gram at more than ``hot`` places is first split
       into its windows, and those are sent that another block has: by their own hash, so that
       a group holds equal strings, at most one from each block.
    4. Flags go back to the blocks, whose texts are cut.

    Gives doc_id, n_bytes, spans (maximal removed runs: begin, end) and kept (the other bytes). Null text
    is empty; null doc_ids come last; rows with the same doc_id are ordered by the hash of their
    texts, and rows that repeat are one document, with the same result each. Other columns are not
    read; an empty table gives no rows. Long texts are hashed in stretches.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    gram = min(gram, length)

    def sketch(texts: pa.Array) -> pa.Array:
        least = []
        for t in texts:
            own = np.frombuffer(t.as_buffer(), np.uint8) if len(t.as_buffer()) else np.zeros(0, np.uint8)
            parts = [Prefixes(own[k : k + STRETCH + gram]).grams(gram).min() for k in range(0, max(len(own) - gram + 1, 0), STRETCH)]
            least.append(int(min(parts)) - (1 << 63) if parts else -(1 << 63))
        return pa.array(least, pa.int64())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        from zstandard import ZstdCompressor

        number, pending, size = TaskContext.get().partitionId() << 40, [], 0

        def row() -> tuple:
            data = b"".join(t for *_, t in pending)
            sizes = np.array([len(t) for *_, t in pending], np.int64)
            *_, h = gram_spans(np.frombuffer(data, np.uint8), sizes, length, gram)
            packed = pack(h, np.ones(len(h), np.int64), buckets)
            return number, [d for d, *_ in pending], [t for _, t, _ in pending], sizes, ZstdCompressor(level=3).compress(data), packed

        for part in slices(batches):
            for doc in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tie", "data")), strict=True):
                pending.append(doc)
                size += len(doc[2])
                if size >= block:
                    yield [row()]
                    number, pending, size = number + 1, [], 0
        if pending:
            yield [row()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for own in batch.to_pylist():
                data, sizes = opened(own)
                at, windows, lead, h = gram_spans(data, sizes, length, gram)
                doc = np.searchsorted(sizes.cumsum(), at, "right")
                spans = np.zeros(len(at), SPAN)
                ids = np.array([0 if d is None else d for d in own["doc_id"]], np.int64)
                none = np.array([d is None for d in own["doc_id"]], np.int8)
                values = (h, lead, windows, at, ids[doc], none[doc], np.array(own["tie"], np.int64)[doc], at - (sizes.cumsum() - sizes)[doc])
                for (name, _), v in zip(SPAN, values, strict=True):
                    spans[name] = v
                spans = spans[np.argsort(spans["key"], kind="stable")]
                flags = judged(data, spans, spans["at"], length)
                runs = flagged_runs(spans["at"], spans["windows"].astype(np.int64), flags)
                keys, total = unpacked(own["shared"])
                known, place = among(spans["key"], keys)
                rest = unflagged_spans(spans[known], flags[np.repeat(known, spans["windows"])])
                many = total[among(rest["key"], keys)[1]] > hot if len(rest) else np.zeros(0, bool)
                common = rest[many]
                hashes = window_hashes(data, common, length)
                yield [(own["block"], runs, packed_spans(data, rest[~many]), whole_spans(data, common) if len(common) else None, pack(hashes, np.ones(len(hashes), np.int64), buckets))]

    def opened(own: dict) -> tuple[np.ndarray, np.ndarray]:
        from zstandard import ZstdDecompressor

        sizes = np.array(own["size"], np.int64)
        return np.frombuffer(ZstdDecompressor().decompress(own["data"]), np.uint8) if sizes.sum() else np.zeros(0, np.uint8), sizes

    def whole_spans(data: np.ndarray, spans: np.ndarray) -> dict:
        sizes = spans["windows"].astype(np.int64) + length - 1
        return {"spans": spans.tobytes(), "data": cut_out(data, spans["at"], sizes).tobytes()}

    def packed_spans(data: np.ndarray, spans: np.ndarray) -> list[dict]:
        return [{"bucket": b} | whole_spans(data, spans[k]) for b, k in by_value(spans["key"] % np.uint64(buckets))]

    def window_hashes(data: np.ndarray, spans: np.ndarray, length: int) -> np.ndarray:
        windows = spans["windows"].astype(np.int64)
        out = [mixed(Prefixes(data[a : a + n + length - 1]).hash(np.arange(n), length)) for a, n in zip(spans["at"].tolist(), windows.tolist(), strict=True)]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Windows of common grams that other blocks have, as spans of their own."""
        for batch in batches:
            for own in batch.to_pylist():
                spans = np.frombuffer(own["hot"]["spans"], SPAN)
                data = np.frombuffer(own["hot"]["data"], np.uint8)
                windows = spans["windows"].astype(np.int64)
                begin = (windows + length - 1).cumsum() - (windows + length - 1)
                which = np.repeat(np.arange(len(spans)), windows)
                step = np.arange(len(which)) - np.repeat(windows.cumsum() - windows, windows)
                moved = spans.copy()
                moved["at"] = begin
                one = spans[which].copy()
                one["key"], one["lead"], one["windows"] = window_hashes(data, moved, length), 0, 1
                one["at"] += step
                one["offset"] += step
                known, _ = among(one["key"], unpacked(own["shared"])[0])
                one, place = one[known], (begin[which] + step)[known]
                yield [(own["block"], b, one[k].tobytes(), cut_out(data, place[k], np.full(len(k), length)).tobytes()) for b, k in by_value(one["key"] % np.uint64(buckets))]

    def judge(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(s.as_py(), SPAN) for s in group.column("spans")]
        data = np.frombuffer(b"".join(d.as_py() for d in group.column("data")), np.uint8)
        spans = np.concatenate(parts)
        who = np.repeat(group.column("block").to_numpy(), [len(p) for p in parts])
        sizes = spans["windows"].astype(np.int64) + length - 1
        begin = sizes.cumsum() - sizes
        order = np.argsort(spans["key"], kind="stable")
        spans, who = spans[order], who[order]
        flags = judged(data, spans, begin[order], length)
        windows = spans["windows"].astype(np.int64)
        hit = np.add.reduceat(flags, windows.cumsum() - windows) > 0
        flags, spans, windows, who = flags[np.repeat(hit, windows)], spans[hit], windows[hit], who[hit]
        starts = windows.cumsum() - windows
        rows = []
        for b, k in by_value(who):
            own = np.repeat(starts[k] - (windows[k].cumsum() - windows[k]), windows[k]) + np.arange(int(windows[k].sum()))
            rows.append((b, flagged_runs(spans["at"][k], windows[k], flags[own])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], []), FLAGS.types, strict=True)], schema=FLAGS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for own in batch.to_pylist():
                data, sizes = opened(own)
                ends = sizes.cumsum()
                runs = np.frombuffer(b"".join(own["flags"] or ()), "<i8").reshape(-1, 2)
                gone = np.zeros(len(data) + 1, np.int32)
                np.add.at(gone, runs[:, 0], 1)
                np.add.at(gone, runs[:, 1] + length, -1)
                gone = gone.cumsum()[: len(data)] > 0
                rows = []
                for doc_id, a, b in zip(own["doc_id"], (ends - sizes).tolist(), ends.tolist(), strict=True):
                    mine = np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=0, append=0))
                    spans = [{"begin": x, "end": y} for x, y in mine.reshape(-1, 2).tolist()]
                    rows.append((doc_id, b - a, spans, data[a:b][~gone[a:b]].tobytes() if spans else data[a:b].tobytes()))
                yield rows

    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("data"))
    near = rows.withColumn("near", F.arrow_udf(sketch, "long")("data")).repartitionByRange("near", "doc_id", "tie").sortWithinPartitions("near", "doc_id", "tie")
    blocks = staged(map_rows(near.drop("near"), gather, BLOCKS), "repeat-blocks")
    own = blocks.select("block", "doc_id", "tie", "size", "data")
    local = staged(map_rows(own.join(shared_keys(blocks, "grams"), "block", "left"), compare, LOCAL), "repeat-local")
    single = local.where("hot is not null").select("block", "hot").join(shared_keys(local, "hot_keys"), "block")
    cold = local.select("block", F.explode("cold").alias("part")).select("block", "part.*")
    sent = cold.unionByName(map_rows(single, single_windows, SPANS))
    flags = local.select("block", "runs").unionByName(sent.groupBy("bucket").applyInArrow(judge, from_arrow_schema(FLAGS)))
    merged = flags.groupBy("block").agg(F.collect_list("runs").alias("flags"))
    return map_rows(own.join(merged, "block", "left"), cut, KEPT)
