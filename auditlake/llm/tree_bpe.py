"""Encoding of whole texts with byte-pair vocabularies; long texts in halves that are joined like a tree."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.llm.shared import map_rows, slices
from auditlake.llm.tokens import WordEncoder, load

#: Texts with more characters are cut in halves until parts have no more.
LEAF_CHARS = 1 << 15
#: Characters of the first window on either side of a join, and tokens in a row that both sides must share.
WINDOW, AGREE = 64, 4

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
LEAVES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.int64()), ("text", pa.string()), ("ids", pa.binary())])


@dataclass
class Node:
    """A stretch of a text and its ids when encoded alone."""

    text: str
    ids: array


def halves(text: str, leaf_chars: int) -> list[str]:
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf_chars) + halves(text[middle:], leaf_chars)


def spans(tokenizer, text: str, base: int) -> list[tuple[int, int, int]]:
    """Tokens of a text as (id, from, to), counted from ``base``."""
    found = tokenizer.encode(text, add_special_tokens=False)
    return [(i, base + a, base + b) for i, (a, b) in zip(found.ids, found.offsets, strict=True)]


def boundary(text: str, at: int, step: int) -> int:
    """The nearest single space from ``at`` on in one direction, where an encoding can begin anew; or the end of the text in that direction."""
    find = text.rfind if step < 0 else text.find
    p = at
    while True:
        p = find(" ", 0, p) if step < 0 else find(" ", p)
        if p < 0:
            return 0 if step < 0 else len(text)
        if 0 < p < len(text) - 1 and not text[p - 1].isspace() and not text[p + 1].isspace():
            return p
        p += 0 if step < 0 else 1


def shared_run(own: list[tuple], window: list[tuple], agree: int) -> tuple[int, int] | None:
    """Places in two lists of tokens where ``agree`` tokens in a row are the same; the first in the window."""
    starts: dict[tuple, int] = {}
    for i in range(len(own) - agree, -1, -1):
        starts[own[i]] = i
    for x in range(len(window) - agree + 1):
        i = starts.get(window[x], -1)
        if i >= 0 and own[i : i + agree] == window[x : x + agree]:
            return i, x
    return None


def join(tokenizer, left: Node, right: Node, width: int = WINDOW, agree: int = AGREE) -> Node:
    """Ids of two stretches together.

    The text around the join is encoded again, in windows that double until the window and the left
    side share ``agree`` tokens in a row before the join, and the window and the right side after it.
    A sequence of tokens is the encoding of its text if every two neighbours are the encoding of
    theirs, so what is put together from three encodings that overlap there is exact. A window that
    reaches the end of a side needs nothing from it.
    """
    text, at = left.text + right.text, len(left.text)
    while True:
        begin, end = max(0, at - width), min(len(text), at + width)
        window = spans(tokenizer, text[begin:end], begin)
        low, high, first, last = 0, len(right.ids), 0, len(window)
        found_left, found_right = begin == 0, end == len(text)
        if not found_left:
            cut = boundary(left.text, begin, -1)
            tail = spans(tokenizer, left.text[cut:], cut)
            run = shared_run([t for t in tail if t[2] <= at], [t for t in window if t[2] <= at], agree)
            if run:
                found_left, low, first = True, len(left.ids) - len(tail) + run[0] + agree, run[1] + agree
        else:
            low = 0
        if found_left and not found_right:
            cut = boundary(right.text, end - at, 1)
            head = spans(tokenizer, right.text[:cut], at)
            skipped = sum(t[1] < at for t in window)
            # the last tokens of a window may be cut off: what agrees before them counts
            run = shared_run(head, window[skipped:], agree)
            if run:
                found_right, high, last = True, run[0], skipped + run[1]
        if found_left and found_right and first <= last:
            kept = right.ids[high:] if end < len(text) else array("I")
            return Node(text, left.ids[:low] + array("I", [t[0] for t in window[first:last]]) + kept)
        width *= 2


def joined(tokenizer, nodes: list[Node]) -> Node:
    while len(nodes) > 1:
        pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
        nodes = [join(tokenizer, *p) if len(p) == 2 else p[0] for p in pairs]
    return nodes[0]


class Writer:
    """Ids and decoded text of a row as strings."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.plain = json.loads(tokenizer.to_str())["decoder"] is None

    def row(self, doc_id: int | None, ids: array) -> tuple:
        # without a decoder, decoding puts a space between tokens
        decoded = " ".join(map(self.tokens.__getitem__, ids)) if self.plain else self.tokenizer.decode(list(ids), skip_special_tokens=False)
        return doc_id, len(ids), " ".join(map(self.numbers.__getitem__, ids)), decoded


def encode_documents(docs: DataFrame, tokenizer: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode every whole text of (doc_id, text) as the tokenizers library does without special tokens added.

    For vocabularies that drop white space. Texts of up to ``leaf_chars`` characters are encoded
    where they are. Longer ones are cut in halves down to that length; the parts are dealt out evenly
    and encoded in parallel, then the parts of a text meet again and are joined like a tree
    (``join``). Gives doc_id, n_tokens, ids (decimal, with a space between) and decoded.

    Null text is empty: no ids, empty decoded text. Rows that repeat are encoded each; null doc_ids
    are kept; other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    long = F.length("text") > leaf_chars

    def numbers(data: bytes) -> array:
        out = array("I")
        out.frombytes(data)
        return out

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        encoder = WordEncoder(tokenizer)
        writer = Writer(encoder.tokenizer)
        for part in slices(batches):
            ids = encoder.encode(part.column("text").to_pylist())
            yield [writer.row(k, numbers(i)) for k, i in zip(part.column("doc_id").to_pylist(), ids, strict=True)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for part in slices(batches, 16):
            for row, doc_id, t in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                yield [(row, doc_id, k, leaf, None) for k, leaf in enumerate(halves(t, leaf_chars))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        encoder = WordEncoder(tokenizer)
        for part in slices(batches, 64):
            row, doc_id, leaf, texts = (part.column(c).to_pylist() for c in ("row", "doc_id", "leaf", "text"))
            yield list(zip(row, doc_id, leaf, texts, encoder.encode(texts), strict=True))

    loaded: list[Writer] = []

    def meet(group: pa.Table) -> pa.Table:
        if not loaded:
            loaded.append(Writer(load(tokenizer)))
        writer, group = loaded[0], group.sort_by("leaf")
        nodes = [Node(t, numbers(i)) for t, i in zip(group.column("text").to_pylist(), group.column("ids").to_pylist(), strict=True)]
        row = writer.row(group.column("doc_id")[0].as_py(), joined(writer.tokenizer, nodes).ids)
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, ENCODED.types, strict=True)], schema=ENCODED)

    short = map_rows(rows.where(~long), whole, ENCODED)
    cut_up = map_rows(rows.where(long).withColumn("row", F.monotonically_increasing_id()), cut, LEAVES).hint("rebalance")
    met = map_rows(cut_up, encode, LEAVES).groupBy("row").applyInArrow(meet, from_arrow_schema(ENCODED))
    return short.unionByName(met)
