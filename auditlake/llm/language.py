"""Language identification by cross-parsing: texts are cut into the longest phrases that a language's sample holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from auditlake.llm.shared import give_back, small_batches

#: Bounds of the training sample of a language: rows, characters of a row, characters of all rows together.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS = 64, 512, 1 << 15
#: Languages whose automata are in memory at once.
TOGETHER = 4
#: Letters with a class of their own; characters of a text that are parsed on their own.
LETTERS, PARSED = 200, 1024


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Up to ``rows`` labelled texts of every language, those with the lowest hashes of text and id, cut to ``row_chars`` each and ``chars`` in all.

    Held-out rows and rows without text or language are not learnt from.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = Window.partitionBy("lang").orderBy(F.xxhash64("text", "doc_id"), "doc_id")
    drawn = known.select("lang", F.row_number().over(place).alias("n"), F.substring("text", 1, row_chars).alias("part")).where(F.col("n") <= rows)
    parts = drawn.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return {r["lang"]: r["text"] for r in sorted(parts.select("lang", F.substring("text", 1, chars).alias("text")).collect(), key=lambda r: r["lang"])}


def learnt_samples(docs: DataFrame) -> dict[str, str]:
    return sample_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))


class Classes:
    """Texts as arrays of classes: 0 for what is no letter (runs count once), 1 for rare letters, and one for each other letter."""

    def __init__(self, samples: list[str]):
        letters = Counter(c for s in samples for c in s.lower() if c.isalpha())
        ranked = sorted(letters, key=lambda c: (-letters[c], c))[:LETTERS]
        self.count = 2 + len(ranked)
        self.table = np.full(0x110000, -1, np.int16)
        self.table[[ord(c) for c in ranked]] = np.arange(2, self.count)

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.table[codes]
        if (new := classes < 0).any():
            for c in np.unique(codes[new]).tolist():
                self.table[c] = int(chr(c).isalpha())
            classes = self.table[codes]
        again = (classes[1:] == 0) & (classes[:-1] == 0)
        return classes[np.concatenate(([True], ~again))] if len(classes) else classes


def automaton(text: list[int], classes: int) -> np.ndarray:
    """Suffix automaton of a sequence: its number of states, then the state * ``classes`` + class of every step, then where each leads."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in text:
        state = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = state
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    at = [s * classes + c for s, out in enumerate(follow) for c in out]
    return np.array([len(follow), *at, *(t for out in follow for t in out.values())], np.int32)


class CrossParser:
    """Counts, for many texts at once, the phrases that each language's automaton cuts them into.

    A phrase is the longest stretch that the language's sample holds; its length comes from walking
    the automaton from the root until no transition is left. Texts are walked in stretches of
    ``PARSED`` characters side by side, one array step per character; a stretch begins a new phrase.
    """

    def __init__(self, samples: dict[str, str], automata: list[np.ndarray] | None = None):
        self.names = list(samples)
        self.classes = Classes(list(samples.values()))
        width = self.classes.count
        known = [self.classes.of(text) for text in samples.values()]
        self.automata = automata or [automaton([c for c in k.tolist() if c != 1], width) for k in known]
        sizes = [int(found[0]) for found in self.automata]
        bases = np.cumsum([0, *sizes]).tolist()
        # filled in place: a worker holds the table once, also while it is made
        self.step = np.empty(bases[-1] * width, np.int32)
        for found, states, base in zip(self.automata, sizes, bases, strict=False):
            at, to = found[1:].reshape(2, -1)
            # a walk that can't go on starts a phrase with the character at hand; at the root every character does
            root = np.zeros(width, np.int32)
            root[at[at < width]] = to[at < width]
            step = self.step[base * width : (base + states) * width]
            step.reshape(states, width)[:] = (root + base) * width << 1 | 1
            step[at] = (to + base) * width << 1 | (at < width)
        self.roots = np.array(bases[:-1], np.int32) * width
        self.bits = np.log2(np.array([max(2, len(k)) for k in known], float))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases by text and language."""
        lanes = [(k, t[at : at + PARSED]) for k, t in enumerate(texts) for at in range(0, len(t), PARSED)]
        lanes.sort(key=lambda x: -len(x[1]))
        found = np.zeros((len(texts), len(self.names)), np.int64)
        if not lanes or not self.names:
            return found
        lengths = np.array([len(t) for _, t in lanes])
        grid = np.zeros((lengths[0], len(lanes)), np.int32)
        for j, (_, t) in enumerate(lanes):
            grid[: len(t), j] = t
        state = np.repeat(self.roots[:, None], len(lanes), axis=1)
        counts = np.zeros_like(state)
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for t in range(lengths[0]):
            k = active[t]
            got = self.step[state[:, :k] + grid[t, :k]]
            counts[:, :k] += got & 1
            state[:, :k] = got >> 1
        np.add.at(found, np.array([k for k, _ in lanes]), counts.T)
        return found


class Parsers:
    """Cross-parsing by any number of languages, TOGETHER at a time; the automata of the others wait in a temporary file, a few hundred KB each."""

    def __init__(self, samples: dict[str, str]):
        self.names = list(samples)
        self.parts = [{k: samples[k] for k in self.names[at : at + TOGETHER]} for at in range(0, len(self.names), TOGETHER)]
        self.only = CrossParser(samples) if len(self.parts) < 2 else None
        if self.only is None:
            import tempfile

            self.file, self.lengths = tempfile.TemporaryFile(), []
            for part in self.parts:
                automata = CrossParser(part).automata
                self.lengths.append([len(x) for x in automata])
                for x in automata:
                    self.file.write(x.tobytes())

    def parsers(self) -> Iterator[CrossParser]:
        if self.only is not None:
            yield self.only
            return
        self.file.seek(0)
        for part, lengths in zip(self.parts, self.lengths, strict=True):
            yield CrossParser(part, [np.frombuffer(self.file.read(4 * n), np.int32) for n in lengths])

    def found(self, texts: pa.Array) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """For each text its characters, whether it has a letter, and its phrases by language, plain and normalised."""
        sizes, letters, phrases, bits = [], [], [], []
        for parser in self.parsers():
            sizes, letters, counts = [], [], []
            for at in range(0, len(texts), 256):
                classes = [parser.classes.of(t or "") for t in texts.slice(at, 256).to_pylist()]
                counts.append(parser.phrases(classes))
                sizes += map(len, classes)
                letters += [bool(c.any()) for c in classes]
            if counts:
                phrases.append(np.concatenate(counts))
                bits.append(parser.bits)
        if sizes:
            plain = np.concatenate(phrases, axis=1)
            yield from zip(sizes, letters, plain, plain * np.concatenate(bits), strict=True)

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        out = []
        for _, letter, _, p in self.found(texts):
            if not len(p) or not letter:
                out.append(("und", 0.0))
                continue
            order = np.argsort(p, kind="stable")
            out.append((self.names[order[0]], 1.0 if len(p) == 1 else float(1 - p[order[0]] / p[order[1]])))
        return out

    def tell(self, texts: pa.Array) -> list[bool]:
        """Whether texts have a letter and, if more than one character, a phrase of more than one in some language."""
        return [letter and (not len(p) or size == 1 or int(p.min()) < size) for size, letter, p, _ in self.found(texts)]


def predict_language(text: Column, samples: dict[str, str]) -> Column:
    """Struct of lang_pred and score for a text column; score is by how much the best language needs fewer phrases than the next."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = Parsers(samples)
        for texts in batches:
            yield pa.array([{"lang_pred": a, "score": b} for a, b in parser.predict(texts)], kind)
        del parser
        give_back()

    return F.arrow_udf(work, "struct<lang_pred: string, score: double>", ArrowUDFType.SCALAR_ITER)(text.cast("string"))


def identify_languages(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and _found, a struct of lang_pred and score, for every row of (doc_id, text, lang).

    Learns from a bounded sample of labelled rows (``sample_texts``), then parses every whole text
    with the suffix automaton of each language; the language with the fewest phrases, normalised by
    the logarithm of its sample's size, wins (ties: by name). Null texts, texts without a letter, and
    all texts where nothing could be learnt get ``und`` and 0. Rows that repeat get equal results;
    an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(*keep, predict_language(F.col("text"), learnt_samples(docs)).alias("_found"))


def filter_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language can be told, with all their columns.

    Texts go that have no letter (nulls too), or of which no two neighbours are in any language's
    sample (``Parsers.tell``). Languages that are close to each other, or labels of equal ones,
    take no document out, and where nothing could be learnt all texts with a letter stay.
    """
    small_batches(docs.sparkSession)
    samples = learnt_samples(docs)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = Parsers(samples)
        for texts in batches:
            yield pa.array(parser.tell(texts), pa.bool_())
        del parser
        give_back()

    return docs.where(F.arrow_udf(work, "boolean", ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string")))
