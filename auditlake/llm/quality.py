"""Quality rules with thresholds learnt per language and source from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from auditlake.llm.shared import give_back, small_batches, small_or_salted
from auditlake.operators.durable import durable

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rates are counted in units of 1 / UNIT; a sketch keeps them to DIGITS binary digits.
UNIT, DIGITS = 4096, 8
#: rate: (dividend, divisor, least half spread in units, whether low values are outliers too)
RATES = {
    "word_length": ("word_chars", "n_words", 410, True),
    "symbols": ("n_symbols", "n_words", 66, False),
    "dup_lines": ("n_dup_lines", "n_lines", 164, False),
    "repeats": ("n_repeat_words", "n_words", 131, False),
}
#: Half spreads from the median to a fence, and rows a group needs to have fences of its own.
FENCE, LEAST_ROWS = 15, 100
LEAST_WORDS, REPEAT_PERCENT = 50, 50

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; words are what stands between ASCII white space."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0, 0
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    return n, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = ids[:-2] * len(known) + ids[1:-1]
    if len(known) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    for k in (order[1:][same], order[:-1][same]):
        for step in range(3):
            again[k + step] = True
    return int(again.sum())


def text_counts(text: Column) -> Column:
    """COUNTS of a text column as a struct of longs."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [count_text(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            yield pa.array([dict(zip(COUNTS, r, strict=True)) for r in rows], kind)
        give_back()

    return F.arrow_udf(work, "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">", ArrowUDFType.SCALAR_ITER)(text.cast("string"))


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


def rate(counts: Column, name: str) -> Column:
    """A rate in units, rounded down; 0 where its divisor is 0."""
    above, below = (counts[c] for c in RATES[name][:2])
    return F.when(below > 0, (above * UNIT - F.pmod(above * UNIT, below)) / below).otherwise(0).cast("long")


def bucket(value: Column) -> Column:
    """The value without its binary digits after the first DIGITS: what a sketch keeps of it."""
    lost = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, lost), lost)


def sketches(counted: DataFrame) -> DataFrame:
    """Counts per language, source, rate and bucket of rows that pass the base rules. Adding counts merges sketches.

    ``counted`` has _lang, _source and _counts.
    """
    values = F.array(*[F.struct(F.lit(n).alias("rate"), bucket(rate(F.col("_counts"), n)).alias("low")) for n in RATES])
    rows = counted.where(~base_failed(F.col("_counts"))).select("_lang", "_source", F.explode(values).alias("v"))
    return rows.groupBy("_lang", "_source", "v.rate", "v.low").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """A row per language and source with the bounds of each rate.

    Bounds are the median plus, and for word length minus, FENCE times the smaller of the two half
    spreads (median to quartile), which must not be under a least one. A group with fewer than
    ``least_rows`` rows uses the merged sketch of its language, or else that of all rows.
    """
    leaf = sketch.select("_lang", "_source", "rate", "low", "n")
    levels = (
        leaf.withColumn("level", F.lit(0))
        .unionByName(leaf.groupBy("_lang", "rate", "low").agg(F.sum("n").alias("n")).withColumns({"_source": F.lit(""), "level": F.lit(1)}))
        .unionByName(leaf.groupBy("rate", "low").agg(F.sum("n").alias("n")).withColumns({"_lang": F.lit(""), "_source": F.lit(""), "level": F.lit(2)}))
    )
    group = Window.partitionBy("level", "_lang", "_source", "rate")
    running = levels.withColumns({"upto": F.sum("n").over(group.orderBy("low")), "rows": F.sum("n").over(group)})
    quarter = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("low")))
    quartiles = running.groupBy("level", "_lang", "_source", "rate").agg(F.first("rows").alias("rows"), *[quarter(k).alias(f"q{k}") for k in (1, 2, 3)])
    least = F.element_at(F.create_map(*[x for n, r in RATES.items() for x in (F.lit(n), F.lit(r[2]))]), F.col("rate"))
    spread = F.greatest(F.least(F.expr("q2 - q1"), F.expr("q3 - q2")), least) * FENCE
    bounds = quartiles.groupBy("level", "_lang", "_source").agg(
        F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("rate", F.struct((F.col("q2") - spread).alias("low"), (F.col("q2") + spread).alias("high"))))).alias("bounds")
    )
    level = lambda k, *keys: bounds.where(F.col("level") == k).select(*keys, F.col("rows").alias(f"rows{k}"), F.col("bounds").alias(f"bounds{k}"))
    own = F.when(F.col("rows0") >= least_rows, F.col("bounds0")).when(F.col("rows1") >= least_rows, F.col("bounds1")).otherwise(F.col("bounds2"))
    return level(0, "_lang", "_source").join(level(1, "_lang"), "_lang").crossJoin(F.broadcast(level(2))).select("_lang", "_source", own.alias("_bounds"))


def verdict(counts: Column, bounds: Column) -> Column:
    """Whether a row passes the base rules and lies within all bounds of its group."""
    within = []
    for name, (_, _, _, low_too) in RATES.items():
        b = F.element_at(bounds, name)
        within.append(rate(counts, name) <= b["high"])
        if low_too:
            within.append(rate(counts, name) >= b["low"])
    return F.coalesce(~base_failed(counts) & F.forall(F.array(*within), lambda x: x), F.lit(False))


def counted(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, and for each row its group and its counts."""
    small_batches(docs.sparkSession)
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(*keep, group("lang").alias("_lang"), group("source").alias("_source"), text_counts(F.col("text")).alias("_counts"))


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return small_or_salted(rows, bounds, ["_lang", "_source"], "left").withColumn("kept", verdict(F.col("_counts"), F.col("_bounds")))


def judge_quality(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Counts and verdict for every row of (doc_id, text, lang, source).

    Texts are read once; their counts are written, summed into sketches per language and source, and
    joined with the bounds that follow. Null or empty text: no words, so it fails. Null and empty
    languages or sources are one group. Rows that repeat count each; other columns are not read. An
    empty table gives no rows.
    """
    rows = durable(counted(docs, F.col("doc_id").cast("long")))
    bounds = durable(fences(sketches(rows), least_rows))
    return judged(rows, bounds).select("doc_id", "_counts.*", base_failed(F.col("_counts")).alias("base_failed"), "kept")


def filter_quality(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns.

    Texts are counted twice, once for the sketches and once for the verdict, instead of being shuffled.
    """
    bounds = durable(fences(sketches(counted(docs)), least_rows))
    return judged(counted(docs, F.struct("*").alias("_doc")), bounds).where("kept").select("_doc.*")
