"""Removal of lines that stand on many sites, found with sketches of the sites of each line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from auditlake.llm.shared import BROADCAST_ROWS, give_back, small_batches, small_or_salted, staged
from auditlake.llm.shingle_join import link_documents
from auditlake.operators.durable import durable

#: Sites from which on a line is boilerplate, and words from which on a line is looked at.
LEAST_SITES, LEAST_WORDS = 5, 3
#: A sketch's relative standard deviation, and how many of them around the threshold are counted exactly.
DEVIATION, BAND = 0.1, 4.0
#: Part of a document's characters; where more would go, the document is a copy and not one with boilerplate.
MOST_REMOVED = 0.5
#: Part of a document's characters from which on it is looked at whether it is a copy; near copies of documents over MOST_REMOVED are well above it.
COPY_PART = 0.25

SPACES = " \t\x0b\x0c\r"
SALTS = ("line", "line again")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(line: Column) -> list[Column]:
    """Two hashes that stand for a line without its outer white space."""
    bare = F.btrim(line, F.lit(SPACES))
    return [F.xxhash64(F.lit(s), bare).alias(f"k{i}") for i, s in enumerate(SALTS)]


def is_looked_at(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= LEAST_WORDS


def site_lines(docs: DataFrame) -> DataFrame:
    """A row per line that is looked at: its hashes and the site, null sites as one site."""
    each = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.explode(lines(F.col("text").cast("string"))).alias("line"))
    return each.where(is_looked_at(F.col("line"))).select(*line_keys(F.col("line")), "site")


def spread_lines(docs: DataFrame, least_sites: int = LEAST_SITES, deviation: float = DEVIATION, band: float = BAND) -> DataFrame:
    """Hashes of the lines that stand on at least ``least_sites`` sites: k0, k1 and sites.

    Sites of a line are counted in a HyperLogLog sketch per line hash; sketches are merged by the
    aggregate, before and after the shuffle, so a frequent line costs one row per task. Lines that
    occur less often than ``least_sites`` are out; lines whose estimate is more than ``band`` standard
    deviations over the threshold are in, with the estimate; those near it are counted exactly.
    """
    pairs = site_lines(docs)
    margin = band * deviation
    sketched = durable(
        pairs.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.approx_count_distinct("site", deviation).alias("estimate"))
        .where((F.col("n") >= least_sites) & (F.col("estimate") >= least_sites * (1 - margin)))
        .select("k0", "k1", "estimate")
    )
    sure = F.col("estimate") > least_sites * (1 + margin)
    near = sketched.where(~sure).select("k0", "k1")
    return durable(sketched.where(sure).select("k0", "k1", F.col("estimate").alias("sites")).unionByName(count_sites(pairs, near, least_sites)))


def count_sites(pairs: DataFrame, some: DataFrame, least_sites: int) -> DataFrame:
    """Those of some written lines (k0, k1) that stand on at least ``least_sites`` sites of ``pairs``, counted exactly."""
    few = some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    counted = pairs.join(F.broadcast(some) if few else some.hint("merge"), ["k0", "k1"], "left_semi").groupBy("k0", "k1", "site").agg(F.lit(1).alias("one"))
    return counted.groupBy("k0", "k1").agg(F.count("*").alias("sites")).where(F.col("sites") >= least_sites)


class Flagged:
    """Flagged lines as two arrays of hashes, sorted by the first: 16 bytes a line, however many workers ask."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray):
        self.k0, self.k1 = k0, k1

    def holds(self, lines: list[str]) -> list[bool]:
        """Which lines are flagged. The second hash is only made of lines whose first one is known."""
        import xxhash

        seeds = [xxhash.xxh64_intdigest(s.encode(), 42) for s in SALTS]
        bare = [x.strip(SPACES).encode() for x in lines]
        first = np.array([xxhash.xxh64_intdigest(b, seeds[0]) for b in bare], np.uint64).view(np.int64)
        low, high = np.searchsorted(self.k0, first), np.searchsorted(self.k0, first, "right")
        out = [False] * len(lines)
        for k in np.flatnonzero(low < high).tolist():
            second = np.uint64(xxhash.xxh64_intdigest(bare[k], seeds[1])).view(np.int64)
            out[k] = bool((self.k1[low[k] : high[k]] == second).any())
        return out


def cut_text(text: str | None, flagged: Flagged, most_removed: float) -> tuple[str | None, int, int]:
    """The text without flagged lines, its lines and those taken out; the whole text if more than ``most_removed`` of its line characters would go."""
    if text is None:
        return None, 0, 0
    own = text.split("\n")
    keep = [not x for x in flagged.holds(own)]
    lost = sum(len(x) for x, k in zip(own, keep, strict=True) if not k)
    if lost > most_removed * sum(map(len, own)):
        return text, len(own), 0
    return "\n".join(x for x, k in zip(own, keep, strict=True) if k), len(own), keep.count(False)


def cut_in_place(docs: DataFrame, flagged: DataFrame, most_removed: float) -> DataFrame:
    """For few flagged lines, which every worker can hold: texts are cut where they are."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = flagged.select("k0", "k1").toArrow()
    k0, k1 = (keys.column(c).to_numpy() for c in ("k0", "k1"))
    order = np.lexsort((k1, k0))
    known = spark.sparkContext.broadcast((k0[order], k1[order]))
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lines = Flagged(*known.value)
        for texts in batches:
            rows = [cut_text(t, lines, most_removed) for t in texts.to_pylist()]
            yield pa.array([dict(zip(("text", "n_lines", "n_removed"), r, strict=True)) for r in rows], kind)
        give_back()

    cut = F.arrow_udf(work, "struct<text: string, n_lines: bigint, n_removed: bigint>", ArrowUDFType.SCALAR_ITER)
    return docs.select(F.struct("*").alias("_doc"), cut(F.col("text").cast("string")).alias("_cut"))


def cut_by_join(docs: DataFrame, flagged: DataFrame, most_removed: float) -> DataFrame:
    """For any number of flagged lines: lines are joined with them, and the places found are joined to the texts."""
    rows = staged(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "line-dedup")
    each = rows.select("_row", F.posexplode(lines(F.col("_doc.text").cast("string"))).alias("at", "line"))
    hits = each.select("_row", "at", *line_keys(F.col("line"))).join(flagged.select("k0", "k1").hint("merge"), ["k0", "k1"])
    places = hits.groupBy("_row").agg(F.collect_set("at").alias("_at"))
    own = lines(F.col("_doc.text").cast("string"))
    indexed = F.transform(own, lambda x, i: F.struct(x.alias("line"), F.array_contains(F.coalesce("_at", F.array().cast("array<int>")), i).alias("gone")))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x["line"]))
    whole = F.col("_doc.text").cast("string")
    joined = rows.join(places, "_row", "left").withColumn("_lines", indexed)
    gone, kept = F.filter("_lines", lambda x: x["gone"]), F.filter("_lines", lambda x: ~x["gone"])
    copy = chars(gone) > F.lit(most_removed) * chars(F.col("_lines"))
    cut = F.struct(
        F.when(copy, whole).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"),
        F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_lines"),
        F.when(whole.isNull() | copy, 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )
    return joined.select("_doc", F.when(whole.isNull(), F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(cut).alias("_cut"))


def remove_boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES, most_removed: float = MOST_REMOVED, in_place: int = BROADCAST_ROWS) -> DataFrame:
    """Take lines that stand on at least ``least_sites`` sites out of (text, source) rows: _doc and _cut.

    A line is what stands between newlines, compared without outer white space, and is looked at if
    it has LEAST_WORDS words. Every occurrence goes, except from documents that would lose more than
    ``most_removed`` of their characters: those are copies of each other and left as they are for a
    near-duplicate stage. _doc is the row as it was, _cut has the new text, n_lines and n_removed.
    Null text stays null with no lines; null sources are one site; rows that repeat are cut alike;
    an empty table gives no rows.
    """
    return cut_lines(docs, spread_lines(docs.select("text", "source"), least_sites), most_removed, in_place)


def cut_lines(docs: DataFrame, flagged: DataFrame, most_removed: float, in_place: int = BROADCAST_ROWS) -> DataFrame:
    few = flagged.limit(in_place + 1).count() <= in_place
    return (cut_in_place if few else cut_by_join)(docs, flagged, most_removed)


def copies_as_one_site(docs: DataFrame, flagged: DataFrame, n: int, percent: int, in_place: int) -> DataFrame:
    """(text, source) of ``docs``, where near copies that flagged lines make up a good part of have the smallest source of their group."""
    own = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    cut = cut_lines(own, flagged, 1.0, in_place)
    chars = lambda text, n_lines: F.length(text) - F.greatest(n_lines - 1, F.lit(0))
    all_, kept = chars(F.col("_doc.text"), F.col("_cut.n_lines")), chars(F.col("_cut.text"), F.col("_cut.n_lines") - F.col("_cut.n_removed"))
    rich = staged(cut.where(all_ - kept > F.lit(COPY_PART) * all_).select("_doc.*"), "line-rich")
    if rich.isEmpty():
        return own.select("text", "source")
    groups = durable(link_documents(rich, n, percent).where("component is not null").select("text_hash", "component").distinct())
    sites = rich.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.min("source").alias("source")).join(groups, "text_hash")
    site = sites.groupBy("component").agg(F.min("source").alias("site"))
    known = durable(groups.join(site, "component").select("text_hash", "site"))
    placed = small_or_salted(own.withColumn("text_hash", F.xxhash64("text")), known, ["text_hash"], "left")
    return placed.select("text", F.coalesce("site", "source").alias("source"))


def remove_all_boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES, n: int = 5, percent: int = 80, in_place: int = BROADCAST_ROWS) -> DataFrame:
    """``remove_boilerplate`` that spares no document: flagged lines go whatever part of a text they are.

    What is copied is told from boilerplate by what makes it a copy: documents that flagged lines make
    up more than COPY_PART of are linked by their ``n``-word shingles (``percent`` of the union), and a
    group of near copies counts as one site. So lines that are on many sites only because their text
    is stay, and lines that are in many different texts go from the copies too.
    """
    flagged = spread_lines(docs.select("text", "source"), least_sites)
    spread = count_sites(site_lines(copies_as_one_site(docs, flagged, n, percent, in_place)), flagged.select("k0", "k1"), least_sites)
    return cut_lines(docs, durable(spread), 1.0, in_place)


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with cut texts, all rows and columns."""
    cut = remove_all_boilerplate(docs)
    return cut.select(*[F.col("_cut.text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])
