"""Where added files come from: renames and copies between two snapshots, exact and edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.durable import durable
from auditlake.operators.joins import join_bounded, skewed_join

#: Groups that lines are counted in for the bound on what two files share.
GROUPS = 16
#: Old contents of a line that new ones are compared with first.
FIRST = 4
CHANGES = ("added", "modified", "renamed", "copied")


def snapshot_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, path, old, new) of all paths: digests of the contents, null where a path is missing or its content is."""
    here = F.lit(True)
    sides = [
        df.select("project", "path", F.sha2("content", 256).alias(digest), here.alias(f"in_{digest}"), (F.length("content") > 0).alias(f"{digest}_filled"))
        for df, digest in ((before, "old"), (after, "new"))
    ]
    return sides[0].join(sides[1], ["project", "path"], "full")


def file_lines(files: DataFrame) -> DataFrame:
    """(project, side, id, line, c): hashes of the lines of each content and how often each occurs."""
    each = files.select("project", "side", "id", F.explode(F.split("content", "\n", -1)).alias("line"))
    return each.groupBy("project", "side", "id", F.xxhash64("line").alias("line")).agg(F.count("*").alias("c"))


def line_vectors(lines: DataFrame) -> DataFrame:
    """(project, side, id, n, counts, tokens) of each content: lines, counts by group of lines, and a hash for each occurrence of a line."""
    group = F.pmod("line", F.lit(GROUPS))
    counts = [F.sum(F.when(group == g, F.col("c")).otherwise(0)) for g in range(GROUPS)]
    own = F.transform(F.sequence(F.lit(1).cast("long"), F.col("c")), lambda k: F.xxhash64("line", k))
    return lines.groupBy("project", "side", "id").agg(
        F.sum("c").alias("n"), F.array(*counts).alias("counts"), F.flatten(F.collect_list(own)).alias("tokens")
    )


def placed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``seen``, the contents of the project that have the line, ``n``, the lines of the content, and ``rarer``, those of them before this one by rarity."""
    seen = lines.groupBy("project", "line").agg(F.count("*").alias("seen"))
    own = Window.partitionBy("project", "id")
    ranked = own.orderBy("seen", "line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.join(seen, ["project", "line"]).select(
        "project", "side", "id", "line", "seen", F.coalesce(F.sum("c").over(ranked), F.lit(0)).alias("rarer"), F.sum("c").over(own).alias("n")
    )


def candidate_pairs(new: DataFrame, old: DataFrame, percent: int) -> DataFrame:
    """(project, a, b) of placed lines of new and old contents that may share num / den of the longer one's lines.

    ``new`` says (num, den) of each content, ``percent`` or more. Lines are in the order of rarity. All
    that two contents share comes from the rarest line they share on, so what either has left there
    must do. So common lines bring nobody together unless a content has few others.
    """
    left = lambda key: F.col(f"n_{key}") - F.col(f"rarer_{key}")
    side = lambda df, key, *more: df.select("project", "line", F.col("id").alias(key), F.col("n").alias(f"n_{key}"), F.col("rarer").alias(f"rarer_{key}"), *more)
    a = side(new, "a", "num", "den").where(left("a") * F.col("den") >= F.col("num") * F.col("n_a"))
    b = side(old, "b").where(left("b") * 100 >= percent * F.col("n_b"))
    enough = F.least(left("a"), left("b")) * F.col("den") >= F.col("num") * F.greatest("n_a", "n_b")
    return a.join(b, ["project", "line"]).where(enough).select("project", "a", "b", "num", "den").distinct()


def first_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """(project, a, b): for each new content that shares a line one old one that shares its rarest shared lines, of at most ``FIRST`` old ones a line."""
    turn = F.row_number().over(Window.partitionBy("project", "line").orderBy("id"))
    some = old.select("project", "line", F.col("id").alias("b"), turn.alias("turn")).where(F.col("turn") <= FIRST).drop("turn")
    met = new.select("project", "line", "seen", F.col("id").alias("a")).join(some, ["project", "line"])
    by_pair = met.groupBy("project", "a", "b").agg(F.min("seen").alias("seen"), F.count("*").alias("lines"))
    return by_pair.groupBy("project", "a").agg(F.min_by("b", F.struct("seen", -F.col("lines"), "b")).alias("b"))


def shared_lines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(project, a, b, shared, longer) of ``pairs`` (project, a, b, num, den) that share num / den of the longer one's lines.

    Pairs first pass a bound, the sum of the smaller counts of each group of lines; only those that
    do are compared line by line.
    """
    side = lambda name, key, *columns: vectors.where(F.col("side") == name).select("project", F.col("id").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in columns))
    known = pairs.join(side("new", "a", "n", "counts"), ["project", "a"]).join(side("old", "b", "n", "counts"), ["project", "b"]).withColumn("longer", F.greatest("n_a", "n_b"))
    bound = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    passed = durable(known.where(bound * F.col("den") >= F.col("num") * F.col("longer")).select("project", "a", "b", "num", "den", "longer"))
    both = passed.join(side("new", "a", "tokens"), ["project", "a"]).join(side("old", "b", "tokens"), ["project", "b"])
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.select("project", "a", "b", "num", "den", "longer", shared.alias("shared")).where(F.col("shared") * F.col("den") >= F.col("num") * F.col("longer")).drop("num", "den")


def similar_contents(lines: DataFrame, percent: int, closest: bool = False) -> DataFrame:
    """(project, a, b, likeness) of new and old contents that share at least ``percent`` of the longer one's lines.

    With ``closest`` only pairs that are at least as alike as one pair of the new content found
    before: all of its most alike ones, few others. So where many contents share more than
    ``percent`` and a source is closer, the many are not compared.
    """
    lines = durable(lines)
    vectors, placed = durable(line_vectors(lines)), durable(placed_lines(lines))
    new, old = (placed.where(F.col("side") == name) for name in ("new", "old"))
    least = [F.lit(percent).cast("long").alias("num"), F.lit(100).cast("long").alias("den")]
    if closest:
        any_ = [F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den")]
        first = shared_lines(first_pairs(new, old).select("*", *any_), vectors).where(100 * F.col("shared") >= percent * F.col("longer"))
        found = durable(first.select("project", F.col("a").alias("id"), "shared", "longer"))
        new = skewed_join(new, found, ["project", "id"], "left")
        least = [F.coalesce(F.col(c).cast("long"), none).alias(name) for c, none, name in zip(("shared", "longer"), least, ("num", "den"), strict=True)]
    alike = shared_lines(candidate_pairs(new.select("project", "line", "id", "n", "rarer", *least), old, percent), vectors)
    return alike.select("project", "a", "b", (F.col("shared") / F.col("longer")).alias("likeness"))


def traced_changes(before: DataFrame, after: DataFrame, percent: int = 50) -> DataFrame:
    """(project, path, change, old_path, likeness) of files that differ between two snapshots of (project, path, content).

    ``modified`` files have another content at the same path. A new path is ``renamed`` or ``copied``
    if a file of the project's old snapshot has its content, or at least ``percent`` of the lines of
    the longer of the two, occurrences counted; else ``added``. The source is the most alike; of
    equals one whose path is gone, then the smallest path. A file that is gone is renamed once: of
    equal contents, sources and new paths are paired in the order of their paths; of edited ones the
    most alike new path, then the smallest, is the rename and others are copies. Empty files are
    never traced. ``likeness`` is the part shared, 1 for equal contents, null without a source.

    Contents are reduced to digests first. Only contents of new paths without an equal source, and old
    contents of their projects, are cut into lines, each content once; lines and pairs are shuffled by
    hashes. Paths occur once in a snapshot; null contents are never traced.
    """
    states = durable(snapshot_states(before, after))
    changed = states.where("in_old and in_new and old <> new").select("project", "path", F.lit("modified").alias("change"))
    sources = states.where("old_filled").select("project", F.col("path").alias("old_path"), F.col("old").alias("digest"), F.col("in_new").isNull().alias("gone"))
    new = states.where("in_new and in_old is null").select("project", "path", F.col("new").alias("digest"), F.coalesce("new_filled", F.lit(False)).alias("filled"))

    turn = lambda path: F.row_number().over(Window.partitionBy("project", "digest").orderBy(path))
    turns = durable(new.where("filled").withColumn("turn", turn("path")))
    gone = durable(sources.where("gone").withColumn("turn", turn("old_path")).drop("gone"))
    any_path = sources.groupBy("project", "digest").agg(F.min("old_path").alias("any_path"))
    told = durable(turns.join(gone, ["project", "digest", "turn"], "left").join(any_path, ["project", "digest"], "left"))
    source = F.coalesce("old_path", "any_path")
    equal = told.where(source.isNotNull()).select(
        "project", "path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("copied").alias("change"), source.alias("old_path"), F.lit(1.0).alias("likeness")
    )

    left = durable(told.where(source.isNull()).select("project", "path", "digest", F.xxhash64("digest").alias("a")))
    free = gone.join(turns, ["project", "digest", "turn"], "left_anti").select("project", "old_path", F.lit(True).alias("free"))
    mine = sources.join(left.select("project").distinct(), "project", "left_semi").join(free, ["project", "old_path"], "left")
    olds = durable(
        mine.groupBy("project", "digest").agg(F.min("old_path").alias("path"), F.min(F.when(F.col("free"), F.col("old_path"))).alias("free_path")).withColumn("b", F.xxhash64("digest"))
    )
    news = left.groupBy("project", "digest").agg(F.min("path").alias("path"), F.first("a").alias("a"))
    contents = [
        join_bounded(df.select("project", "path", "content"), rows.select("project", "path", F.col(key).alias("id")), ["project", "path"], "inner").withColumn("side", F.lit(side))
        for df, rows, key, side in ((after, news, "a", "new"), (before, olds, "b", "old"))
    ]
    alike = similar_contents(file_lines(contents[0].unionByName(contents[1])), percent, closest=True)
    choice = F.struct((-F.col("likeness")).alias("unlike"), F.col("free_path").isNull().alias("kept"), F.coalesce("free_path", "path").alias("old_path"))
    best = alike.join(olds.select("project", "b", "path", "free_path"), ["project", "b"]).groupBy("project", "a").agg(F.min(choice).alias("best"))
    claims = durable(left.join(best, ["project", "a"], "left").select("project", "path", "best.*"))
    won = claims.where("not kept").groupBy("project", "old_path").agg(F.min(F.struct("unlike", "path"))["path"].alias("winner"))
    judged = claims.join(won, ["project", "old_path"], "left")
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("winner") == F.col("path"), "renamed").otherwise("copied")
    edited = judged.select("project", "path", change.alias("change"), "old_path", (-F.col("unlike")).alias("likeness"))

    none = [F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("double").alias("likeness")]
    plain = changed.unionByName(new.where("not filled").select("project", "path", F.lit("added").alias("change"))).select("*", *none)
    return plain.unionByName(equal).unionByName(edited)
