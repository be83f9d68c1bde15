"""Near-duplicate vectors of equal label by tiled comparison in the order of principal components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.llm.shared import components, map_rows, small_or_salted
from auditlake.operators.durable import durable

#: Vectors that one side of a comparison task holds, and those of one matrix product.
TILE_ROWS, BLOCK = 4096, 1024
#: Leading components that every pair of a block accumulates, and components by which the rest goes on.
LEADING, STEP = 8, 8
#: What rounding may add to a bound; closer to the threshold than this, a cosine is summed exactly.
SLACK = 1e-9

MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])
FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # else the squares of very large or small numbers are lost
    scaled = vectors / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rectangle(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, axes by falling second moment of the unit vectors: columns of a square matrix.

    Tasks add up products of their rows; what comes to the driver is the square of the length, whatever the number of rows.
    """
    axes = {}
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):

        def work(batches, dim=dim):
            total = np.zeros((dim, dim))
            for batch in batches:
                u = unit(rectangle(batch.column(0)))
                total += u.T @ u
            yield [(i, j, float(total[i, j])) for i in range(dim) for j in range(i, dim)]

        sums = map_rows(classes.where(F.col("dim") == dim).select("vector"), work, MOMENTS).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        moments = np.zeros((dim, dim))
        for r in sums:
            moments[r["i"], r["j"]] = moments[r["j"], r["i"]] = r["s"]
        axes[dim] = np.linalg.eigh(moments)[1][:, ::-1].copy()
    return axes


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, leading: int = LEADING, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two sets of rotated unit vectors that may have a cosine of ``threshold``.

    The product of the leading components is known for all pairs; the product of the others is at
    most that of the norms of the two suffixes. Pairs whose bound is under the threshold are dropped,
    and the next components are added for those that are left.
    """
    dim = a.shape[1]
    suffix = lambda m, k: np.sqrt(np.maximum(0, 1 - np.square(m[:, :k]).sum(axis=1)))
    k = min(leading, dim)
    partial = a[:, :k] @ b[:, :k].T
    rows, columns = np.nonzero(partial + np.outer(suffix(a, k), suffix(b, k)) >= threshold - SLACK)
    sums = partial[rows, columns]
    while k < dim and len(rows):
        more = min(k + step, dim)
        parts = [np.einsum("ij,ij->i", a[rows[at : at + BLOCK * 16], k:more], b[columns[at : at + BLOCK * 16], k:more]) for at in range(0, len(rows), BLOCK * 16)]
        sums, k = sums + np.concatenate(parts), more
        left = sums + suffix(a, k)[rows] * suffix(b, k)[columns] >= threshold - SLACK
        rows, columns, sums = rows[left], columns[left], sums[left]
    return rows, columns


def linked_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine, in double precision over the given vectors, reaches the threshold."""
    rows, columns = close_pairs(a, b, threshold)
    if not len(rows):
        return rows, columns
    scale = lambda m: m / np.abs(m).max(axis=1, keepdims=True)
    x, y = scale(x), scale(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    dots = np.concatenate([np.einsum("ij,ij->i", x[rows[at : at + BLOCK * 16]], y[columns[at : at + BLOCK * 16]]) for at in range(0, len(rows), BLOCK * 16)])
    cosines = dots / (nx[rows] * ny[columns])
    for k in np.flatnonzero(np.abs(cosines - threshold) < 1e-12).tolist():
        cosines[k] = exact_cosine(x[rows[k]], y[columns[k]])
    linked = cosines >= threshold
    return rows[linked], columns[linked]


def compare_tiles(ids: np.ndarray, sides: np.ndarray, copies: np.ndarray, vectors: np.ndarray, axes: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """For the rows of a task: links to rows of the other side (each copy counts) and the smallest id reached. Side 2 stands for both sides."""
    rotated = unit(vectors) @ axes
    both = sides[0] == 2
    left = np.arange(len(ids)) if both else np.flatnonzero(sides == 0)
    right = left if both else np.flatnonzero(sides == 1)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(0, len(left), BLOCK):
        rows = left[i : i + BLOCK]
        for j in range(i if both else 0, len(right), BLOCK):
            columns = right[j : j + BLOCK]
            p, q = linked_pairs(vectors[rows], vectors[columns], rotated[rows], rotated[columns], threshold)
            p, q = rows[p], columns[q]
            if both:
                p, q = p[p < q], q[p < q]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            for key in np.unique(root[p] * len(ids) + root[q]).tolist():
                u, v = find(key // len(ids)), find(key % len(ids))
                if u != v:
                    u, v = (u, v) if ids[u] < ids[v] else (v, u)
                    root[v] = u
            while (root[root] != root).any():
                root = root[root]
    seen = np.flatnonzero(links)
    return list(zip(ids[seen].tolist(), links[seen].tolist(), ids[root[seen]].tolist(), strict=True))


def compare(classes: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile_rows: int) -> DataFrame:
    """Rows (id, links, root) of the linked classes, some for each task that compared one.

    A cosine of t means a distance of at most sqrt(2 - 2t), so linked vectors lie in the same or in
    neighbouring cells of that width on the first axis. A cell with more than ``tile_rows`` vectors is
    dealt into tiles by id; every pair of tiles of the same or of neighbouring cells is one task.
    """
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    firsts = {dim: a[:, 0].tolist() for dim, a in axes.items()}
    on_first = F.lit(0.0)
    for dim, axis in firsts.items():
        dot = F.aggregate(F.zip_with("scaled", F.lit(axis), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
        on_first = F.when(F.col("dim") == dim, dot / norm).otherwise(on_first)
    largest = F.array_max(F.transform("vector", F.abs))  # as in unit()
    scaled = classes.withColumn("largest", largest).withColumn("scaled", F.transform("vector", lambda x: x / F.col("largest")))
    placed = scaled.withColumn("cell", F.floor(on_first / width)).drop("scaled", "largest")
    cells = durable(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("tiles")))
    near = cells.alias("c")
    for name, step in (("below", -1), ("above", 1)):
        other = cells.select("label", "dim", (F.col("cell") - step).alias("cell"), F.col("tiles").alias(name))
        near = near.join(other, ["label", "dim", "cell"], "left")
    near = durable(near)
    own = F.col("tile")
    tiles = lambda name: F.sequence(F.lit(0), F.col(name).cast("int") - 1)
    task = lambda a, i, b, j, side: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"), F.lit(side).alias("side"))
    cell = F.col("cell")
    tasks = F.concat(
        F.transform(tiles("tiles"), lambda j: F.when(j == own, task(cell, own, cell, own, 2)).when(j > own, task(cell, own, cell, j, 0)).otherwise(task(cell, j, cell, own, 1))),
        F.when(F.col("above") > 0, F.transform(tiles("above"), lambda j: task(cell, own, cell + 1, j, 0))).otherwise(F.array()),
        F.when(F.col("below") > 0, F.transform(tiles("below"), lambda j: task(cell - 1, j, cell, own, 1))).otherwise(F.array()),
    )
    dealt = (
        small_or_salted(placed, near, ["label", "dim", "cell"], "inner")
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .select("label", "dim", "id", "copies", "vector", F.explode(tasks).alias("t"))
        .select("label", "dim", "t.*", "id", "copies", "vector")
    )

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        vectors = rectangle(group.column("vector").chunk(0))
        get = lambda c: group.column(c).to_numpy()
        rows = compare_tiles(get("id"), get("side"), get("copies"), vectors, axes[vectors.shape[1]], threshold)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, FOUND.types, strict=True)], schema=FOUND)

    return dealt.groupBy("label", "dim", "a", "i", "b", "j").applyInArrow(work, from_arrow_schema(FOUND))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links and components of (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors link if labels are equal and their cosine is at least ``threshold``. Equal vectors of a
    label form a class that is compared once, so copies cost nothing. Null labels, and vectors that
    are null, empty, zero, or hold nulls or non-finite numbers link with nothing; vectors of different
    length never link. Rows that repeat are vectors of their own. component_id is the smallest vec_id
    reachable by links, the row's own included; a null vec_id counts as larger than all. Other
    columns are not read; an empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), vector.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    hashes = [F.when(sound, F.xxhash64("label", "vector", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    narrow = durable(rows.select("vec_id", *hashes))
    classes = (
        rows.where(sound).select("*", *hashes).groupBy("h1", "h2", "label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    )
    classes = durable(classes.withColumns({"dim": F.size("vector"), "id": F.monotonically_increasing_id()}))
    axes = principal_axes(classes)
    found = durable(compare(classes.select("label", "dim", "id", "copies", "vector"), axes, threshold, tile_rows))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("h1", "h2", "id", "copies", "first").join(links, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    named = durable(named.withColumn("component", F.coalesce("component", "id")))
    smallest = durable(named.groupBy("component").agg(F.min("first").alias("component_id")))
    whole = durable(small_or_salted(named, smallest, ["component"], "left").select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    component = F.coalesce("component_id", "vec_id")
    return small_or_salted(narrow, whole, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
