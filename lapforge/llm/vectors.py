"""Exact cosine range join of vectors over pivots, within equal labels.

Vectors are scaled to length one, where cosine >= c means a distance of at most
eps = sqrt(2 - 2c). A label has pivots in proportion to its vectors, taken from a seeded
sample of them; every vector's home is the cell of its nearest pivot. A pair with homes
i and j is found in one of the two cells (the lower if i + j is even, else the higher,
which evens their loads), say j. By the triangle inequality a vector x of home i can lie
within eps of a vector of cell j only if its distance from the border of the two cells,
(|x-pj|^2 - |x-pi|^2) / (2 |pi-pj|), is at most eps, and its distance from pj at most the
cell's radius and eps; only then is it replicated to j. Cells join independently of each
other. A cell beyond a block's size is cut into blocks by a hash, and a task compares one
block of homes with one block of homes or visitors, so that neither a large cell nor a
large label is gathered in one task.

Equal vectors are one class with a weight, so copies are never paired with each
other. A task returns link counts for each vector and a spanning forest of its links,
at most as many rows as it read, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import materialize
from .text import as_column

#: Vectors for each pivot, and for each block: a task compares two blocks.
CELL, BLOCK = 4096, 4096
#: Pivots of a label, and of all labels together, at most: they are broadcast. Beyond
#: them cells grow and are cut into more blocks; results are the same.
PIVOTS, ALL_PIVOTS = 4096, 16_384


def pivots(classes: DataFrame, seed: int = 0) -> dict[tuple[int, str], np.ndarray]:
    """Pivots by vector length and label: farthest-first among about twice as many vectors.

    Labels of at most ``CELL`` vectors need none.
    """
    kinds = classes.groupBy("label_key", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    kinds = kinds.select("label_key", "dim", "n", F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS)).alias("pivots"))
    kinds = materialize(kinds, "labels")
    total = kinds.agg(F.sum("pivots").alias("n")).first()["n"] or 0
    if not total:
        return {}
    share = min(1.0, ALL_PIVOTS / total)
    rate = 2 * share * F.col("pivots") / F.col("n")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "class_id"), F.lit(1 << 30)) < rate * (1 << 30)
    sample = classes.withColumn("dim", F.size("vec")).join(kinds, ["label_key", "dim"]).filter(drawn)
    # about 2 * ALL_PIVOTS vectors at most
    table = sample.select("label_key", "dim", "pivots", "class_id", "vec").orderBy("class_id").toArrow()
    out, labels, dims = {}, table["label_key"].to_pylist(), table["dim"].to_pylist()
    for key in sorted(set(zip(dims, labels))):
        at = [i for i, k in enumerate(zip(dims, labels)) if k == key]
        x = _unit(_matrix(table["vec"].combine_chunks().take(pa.array(at)), key[0]))
        most = max(1, round(share * table["pivots"][at[0]].as_py()))
        chosen, far = [0], 2 - 2 * x @ x[0]
        while len(chosen) < min(most, len(x)) and far.max() > 1e-9:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 2 - 2 * x @ x[chosen[-1]])
        out[key] = x[chosen]
    return out


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large and very small vectors neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivot.T))


def _visits(x: np.ndarray, pivot: np.ndarray, home: np.ndarray, radius: np.ndarray, eps: float) -> np.ndarray:
    """Which other cells each unit vector visits."""
    dots = x @ pivot.T
    gap = dots[np.arange(len(x)), home][:, None] - dots
    other, own = np.arange(len(pivot))[None, :], home[:, None]
    there = np.where((other + own) % 2 == 0, other < own, other > own)
    within = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= radius + eps + 1e-9
    return there & within & (gap <= eps * _distances(pivot, pivot)[home] + 1e-9)


def _kinds(batch: pa.RecordBatch):
    """Row numbers and unit vectors of each label and vector length of a batch."""
    dims = np.diff(batch.column("vec").offsets.to_numpy())
    labels = batch.column("label_key").dictionary_encode()
    codes = labels.indices.to_numpy().astype(np.int64)
    for kind in np.unique(codes * (1 << 32) + dims):
        at = np.nonzero((codes == kind >> 32) & (dims == kind & 0xFFFFFFFF))[0]
        dim = int(kind & 0xFFFFFFFF)
        yield (dim, labels.dictionary[int(kind >> 32)].as_py()), at, _unit(_matrix(batch.column("vec").take(pa.array(at)), dim))


def links(classes: DataFrame, cosine: float, seed: int = 0) -> DataFrame:
    """(kind, u, v, n): link counts ('n', u, _, n) and connecting links ('l', u, v, _).

    classes: class_id, label_key, weight, vec of finite, non-zero vectors, each vector
    once for a label. Vectors of different lengths are never linked.
    """
    spark = classes.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    shared = spark.sparkContext.broadcast(pivots(classes, seed))  # ALL_PIVOTS vectors at most
    names = ["class_id", "label_key", "weight", "vec"]
    housed_schema = T.StructType([*(classes.schema[c] for c in names), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def house(batches):
        for batch in batches:
            dims, cell, far = np.diff(batch.column("vec").offsets.to_numpy()).astype(np.int32), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for key, at, x in _kinds(batch):
                if key in shared.value:
                    apart = _distances(x, shared.value[key])
                    cell[at] = apart.argmin(axis=1)
                    far[at] = apart.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(far)], names=housed_schema.names)

    housed = materialize(classes.select(*names).mapInArrow(house, housed_schema), "homes")
    found = housed.groupBy("dim", "label_key", "cell").agg(F.max("far").alias("far")).filter("far > 0").collect()  # one row for each pivot at most
    radii = {k: np.full(len(p), -np.inf) for k, p in shared.value.items()}
    for r in found:
        radii[r["dim"], r["label_key"]][r["cell"]] = r["far"]
    # a cell whose only home is its pivot
    radii = spark.sparkContext.broadcast({k: np.maximum(r, 0) for k, r in radii.items()})
    placed_schema = T.StructType([*housed_schema.fields[:-1], T.StructField("visits", T.ArrayType(T.IntegerType()))])

    def place(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                visits: list = [[]] * batch.num_rows
                homes = batch.column("cell").to_numpy()
                for key, at, x in _kinds(batch):
                    if key in shared.value:
                        there = _visits(x, shared.value[key], homes[at], radii.value[key], eps)
                        for i, row in zip(at, there):
                            visits[i] = np.nonzero(row)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(visits, type=pa.list_(pa.int32()))], names=placed_schema.names)

    keys = ["label_key", "dim", "cell"]
    once = materialize(housed.mapInArrow(place, placed_schema), "cells")
    here = F.array(F.struct(F.col("cell"), F.lit(True).alias("home")))
    both = F.concat(here, F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))
    placed = lambda *more: once.select("label_key", "dim", *more, F.inline(both))
    # blocks of a cell: as many as its homes and visitors each need
    sizes = placed().groupBy(*keys).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    of = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(BLOCK))).cast("int")
    sizes = materialize(sizes.select(*keys, of("h").alias("hb"), of("g").alias("gb"), (F.col("g") > 0).alias("visited")), "cell_sizes")
    dealt = placed("class_id", "weight", "vec").join(sizes, keys)
    block = F.xxhash64("class_id")
    own = F.when(F.col("home"), F.pmod(block, "hb")).otherwise(F.pmod(block, "gb")).cast("int")
    dealt = dealt.withColumn("own", own)
    # a home block meets the home blocks from itself on and every visitor block; a visitor block meets every home block
    guests = F.when(F.col("visited"), F.sequence(F.lit(0), F.col("gb") - 1)).otherwise(F.array().cast("array<int>"))
    tasks = F.when(
        F.col("home"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda b: F.struct(F.least("own", b).alias("a"), F.greatest("own", b).alias("b"), F.lit(True).alias("inner"))),
            F.transform(guests, lambda b: F.struct(F.col("own").alias("a"), b.alias("b"), F.lit(False).alias("inner"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda b: F.struct(b.alias("a"), F.col("own").alias("b"), F.lit(False).alias("inner"))))
    dealt = dealt.select("class_id", "weight", "vec", *keys, "home", "own", F.inline(tasks))
    out_schema = "kind string, u long, v long, n long"

    def compare(table: pa.Table) -> pa.Table:
        ids = table["class_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids, x = ids[order], _unit(flat.reshape(len(ids), -1)[order])
        weight = table["weight"].to_numpy()[order].astype(np.float64)
        home, own = table["home"].to_numpy(zero_copy_only=False)[order], table["own"].to_numpy()[order]
        inner, a, b = table["inner"][0].as_py(), table["a"][0].as_py(), table["b"][0].as_py()
        left = np.nonzero(home & (own == a))[0]
        right = np.nonzero(home & (own == b) if inner else ~home)[0]
        same = inner and a == b
        counts = np.zeros(len(ids))
        root = np.arange(len(ids))

        joined = []
        for low in range(0, len(left), 256):
            part = left[low : low + 256]
            hit = x[part] @ x[right].T >= cosine
            if same:
                hit &= part[:, None] != right[None, :]
            counts[part] += hit @ weight[right]
            if not same:
                counts[right] += weight[part] @ hit
            for i, row in zip(part, hit):
                near = right[row]
                new = near[root[near] != root[i]]
                if len(new):
                    roots, first = np.unique(root[new], return_index=True)
                    joined += [(i, j) for j in new[first]]
                    root[np.isin(root, roots)] = root[i]
        at = np.nonzero(counts)[0]
        u, v = (np.array([ids[e[k]] for e in joined], dtype=np.int64) for k in (0, 1))
        return pa.table({
            "kind": pa.array(["n"] * len(at) + ["l"] * len(u), type=pa.string()),
            "u": pa.array(np.concatenate([ids[at], u]), type=pa.int64()),
            "v": pa.array(np.concatenate([ids[at], v]), type=pa.int64()),
            "n": pa.array(np.concatenate([counts[at], np.zeros(len(u))]).astype(np.int64)),
        })

    return materialize(dealt.groupBy(*keys, "a", "b", "inner").applyInArrow(compare, out_schema), "links")


def near_duplicates(df: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector.

    Linked are different rows with equal, non-null labels and cosine >= ``cosine`` in
    double precision. A vector that is null, empty, zero or has null or non-finite
    parts links with nothing; such a row is its own component. ``component_id`` is the
    least vec_id reachable. Repeated rows link with each other. A null vec_id is never
    the least: rows of a component of null ones alone have null, and are not kept.
    An empty table gives no rows. Other columns play no part.
    """
    vec = as_column(embedding) if dict(df.dtypes)[embedding] == "array<float>" else as_column(embedding).cast("array<double>")
    src = df.select(as_column(vec_id).alias("vec_id"), vec.alias("vec"), as_column(label).cast("string").alias("label_key"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec").isNotNull() & F.col("label_key").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    src = src.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # equal vectors of a label share a key; -0.0 counts as 0.0
    key = F.sha2(F.concat_ws("|", F.col("label_key"), F.array_join(F.transform("vec", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ",")), 256)
    rows = src.filter("fine").select("vec_id", "label_key", "vec", key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "vectors")
    # a class is known by the number of one of its written rows, which no other class has
    classes = rows.groupBy("key").agg(F.min("row").alias("class_id"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label_key").alias("label_key"), F.first("vec").alias("vec"))
    classes = materialize(classes, "classes")
    found = links(classes, cosine, seed)
    counts = found.filter("kind = 'n'").groupBy(F.col("u").alias("class_id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("kind = 'l'").select("u", "v")).select(F.col("node").alias("class_id"), "component")
    rooted = classes.select("class_id", "key", "least", "weight").join(counts, "class_id", "left").join(roots, "class_id", "left")
    rooted = materialize(rooted.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component")), "rooted")
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "component").select("key", "n_links", "component_id")
    linked = rows.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    alone = src.filter(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
