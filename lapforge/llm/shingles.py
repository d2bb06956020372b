"""Near copies by exact Jaccard similarity of word shingles, on top of SimHash.

Texts with equal sets of shingles are one node. Candidates are nodes whose SimHash
fingerprints multi-index hashing links, and, as 64 bits hardly tell a similarity of 0.8,
nodes that share a band of a MinHash signature: two sets of similarity s share none of
``BANDS`` bands of ``ROWS`` rows with probability (1 - s^ROWS)^BANDS, 8e-5 at 0.8 and 2e-6
at 0.85. Candidates are gathered into clusters (each node to the least of each of its
bands, which keeps them connected and is linear), and within a cluster nodes are compared
by their whole sets.

A cluster of at most a block of nodes is compared pair by pair in one task. In a larger
one, work stays near linear where its members are copies of a few texts:

1. Shingles that only one node of the cluster has are counted. A node can be similar to
   another only if what it shares with the cluster is ``similarity`` of its size, and to
   one of size s only if it is similarity / (1 + similarity) of both sizes together; nodes
   that share less leave. Texts with a common passage and much of their own end here.
2. All others are compared with a few centres, the nodes with least of their own, and
   with the members of their own block. This links nearly all copies of a text.
3. Nodes outside the cluster's largest component are compared with all nodes of a size
   that 1 allows, block by block. Pairs inside that component need no comparison.

No task holds more than two blocks, and no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .components import components
from .scratch import materialize, sifted
from .sieve import passing, sieve
from .text import as_column, small_batches, text_or_empty

SEED = 42
WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 24
#: Bits in which the fingerprints of SimHash's candidates differ at most.
DISTANCE = 2
#: Nodes in a block and centres of a cluster; shingles that are hashed or compared at once.
BLOCK, CENTRES, CHUNK = 256, 32, 4096
#: Documents that are returned at once, whatever Spark's batches hold.
SLICE = 256
_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _DRAW.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z lower-cased.

    A shorter text is one shingle; one without words (or null) has none.
    """
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    tails = ends[words - 1 :] if len(found) >= words else [ends[-1]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], tails)], dtype=np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """Least value of each of ROWS * BANDS hash functions over a set."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for low in range(0, len(found), CHUNK):
        part = found[low : low + CHUNK]
        for a in range(0, ROWS * BANDS, 40):
            values = _FACTORS[a : a + 40, None] * part + _OFFSETS[a : a + 40, None]
            least[a : a + 40] = np.minimum(least[a : a + 40], values.min(1))
    return least


def _bands(found: np.ndarray) -> list[int]:
    import xxhash

    rows = signature(found).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]


def _marked(docs: DataFrame, doc_id: str | Column, text: str | Column) -> DataFrame:
    body = text_or_empty(text)
    return docs.select(as_column(doc_id).alias("doc_id"), F.md5(body).alias("mark"), body.alias("text"))


def _nodes(src: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, node, print, bands) of every document."""
    import xxhash

    small_batches(src)
    schema = T.StructType([src.schema["doc_id"], T.StructField("mark", T.StringType()), T.StructField("node", T.LongType()), T.StructField("print", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                nodes, prints, bands = [], [], []
                for t in batch.column("text"):
                    found = shingles(t.as_py(), words)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    prints.append(simhash.majority(found))
                    bands += _bands(found) if len(found) else [0] * BANDS
                longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints, bands)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), longs[2])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *longs[:2], lists], names=schema.names)

    return src.mapInArrow(run, schema)


def _sets(src: DataFrame, words: int) -> DataFrame:
    """(node, cluster, n, found) with the whole set of shingles of each node."""

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                made = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cluster", "n")), made], names=["node", "cluster", "n", "found"])

    return src.select("node", "cluster", "n", "text").mapInArrow(run, "node long, cluster long, n long, found binary")


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Matrix of which sets have at least the given Jaccard similarity."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n))
    for low in range(0, int(shared.sum()), CHUNK):
        a, b = np.searchsorted(column, [low, low + CHUNK])
        part = np.zeros((n, CHUNK), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    return both >= least * (sizes[:, None] + sizes - both) - 1e-9


def _joined(nodes: np.ndarray, near: np.ndarray) -> tuple[list[int], list[int]]:
    """(u, v): each node to the first of those that it is connected to."""
    u, v, left = [], [], np.ones(len(nodes), bool)
    for i in range(len(nodes)):
        if left[i]:
            reached = edge = np.arange(len(nodes)) == i
            while edge.any():
                edge = near[edge].any(0) & ~reached
                reached = reached | edge
            left &= ~reached
            others = nodes[reached & (np.arange(len(nodes)) != i)]
            u += others.tolist()
            v += [int(nodes[i])] * len(others)
    return u, v


def _compared(nodes: np.ndarray, found: list, similarity: float) -> tuple[list[int], list[int]]:
    """(u, v): links that connect those of the nodes that are similar."""
    return _joined(nodes, similar([np.frombuffer(f, np.uint64) for f in found], similarity))


def _verified(copies: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(u, v): links that connect similar nodes of one group of ``keys`` and one cluster.

    copies: keys, cluster, node, found; a node may occur more than once.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("node").to_numpy(), table.column("cluster").to_numpy()))
        cluster, nodes = table.column("cluster").to_numpy()[order], table.column("node").to_numpy()[order]
        fresh = np.append(True, (cluster[1:] != cluster[:-1]) | (nodes[1:] != nodes[:-1]))
        cluster, nodes, order = cluster[fresh], nodes[fresh], order[fresh]
        found = table.column("found").combine_chunks().take(pa.array(order)).to_pylist()
        u, v = [], []
        cuts = [0, *(np.nonzero(cluster[1:] != cluster[:-1])[0] + 1).tolist(), len(nodes)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                more = _compared(nodes[a:b], found[a:b], similarity)
                u += more[0]
                v += more[1]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return copies.select(*keys, *(c for c in ("cluster", "node", "found") if c not in keys)).groupBy(*keys).applyInArrow(run, "u long, v long")


def _tokens(sets: DataFrame) -> DataFrame:
    """(cluster, node, token) for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for cluster, node, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = np.frombuffer(found.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), cluster)), pa.array(np.full(len(tokens), node)), pa.array(tokens)], names=["cluster", "node", "token"])

    return sets.select("cluster", "node", "found").mapInArrow(run, "cluster long, node long, token long")


def _blocks(size: Column, block: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(size / F.lit(block)).cast("long"))


def _large(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(u, v): links of clusters that are larger than a block.

    Only sets that are compared move; what decides on them are narrow rows.
    """
    # 1: what a node shares with its cluster
    own = _tokens(sets).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    own = own.groupBy("cluster", "node").agg(F.count(F.lit(1)).alias("own"))
    size = (F.octet_length("found") / 8).cast("long")
    rows = sets.select("cluster", "node", size.alias("size")).join(own, ["cluster", "node"], "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
    rows = materialize(rows.filter(F.col("shared") >= similarity * F.col("size") - 1e-6), "open")
    counts = materialize(rows.groupBy("cluster").agg(_blocks(F.count(F.lit(1)), block).alias("blocks")), "open_sizes")
    rows = rows.join(counts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # 2: centres, and the members of the own block
    alone = F.floor((F.col("size") - F.col("shared")) * 20 / F.col("size"))
    best = F.row_number().over(W.partitionBy("cluster").orderBy(alone, F.xxhash64("node", F.lit(SEED)), "node"))
    centres = rows.withColumn("rank", best).filter(F.col("rank") <= CENTRES)
    centres = centres.select("cluster", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    found = sets.select("cluster", "node", "found")
    dealt = rows.select("cluster", "node", "part").unionByName(centres).distinct()
    first = materialize(_verified(found.join(dealt, ["cluster", "node"]), ["cluster", "part"], similarity), "to_centres")
    # 3: those that aren't in the largest component, by what sizes they can be similar to
    joined = components(first).select("node", "component")
    rooted = materialize(rows.select("cluster", "node", "size", "shared").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "joined")
    most = rooted.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("most"))
    rest = rooted.join(most, "cluster").filter("component <> most")
    rest = rest.select("cluster", "node", F.floor(F.log("size") / math.log(1.1)).alias("class"), (similarity * F.col("size") - 1e-6).alias("low"), ((1 + similarity) / similarity * F.col("shared") - F.col("size") + 1e-6).alias("high"))
    sizes = rest.groupBy("cluster", "class").agg(_blocks(F.count(F.lit(1)), block).alias("parts"))
    rest = materialize(rest.join(sizes, ["cluster", "class"]).withColumn("group", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts"), "rest")
    bounds = rest.groupBy("cluster", "class", "group").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = rows.join(bounds, "cluster").filter((F.col("size") >= F.col("low")) & (F.col("size") <= F.col("high")))
    near = near.select("cluster", "node", "class", "group", "part")
    # a group of the rest goes to the blocks that hold nodes of a size that fits
    parts = near.select("cluster", "class", "group", "part").distinct()
    wanted = rest.select("cluster", "node", "class", "group").join(parts, ["cluster", "class", "group"])
    dealt = materialize(near.unionByName(wanted.select(*near.columns)).distinct(), "dealt")
    last = _verified(found.join(dealt, ["cluster", "node"]), ["cluster", "class", "group", "part"], similarity)
    return first.unionByName(materialize(last, "to_rest"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, doc_id: str | Column = "doc_id", text: str | Column = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, mark (MD5 of the text), node (of its set of shingles) and component_id (least doc_id reachable).

    Documents are linked if the Jaccard similarity of their sets is at least
    ``similarity``; those without words are linked to each other. Repeated rows stay. A
    null doc_id is never the least; a component of null ones has a null id. An empty
    table gives no rows. Other columns play no part.
    """
    src = _marked(docs, doc_id, text)
    prints = materialize(_nodes(src, words), "shingled")
    classes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark"), F.first("print").alias("print"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("node", F.explode("bands").alias("band"))
    centres = entries.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    centres = materialize(centres.select("band", "centre"), "centres")
    found = passing(entries, F.col("band"), sieve(centres, F.col("band"))).join(centres, "band").filter("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    found = found.unionByName(_by_prints(classes.select("node", "print")))
    inner = components(found).select("node", F.col("component").alias("cluster"))
    members = materialize(inner.unionByName(inner.select(F.col("cluster").alias("node"), "cluster").distinct()), "clusters")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    wanted = materialize(members.join(sizes, "cluster").join(classes.select("node", "mark"), "node").select("node", "cluster", "n", "mark"), "wanted")
    # one text of each mark, and of those only that are wanted, before texts move
    texts = src.select("mark", "text").join(wanted.filter("n > 1").select("mark"), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    with sifted(docs.sparkSession, wanted.count()):
        sets = materialize(_sets(wanted.join(texts, "mark"), words), "sets")
    # small clusters travel together, about four blocks of nodes in a task
    packs = max(1, sets.filter(F.col("n") <= block).count() // (4 * block))
    small = sets.filter(F.col("n") <= block).withColumn("pack", F.pmod(F.xxhash64("cluster"), F.lit(packs)))
    links = _verified(small, ["pack"], similarity)
    if sets.filter(F.col("n") > block).limit(1).count():
        links = links.unionByName(_large(sets.filter(F.col("n") > block), similarity, block))
    joined = components(links)
    rooted = materialize(classes.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "rooted")
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "mark", "node").join(rooted.join(ids, "component").select("node", "component_id"), "node").select("doc_id", "mark", "node", "component_id")


def _by_prints(classes: DataFrame) -> DataFrame:
    """(u, v): nodes that fingerprints within ``DISTANCE`` bits connect, by multi-index hashing."""
    prints = materialize(classes.groupBy("print").agg(F.min("node").alias("least")).withColumnRenamed("print", "fingerprint"), "prints")
    near = simhash.links(prints, DISTANCE)
    node = lambda side: prints.select(F.col("fingerprint").alias(side), F.col("least").alias(f"node_{side}"))
    between = near.join(node("u"), "u").join(node("v"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    same = classes.join(prints, classes["print"] == prints["fingerprint"]).filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return between.unionByName(same)


def drop_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of least doc_id of each component; columns stay as they are.

    Of rows that repeat a kept document's id and text one stays. Documents without an
    id stay only where their component has no id at all; those without words are one
    component. An empty table stays empty.
    """
    return simhash.keep_least(docs, near_duplicates(docs, similarity, words, doc_id, text), doc_id, text)
