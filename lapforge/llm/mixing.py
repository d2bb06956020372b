"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that hold
them). The flow network has an arc from every pattern to every source of it, and one
from every source to the sink whose capacity is the source's quota. A pattern's
tokens enter by parallel arcs, one for each repetition: the k-th pass over a pattern
costs k for each token (convex), so a first pass is always preferred to a second.
The network's size depends on the number of patterns, not of documents; it is solved
on the driver and refused beyond ``MAX_PATTERNS``. Within a pattern, documents are
taken in the order of a seeded 64-bit hash: a pattern's tokens fix a cut in the hash
range, found from 4096-bucket histograms and one ordered bucket, and every document
below the cut is taken once more than the others. The cuts alone go back to the
documents, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .text import as_column, hidden, others, quoted, word_count

#: Most membership patterns that the driver solves for; beyond it mixing raises.
MAX_PATTERNS = 50_000
#: Flow, in words, that counts as none.
LEAST = 1e-6
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict[object, float]:
    """Quotas by weight out of ``share`` times all sizes, none above ``most`` sizes.

    What a source can't take is shared again by weight among the others until none
    is above its bound. Without any size every target is 0.
    """
    left, quota, free = share * sum(sizes.values()), {k: 0.0 for k in sizes}, dict(weights)
    while free and left > 0:
        unit = left / sum(free.values())
        over = [k for k in free if unit * free[k] > most * sizes[k]]
        for k in over or list(free):
            quota[k] = most * sizes[k] if over else unit * free[k]
            left -= quota[k]
            del free[k]
    return quota


class _Network:
    """Arcs with room left; Dinic's maximum flow by levels, without recursion."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def link(self, a: int, b: int, room: float) -> int:
        """An arc and its reverse, which stands next to it."""
        for x, y, r in ((a, b, room), (b, a, 0.0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, start: int) -> list[int]:
        level = [-1] * len(self.out)
        level[start], queue = 0, [start]
        for a in queue:
            for i in self.out[a]:
                if self.room[i] > LEAST and level[self.to[i]] < 0:
                    level[self.to[i]] = level[a] + 1
                    queue.append(self.to[i])
        return level

    def fill(self, start: int, end: int) -> None:
        """Push as much as goes from ``start`` to ``end``."""
        to, room = self.to, self.room
        while (level := self._levels(start))[end] >= 0:
            after = [0] * len(self.out)
            path: list[int] = []
            a = start
            while True:
                if a == end:
                    push = min(room[i] for i in path)
                    for i in path:
                        room[i] -= push
                        room[i ^ 1] += push
                    # go on from before the first arc that is full
                    full = next(k for k, i in enumerate(path) if room[i] <= LEAST)
                    a = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while after[a] < len(self.out[a]):
                    i = self.out[a][after[a]]
                    if room[i] > LEAST and level[to[i]] == level[a] + 1:
                        break
                    after[a] += 1
                if after[a] < len(self.out[a]):
                    path.append(i)
                    a = to[i]
                elif path:
                    a = to[path.pop() ^ 1]
                    after[a] += 1
                else:
                    break


def route(capacity: dict[tuple, int], quota: dict, epochs: int = 2) -> dict[tuple[tuple, object], float]:
    """Tokens from each pattern to each of its sources, by min-cost flow.

    Every path leaves the start by one arc, a pass over one pattern, and only these
    have costs, which rise by the pass. So the cheapest flow fills the network with all
    first passes, then with second ones on top, and so on; later passes may reroute
    what earlier ones sent. Arcs are visited in a fixed order, so results agree between
    runs. Returns only flows above 0.
    """
    patterns, sources = list(capacity), list(quota)
    sink = 1 + len(patterns) + len(sources)
    net = _Network(sink + 1)
    at = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    flows = {(p, s): net.link(1 + i, at[s], float("inf")) for i, p in enumerate(patterns) for s in p}
    for s in sources:
        net.link(at[s], sink, float(quota[s]))
    for _ in range(epochs):
        for i, p in enumerate(patterns):
            net.link(0, 1 + i, float(capacity[p]))
        net.fill(0, sink)
    return {k: net.room[i ^ 1] for k, i in flows.items() if net.room[i ^ 1] > LEAST}


def _cuts(small: DataFrame, quota: DataFrame) -> DataFrame:
    """For each pattern: ``times`` and the hash up to which one time more is taken.

    small: pattern, size, hash; quota: pattern, times, extra. ``extra`` tokens are
    met by the documents of least hash, to the nearest document.
    """
    bucket, cum = hidden("bucket"), hidden("cum")
    small = small.withColumn(bucket, F.shiftrightunsigned("hash", 52).cast("int"))
    sums = small.groupBy("pattern", bucket).agg(F.sum("size").alias("tokens"))
    sums = sums.withColumn(cum, F.sum("tokens").over(W.partitionBy("pattern").orderBy(bucket)))
    near = sums.join(quota, "pattern").filter((F.col(cum) >= F.col("extra")) & (F.col(cum) - F.col("tokens") < F.col("extra")))
    near = near.select("pattern", bucket, (F.col(cum) - F.col("tokens")).alias("before"), "extra", "times")
    # one bucket of 4096 for each pattern is ordered by hash
    inside = small.join(near, ["pattern", bucket]).withColumn(cum, F.col("before") + F.sum("size").over(W.partitionBy("pattern", bucket).orderBy(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))))))
    inside = inside.filter(F.col(cum) - F.col("size") / 2 <= F.col("extra"))
    order = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as signed
    found = inside.groupBy("pattern").agg(F.max(order).alias("cut"))
    # where not even the first document of the bucket fits, all earlier buckets are taken
    start = F.shiftleft(F.col(bucket).cast("long"), 52).bitwiseXOR(F.lit(-(1 << 63)))
    cuts = near.join(found, "pattern", "left").select("pattern", F.coalesce("cut", F.when(F.col(bucket) > 0, start - 1)).alias("cut"))
    return quota.join(cuts, "pattern", "left").select("pattern", "times", "cut")


def plan(docs: DataFrame, sources: Column, doc_id: Column, size: Column, text: Column, quotas=None, epochs: int = 2, seed: int = 0, carry: tuple[Column, ...] = ()) -> tuple[Column, DataFrame, DataFrame, DataFrame]:
    """The pattern; cuts of the patterns; sizes and targets of the sources; and a written
    row for each document with the ``carry`` columns, pattern, size and hash.

    sources: a string, or an array of strings for documents in several sources; null
    is a source of its own. quotas: f(sizes by source) -> targets by source.
    """
    spark = docs.sparkSession
    kind = docs.select(sources).schema[0].dataType.typeName()
    members = F.array_sort(F.array_distinct(sources)) if kind == "array" else F.array(sources)
    # a text form that tells null from any string and sorts patterns like their sources
    pattern = F.to_json(F.struct(F.transform(members, lambda x: F.coalesce(F.hex(F.encode(x, "utf-8")), F.lit("~"))).alias("s")))
    small = materialize(docs.select(*carry, pattern.alias("pattern"), size.alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("hash")), "sizes")
    found = small.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: merge rare sources first")
    import json

    capacity = {tuple(json.loads(r.pattern)["s"]): r["size"] for r in sorted(found, key=lambda r: r.pattern)}
    keys = {tuple(json.loads(r.pattern)["s"]): r.pattern for r in found}
    sizes: dict[str, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    sizes = {s: sizes[s] for s in sorted(sizes)}
    quota = (quotas or by_weights)(sizes)
    flow = route(capacity, quota, epochs)
    rows = []
    for p, room in capacity.items():
        amount = sum(flow.get((p, s), 0.0) for s in p)
        times = min(epochs, int(amount // room)) if room else 0
        rows.append((keys[p], times, float(max(0.0, amount - times * room))))
    shape = "pattern string, times int, extra double"
    amounts = materialize(spark.createDataFrame(rows, shape).coalesce(1), "amounts")
    cuts = materialize(_cuts(small.select("pattern", "size", "hash"), amounts), "cuts")
    about = [(s, sizes[s], float(quota[s])) for s in sizes]
    return pattern, cuts, materialize(spark.createDataFrame(about, "source_key string, source_size long, target double").coalesce(1), "targets"), small


def by_weights(sizes: dict[str, int]) -> dict[str, float]:
    """Targets by the fixed weights; keys sort as sources by code point, null last."""
    return targets(sizes, {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sorted(sizes))})


def mix(docs: DataFrame, source: str | Column = "source", doc_id: str = "doc_id", text: str = "text", quotas=None, epochs: int = 2, seed: int = 0) -> DataFrame:
    """``docs`` with ``mix_size`` (words) and ``mix_times``.

    A null text has size 0; a null source is a source of its own. Documents of size 0
    are taken as often as others of their hash. Rows that agree in doc_id and text
    share a hash and so are taken alike. Reruns agree whatever the partitioning. An
    empty table stays empty. Columns with these two names, in any case, are replaced.
    """
    names = others(docs.columns, ["mix_size", "mix_times"])
    docs = docs.select(*map(quoted, names))
    src, ident, body = as_column(source), as_column(doc_id), as_column(text)
    pattern, cuts, _, _ = plan(docs, src, ident, word_count(body), body, quotas, epochs, seed)
    work = docs.select(*map(quoted, names), pattern.alias(hidden("pattern")), F.xxhash64(F.lit(seed), ident, body).alias(hidden("hash")), word_count(body).alias("mix_size"))
    return _counted(work, cuts, hidden("pattern"), hidden("hash")).select(*map(quoted, names), "mix_size", F.col(hidden("passes")).alias("mix_times"))


def _counted(rows: DataFrame, cuts: DataFrame, pattern: str, hash_: str) -> DataFrame:
    """``rows`` with how often the cuts take them."""
    cuts = cuts.select(F.col("pattern").alias(hidden("key")), F.col("times").alias(hidden("times")), F.col("cut").alias(hidden("cut")))
    order = F.col(hash_).bitwiseXOR(F.lit(-(1 << 63)))
    more = F.coalesce((order <= F.col(hidden("cut"))).cast("int"), F.lit(0))
    joined = rows.join(cuts, F.col(pattern) == F.col(hidden("key")), "left")
    return joined.withColumn(hidden("passes"), F.coalesce(F.col(hidden("times")), F.lit(0)) + more)


def mixed_words(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document of one source each.

    Texts are read once: what decides is written as a small row for each document.
    """
    src, ident, body = as_column(source), as_column(doc_id), as_column(text)
    carry = (ident.alias("doc_id"), F.coalesce(F.hex(F.encode(src, "utf-8")), F.lit("~")).alias("source_key"))
    _, cuts, about, small = plan(docs, src, ident, word_count(body), body, None, 2, seed, carry)
    done = _counted(small, cuts, "pattern", "hash").join(about, "source_key", "left")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col(hidden("passes"))).cast("long").alias("taken"))
