"""SimHash fingerprints and their near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into segments. If two fingerprints differ in at most
``distance`` bits, then in some segment they differ in at most that segment's radius,
as the radii plus one add up to distance plus one. So every fingerprint stands in a
table under the value of each segment, and looks up the values within the radius of
its own (a small Hamming ball); what it finds is verified by the complete distance.
Only distinct fingerprints are searched, so exact copies cost one entry. Longer segments
have larger balls but fewer fingerprints under a value, so their number follows from how
many fingerprints there are.

Segment values held by more than ``hot`` fingerprints are not searched by pairs.
Fingerprints that meet there are linked over common centres instead: two differ in at
most 2r bits exactly if some 64-bit value lies within r of both, so each emits all
values in its ball (r = 2: 2,081) and is linked to the least fingerprint at each. That
is linear in the number of fingerprints and loses no link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import materialize
from .sieve import WORD, passing, sieve
from .text import as_column, hidden, small_batches, text_or_empty

SEED = 42
#: Shingles hashed at once, whatever a text's length.
CHUNK = 200_000
#: Segments, and the number of fingerprints from which two are cheaper than three: 562
#: probes of 2^32 values against 46 of 2^21.
SEGMENTS, MANY = 3, 1 << 25
#: Fingerprints under one segment value from which common centres replace pairs.
HOT = 2048


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint; bit i is set if over half of the shingles' hashes set it.

    A-Z lower-cased, whole text, shingles of ``words`` words with repeats; a shorter
    text is one shingle; one without words (or null) has fingerprint 0.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    total = max(1, len(found) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, total, CHUNK):
        high = min(low + CHUNK, total)
        tails = ends[low + words - 1 : high + words - 1] if len(found) >= words else [ends[-1]]
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[low:high], tails)], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes as they are: a bit is set if over half of them set it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[low : low + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", words: int = 4) -> DataFrame:
    """(doc_id, mark, fingerprint as signed long) of every document; mark is the text's MD5."""
    src = docs.select(as_column(doc_id).alias("doc_id"), F.md5(text_or_empty(text)).alias("mark"), as_column(text).alias("text"))
    small_batches(src)
    schema = T.StructType([src.schema["doc_id"], src.schema["mark"], T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(made.view(np.int64))], names=schema.names)

    return src.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(bits: list[int], radius: int) -> list[int]:
    """Masks, as signed longs, of up to ``radius`` of the given bits."""
    return [_signed(sum(1 << b for b in chosen)) for r in range(radius + 1) for chosen in itertools.combinations(bits, r)]


def segments(distance: int, parts: int = SEGMENTS) -> list[tuple[list[int], int]]:
    """Bits and radius of each segment: radii plus one add up to distance plus one."""
    out, low = [], 0
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        radius = (distance + 1) // parts - 1 + (i < (distance + 1) % parts)
        out.append((list(range(low, low + width)), radius))
        low += width
    return [x for x in out if x[1] >= 0]


def links(prints: DataFrame, distance: int = 4, hot: int = HOT, many: int = MANY) -> DataFrame:
    """(u, v): links that connect the distinct ``fingerprint`` values of ``prints``.

    Every pair at ``distance`` or less is either a row itself or joined by a path of
    rows; no row joins fingerprints of different components.
    """
    own = prints.select("fingerprint")
    plan = segments(distance, SEGMENTS if own.count() < many else SEGMENTS - 1)
    entry, probe = [], []
    for i, (bits, radius) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        value = F.col("fingerprint").bitwiseAND(mask)
        entry.append(F.struct(F.lit(i).alias("segment"), value.alias("value")))
        probe += [F.struct(F.lit(i).alias("segment"), value.bitwiseXOR(F.lit(m)).alias("value")) for m in _ball(bits, radius)]
    table = own.select(F.col("fingerprint").alias("v"), F.inline(F.array(*entry)))
    sought = own.select(F.col("fingerprint").alias("u"), F.inline(F.array(*probe)))
    full = materialize(table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("segment", "value"), "hot_values")
    near = (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance) & (F.col("u") > F.col("v"))
    if full.limit(1).count() == 0:
        return sought.join(table, ["segment", "value"]).filter(near).select("u", "v").distinct()
    at = ["segment", "value"]
    pairs = sought.join(full, at, "left_anti").join(table.join(full, at, "left_anti"), at).filter(near).select("u", "v")
    meeting = sought.join(full, at, "left_semi").select(F.col("u").alias("f")).union(table.join(full, at, "left_semi").select("v")).distinct()
    return pairs.union(_by_centres(meeting, distance)).distinct()


def _by_centres(prints: DataFrame, distance: int) -> DataFrame:
    """Links over common centres among the fingerprints ``f``."""
    if distance % 2:
        raise ValueError("links over centres need an even distance")
    ball = _ball(list(range(64)), distance // 2)
    centres = prints.select("f", F.explode(F.array(*map(F.lit, ball))).alias("mask")).select("f", F.col("f").bitwiseXOR(F.col("mask")).alias("centre"))
    least = centres.groupBy("centre").agg(F.min("f").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("centre", "v")
    return centres.join(least, "centre").filter("f <> v").select(F.col("f").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, doc_id: str | Column = "doc_id", text: str | Column = "text", hot: int = HOT) -> DataFrame:
    """doc_id, mark (MD5 of the text), fingerprint and component_id (least doc_id reachable).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows
    stay. A null doc_id is never the least; a component of null ones has a null id.
    An empty table gives no rows. Extra columns of the input play no part.
    """
    prints = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(classes, distance, hot)).select(F.col("node").alias("fingerprint"), "component")
    rooted = materialize(classes.join(joined, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "rooted")
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "mark", "fingerprint", "component_id")


def drop_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of least doc_id of each component; columns stay as they are.

    Of rows that repeat a kept document's id and text one stays. Documents without an
    id stay only where their component has no id at all.
    """
    return keep_least(docs, near_duplicates(docs, distance, words, doc_id, text), doc_id, text)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those whose doc_id isn't the component_id that ``found`` names.

    found: doc_id, mark, component_id. A document is known by its id and its text, as
    ids may be null or repeat.
    """
    found = materialize(found.select("doc_id", "mark", "component_id"), "near_duplicates")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ident, mark = hidden("id"), hidden("mark")
    gone = materialize(found.filter(~kept).select(F.col("doc_id").alias(ident), F.col("mark").alias(mark)).distinct(), "duplicates")
    # only texts that a sieve of those to leave out can't tell from them move to the join
    bits, own = sieve(gone, F.struct(ident, mark)), F.struct(as_column(doc_id).alias(ident), F.md5(text_or_empty(text)).alias(mark))
    same = as_column(doc_id).eqNullSafe(F.col(ident)) & (F.md5(text_or_empty(text)) == F.col(mark)) & (F.col(WORD) >= 0)
    unsure = passing(docs, own, bits).join(gone, same, "left_anti").drop(WORD)
    rest = passing(docs, own, bits, False).union(unsure)
    if found.filter(kept).groupBy("doc_id", "mark").count().filter("count > 1").limit(1).count():
        rest = rest.withColumns({mark: F.md5(text_or_empty(text)), ident: as_column(doc_id)}).dropDuplicates([ident, mark]).drop(mark, ident)
    return rest


def hex_digits(fingerprint_col: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_col), 16, "0"))
