"""Quality rules with thresholds from mergeable quantile sketches.

Every document's measures are integers computed in one pass over its whole text. A
sketch counts documents by bucket of a measure: values under 64 have a bucket each,
larger ones share one with values within 1/32 of them. Sketches of two parts merge by
adding counts, so they are a grouped count with pre-aggregation, the same for any
partitioning, and a sketch of a language is the sum of its sources'. Thresholds of
each language and source come from the sketch's median and lower quartile (a fence of
several of their distances around the median, which junk moves only if it is half of the
group), from the language's sketch where the source has few documents, and from all
documents where the language has few. Each measure's fence is widened by a slack, so that
a group whose documents agree rejects none of them for a small difference; where median
and quartile are equal, as for counts that most documents have none of, the slack alone
is the distance. Filtering joins the thresholds back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .text import SPACE, as_column, hidden, let, others, quoted, text_or_empty

#: Documents that a group's own sketch needs.
FEW = 50
#: Distances of lower quartile and median between the median and the fence: in a symmetric
#: group four quartile distances beyond the quartile.
REACH = 9
#: Measures per thousand words, lines or characters, and their least slack.
SLACK = {"symbols_k": 150, "dup_lines_k": 300, "repeat_words_k": 250, "word_chars_k": 3000, "shouted_k": 300, "marks_k": 100}
#: Symbols that the base rules count, and marks that tables and shouting use.
SYMBOLS, MARKS = "#*$%&|<>", "!?|=~^_{}[]\\"


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more.

    Windows are compared by a 64-bit hash, sorted with their places; those next to an
    equal one are kept, and each covers three words, or as many as lie after the
    window kept before it.
    """
    windows = let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    places = let(F.array_sort(windows), repeated)
    return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j > 0, F.least(F.lit(3), x - F.get(p, j - 1))).otherwise(F.lit(3))), F.lit(0), lambda a, x: a + x))


def measure(docs: DataFrame, text: str | Column = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and further counts that the method uses: n_lines, n_shouted, n_marks (all long).

    Null and empty texts have none of anything. Kept columns with these names are
    replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_marks")
    kept = [as_column(c) for c in others(docs.columns if keep is None else keep, made)]
    body = text_or_empty(text)
    words = F.filter(F.split(body, SPACE), lambda x: x != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    less = lambda short: F.length(body) - F.length(short)
    work = docs.select(
        *kept,
        words.alias(hidden("w")),
        lines.alias(hidden("l")),
        less(F.translate(body, SYMBOLS, "")).alias("n_symbols"),
        less(F.translate(body, MARKS, "")).alias("n_marks"),
        less(F.regexp_replace(body, "[A-ZÀ-Þ]", "")).alias("n_shouted"),
    )
    w, n = F.col(hidden("w")), F.col(hidden("l"))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
        "n_repeat_words": F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_repeat_words(w)),
        "n_lines": F.size(n),
        "n_shouted": F.col("n_shouted"),
        "n_marks": F.col("n_marks"),
    }
    columns = [c for c in work.columns if c not in (*made, hidden("w"), hidden("l"))]
    return work.select(*map(quoted, columns), *(counts[k].cast("long").alias(k) for k in made))


def rates() -> dict[str, Column]:
    """The measures that thresholds apply to: whole numbers per thousand."""
    per = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {
        "symbols_k": per("n_symbols", "n_words"),
        "dup_lines_k": per("n_dup_lines", "n_lines"),
        "repeat_words_k": per("n_repeat_words", "n_words"),
        "word_chars_k": per("word_chars", "n_words"),
        "shouted_k": per("n_shouted", "word_chars"),
        "marks_k": per("n_marks", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number >= 0; buckets are in the order of values."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value, shift)).cast("int")


def least_of(found: Column) -> Column:
    """The least value of a bucket."""
    shift = F.when(found < 64, F.lit(0)).otherwise((found - 32 - (found % 32)) / 32).cast("int")
    return F.call_function("shiftleft", (found - shift * 32).cast("long"), shift)


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): add n by the same columns to merge sketches."""
    values = F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in rates().items()))
    return measured.select(*keys, F.inline(values)).groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups, of keys among those of the smaller ones."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, a column of (low, high) for each measure) from sketches' quartiles."""
    by = [*keys, "measure"]
    ranked = sketches.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("bucket"))).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    at = lambda q: least_of(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))))
    quartiles = ranked.groupBy(*by).agg(F.max("total").alias("total"), at(1).alias("q1"), at(2).alias("q2"))
    slack = F.element_at(F.create_map(*(F.lit(x) for kv in SLACK.items() for x in kv)), F.col("measure"))
    reach = (F.col("q2") - F.col("q1")) * REACH + slack
    fenced = quartiles.select(*by, "total", F.struct((F.col("q2") - reach).alias("low"), (F.col("q2") + reach).alias("high")).alias("fence"))
    return fenced.groupBy(*keys).agg(F.max("total").alias("total"), *(F.max(F.when(F.col("measure") == k, F.col("fence"))).alias(k) for k in SLACK))


def thresholds(measured: DataFrame) -> DataFrame:
    """(group_key, fences): one row for each language and source, nulls being values."""
    own = materialize(sketch(measured, ["lang_key", "group_key"]), "sketches")
    if own.limit(1).count() == 0:
        return own.select("group_key", *(F.lit(None).cast("struct<low:bigint,high:bigint>").alias(k) for k in SLACK))
    pack = lambda df, name: df.select(*(c for c in df.columns if c.endswith("_key")), F.struct("total", *SLACK).alias(name))
    source = pack(fences(own, ["lang_key", "group_key"]), "s")
    lang = pack(fences(merge(own, ["lang_key"]), ["lang_key"]), "l")
    every = fences(merge(own.withColumn("all", F.lit(0)), ["all"]), ["all"]).first()  # one row
    shape = "struct<low:bigint,high:bigint>"
    rest = {k: F.struct(F.lit(every[k]["low"]).alias("low"), F.lit(every[k]["high"]).alias("high")).cast(shape) for k in SLACK}
    pick = lambda k: F.when(F.col("s.total") >= FEW, F.col(f"s.{k}")).when(F.col("l.total") >= FEW, F.col(f"l.{k}")).otherwise(rest[k])
    return materialize(source.join(lang, "lang_key").select("group_key", *(pick(k).alias(k) for k in SLACK)), "thresholds")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and ``reasons`` of the method.

    base_failed: under 50 words, or over half of the words in repeated windows. kept:
    not base_failed, and no measure over its group's upper fence, nor characters per
    word under the lower one; values on a fence are kept. Null language or source are
    groups of their own; null and empty texts have no words and so fail. Repeated rows
    are judged alike and count each in the sketches. Other columns play no part,
    whatever their names. An empty table gives no rows.
    """
    src = docs.select(as_column(doc_id).alias("doc_id"), as_column(text).alias("text"), F.to_json(F.struct(as_column(lang).alias("a"))).alias("lang_key"), F.to_json(F.struct(as_column(lang).alias("a"), as_column(source).alias("b"))).alias("group_key"))
    measured = materialize(measure(src, "text", ["doc_id", "lang_key", "group_key"]), "measures")
    joined = measured.join(thresholds(measured), "group_key", "left")
    out = []
    for k, v in rates().items():
        out.append(F.when(v > F.col(f"{k}.high"), F.lit(f"{k} high")))
        if k == "word_chars_k":
            out.append(F.when(v < F.col(f"{k}.low"), F.lit(f"{k} low")))
    reasons = F.array_compact(F.array(*out))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size(reasons) == 0)).alias("kept"), reasons.alias("reasons"))
