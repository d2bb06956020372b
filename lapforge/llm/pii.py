"""Personal data by base patterns and by bootstrapped contexts, without Python on rows.

Base patterns find e-mail and network addresses, cards and phone numbers. They seed a
graph over the whole corpus, and so do assigned secrets (a quoted string of 20 or more
characters, letters and digits mixed, after a word that ends with = or :), which aren't
spans by themselves. Other candidates are runs of words that hold a digit or ``@`` in the
text that base spans leave, a candidate's pattern is the two words before it (where a
text starts, its start counts as a word), where identifiers count by their shapes, with
its own shape (with @, or how many digits, and whether letters are among them), and an
edge joins a pattern to the instance (the candidate's text) that it stands before.
Scores go back and forth a few rounds:
a pattern is as trustworthy for a kind as the instances it extracts, an instance as
the patterns that extract it; seeds keep score 1 for their kind. Patterns of high
score and support then mark their other candidates, unseen identifiers, as that kind.
Base spans are never marked again.

Offsets are code points. They come from splitting a text at the matches: a match
starts where the pieces and matches before it end. Patterns that could start at every
character of a long run are held to the run's start (or the end of the match before),
where they match exactly if they match anywhere in the run, so time is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .text import as_column, hidden, let, others, quoted, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The kind that only the bootstrap marks, and the form of its seeds before their word.
SECRET, SECRET_FORM = "secret", r"""^["'`][A-Za-z0-9+/_=.-]{20,}+["'`]"""
#: The base patterns in linear form; cards only as whole runs of 12 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of words with a digit or @ in each.
CANDIDATE = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
#: Rounds over the graph; least score and least number of seeds of a pattern that marks.
ROUNDS, TRUST, SUPPORT = 3, 0.8, 5
#: Candidates without @ and with fewer digits than this are no identifiers.
LEAST = 5
_SPANS = "array<struct<start:int,end:int,kind:string>>"
#: Spans in a part of the prefix sum, so that its cost stays near n * sqrt(n).
PART = 512


def _prefix(sizes: Column, join=lambda a, x: a + x) -> Column:
    """Sums of (gap, match) sizes: the end of each match, in parts to stay near linear; or what else ``join`` makes."""
    part = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PART)), lambda i: F.slice(sizes, (i * PART + 1).cast("int"), F.lit(PART)))
    inner = F.transform(parts, part)

    def shift(done: Column) -> Column:
        starts = F.aggregate(done, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(join(F.element_at(a, -1), F.element_at(p, -1)))))
        return let(starts, lambda st: F.flatten(F.transform(done, lambda p, i: F.transform(F.slice(p, 2, F.lit(PART)), lambda x: join(x, F.get(st, i))))))

    return let(inner, shift)


def _matches(text: Column, pattern: str, rest: bool = False, inner: Column | None = None) -> Column:
    """Array of (start, end, value, before) of the leftmost non-overlapping matches; with
    ``rest`` also one of empty value for the text after the last. ``before`` is the end of
    the text since the match before; ``inner`` tells if a text stands before this one."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def build(both: Column) -> Column:
            ends = _prefix(F.transform(both, lambda b: F.length(b["gap"]) + F.length(b["value"])))
            return let(ends, lambda e: F.transform(both, lambda b, i: F.struct((F.get(e, i) - F.length(b["value"])).alias("start"), F.get(e, i).alias("end"), b["value"].alias("value"), _tail(b["gap"], (i > 0) if inner is None else (i > 0) | inner).alias("before"))))

        if rest:
            return let(F.zip_with(found, gaps, lambda v, g: F.struct(g.alias("gap"), F.coalesce(v, F.lit("")).alias("value"))), build)
        return let(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(g.alias("gap"), v.alias("value"))), build)

    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    if rest:
        return let(values, placed)
    return let(values, lambda found: F.when(F.size(found) == 0, empty).otherwise(placed(found)))


def _tail(gap: Column, inside: Column) -> Column:
    """The last two words of a gap and what follows them; ``^`` stands before a gap that a text starts with."""
    whole = F.when(inside, gap).otherwise(F.concat(F.lit("^ "), gap))
    return F.reverse(F.regexp_extract(F.reverse(whole), r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,2}+", 0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    digit = lambda d: F.ascii(d) - 48
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    sums = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: F.when(d == "", F.lit(0)).when(i % 2 == 1, doubled(digit(d))).otherwise(digit(d)))
    return F.aggregate(sums, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(check):
    return lambda m: check(m["value"])


def _of_kind(kind: str):
    return lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: str | Column) -> dict[str, Column]:
    """Per kind the array of (start, end, value, before) that passes its check."""
    body = text_or_empty(text)
    low = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.right(p, F.lit(3)), 3, "0").cast("int") <= 255)
    small = lambda v: F.forall(F.split(v, r"\."), low)
    count = lambda v: F.length(_digits(v))
    checks = {"email": None, "ip": small, "card": _luhn, "phone": lambda v: count(v).between(9, 15)}
    gates = {"email": F.contains(body, F.lit("@")), "ip": F.lit(True), "card": F.lit(True), "phone": F.contains(body, F.lit("+"))}
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    out = {}
    for kind in KINDS:
        found, check = _matches(body, PATTERNS[kind]), checks[kind]
        if check is not None:
            found = F.filter(found, _passes(check))
        out[kind] = F.when(gates[kind], found).otherwise(empty)
    return out


def _merged(base: Column) -> Column:
    """Base spans by start; those that overlap are one, of the first one's kind."""

    def build(spans: Column) -> Column:
        upto = _prefix(F.transform(spans, lambda s: s["end"]), F.greatest)

        def cut(ends: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))
            last = lambda h, j: F.coalesce(F.get(h, j + 1), F.size(spans)) - 1
            return let(heads, lambda h: F.transform(h, lambda i, j: F.struct(F.get(spans, i)["start"].alias("start"), F.get(ends, last(h, j)).alias("end"), F.get(spans, i)["kind"].alias("kind"))))

        return let(upto, cut)

    return let(F.array_sort(base), lambda spans: F.when(F.size(spans) == 0, F.array().cast(_SPANS)).otherwise(build(spans)))


def _pieces(body: Column, base: Column) -> Column:
    """Array of (start, value, before, seed): the base spans, and the runs in the text that
    they leave, with the text since the one before; seed is a base span's kind."""

    def between(spans: Column):
        def one(j: Column) -> Column:
            low = F.coalesce(F.get(spans, j - 1)["end"], F.lit(0))
            high = F.coalesce(F.get(spans, j)["start"], F.length(body))

            def within(at: Column) -> Column:
                gap = F.substring(body, at["low"] + 1, at["high"] - at["low"])
                span = F.get(spans, j)
                value = lambda m: F.when(m["value"] != "", m["value"]).otherwise(F.substring(body, span["start"] + 1, span["end"] - span["start"]))
                seed = lambda m: F.when(m["value"] == "", span["kind"])
                return F.transform(let(gap, lambda g: _matches(g, CANDIDATE, rest=True, inner=j > 0)), lambda m: F.struct((at["low"] + m["start"]).alias("start"), value(m).alias("value"), m["before"].alias("before"), seed(m).alias("seed")))

            return let(F.struct(low.alias("low"), high.alias("high")), within)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), one))

    # the text after the last span has no value
    return F.filter(let(_merged(base), between), lambda m: m["value"].isNotNull())


def _trimmed(value: Column) -> Column:
    """(lead, value): a candidate's text without the marks around it, and their number before it."""
    lead = F.regexp_extract(value, r"^([^A-Za-z0-9@+(]*+)(.*?)([^A-Za-z0-9)]*)$", 1)
    return let(F.length(lead), lambda n: F.struct(n.alias("lead"), F.regexp_replace(F.substring(value, n + 1, F.length(value)), r"[^A-Za-z0-9)]++$", "").alias("value")))


def _candidates(body: Column, base: Column) -> Column:
    """Array of (start, value, context, shape, seed) of base spans and candidates.

    Candidates are without the marks around them; those without @ and with too few digits
    count as plain words.
    """

    def one(m: Column) -> Column:
        whole = F.struct(F.lit(0).alias("lead"), m["value"].alias("value"))
        letters = F.length(F.regexp_replace(m["value"], "[^A-Za-z]", ""))
        secret = F.rlike(m["value"], F.lit(SECRET_FORM)) & (F.length(_digits(m["value"])) >= LEAST) & (letters >= LEAST) & F.rlike(m["before"], F.lit(r"[=:]\s*$"))
        seed = F.coalesce(m["seed"], F.when(secret, F.lit(SECRET)))
        inner = F.when(m["seed"].isNotNull(), whole).otherwise(_trimmed(m["value"]))
        fits = lambda v: m["seed"].isNotNull() | F.contains(v, F.lit("@")) | (F.length(_digits(v)) >= LEAST)
        made = lambda t: F.struct((m["start"] + t["lead"]).alias("start"), t["value"].alias("value"), m["before"].alias("before"), seed.alias("seed"), F.when(fits(t["value"]), _shape(t["value"])).alias("shape"), _tail(m["value"], F.lit(True)).alias("plain"))
        return let(inner, made)

    def placed(all_: Column) -> Column:
        token = lambda i: F.coalesce(F.concat(F.lit(" <"), F.get(all_, i)["shape"], F.lit("> ")), F.get(all_, i)["plain"], F.lit(""))
        gap = lambda i: F.coalesce(F.get(all_, i)["before"], F.lit(""))
        # each piece is a word at least, so two of them and the text between hold the two words
        before = lambda i: F.concat(gap(i - 2), token(i - 2), gap(i - 1), token(i - 1), gap(i))
        found = F.transform(all_, lambda m, i: F.struct(m["start"].alias("start"), m["value"].alias("value"), F.when(m["shape"].isNotNull(), _context(before(i))).alias("context"), m["shape"].alias("shape"), m["seed"].alias("seed")))
        return F.filter(found, lambda m: m["shape"].isNotNull())

    return let(F.transform(_pieces(body, base), one), placed)


def _context(before: Column) -> Column:
    """The last two words before a candidate, in lower case; null if there are fewer."""
    words = F.filter(F.split(F.lower(before), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) >= 2, F.array_join(F.slice(w, -2, 2), " ")))


def _shape(value: Column) -> Column:
    """Coarse class: with @, or how many digits, and whether letters are among them."""
    n = F.length(_digits(value))
    band = F.when(n < 9, F.lit("5-8")).when(n < 12, F.lit("9-11")).when(n < 20, F.lit("12-19")).otherwise(F.lit("20-"))
    return F.when(F.contains(value, F.lit("@")), F.lit("@")).otherwise(F.concat(band, F.when(F.rlike(value, F.lit("[A-Za-z]")), F.lit("a")).otherwise(F.lit(""))))


def _base(body: Column) -> Column:
    """All base spans of a text; most texts have no digit and no @, and so none."""
    spans = base_spans(body)
    arrays = [F.transform(spans[k], _of_kind(k)) for k in KINDS]
    return F.when(_holds(body), F.concat(*arrays)).otherwise(F.array().cast(_SPANS))


def _holds(body: Column) -> Column:
    return F.rlike(body, F.lit("[0-9@]"))


def learn(scanned: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(context, shape, kind): the patterns that the bootstrap trusts.

    scanned: candidates. Scores are kept for each kind; a pattern's is the mean
    of its instances', damped by one unknown instance, an instance's the largest of
    its patterns'. A pattern needs ``support`` distinct seeds of its kind.
    """
    one = scanned.filter(F.size("candidates") > 0).select(F.inline("candidates"))
    edges = one.select("context", "shape", F.md5("value").alias("instance"), "seed").filter("context is not null")
    edges = edges.groupBy("context", "shape", "instance").agg(F.max("seed").alias("seed"))
    # a pattern without any seed scores 0 in the first round, and matters only through shared instances
    edges = materialize(edges, "edges")
    seeds = edges.filter("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind")).select("instance", "kind", F.lit(1.0).alias("score"))
    seeds = materialize(seeds, "seeds")
    known, sizes = seeds, edges.groupBy("context", "shape").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes.filter(F.col("n") > 1), "pattern_sizes")
    patterns = None
    for i in range(rounds):
        sums = edges.join(known, "instance").groupBy("context", "shape", "kind").agg(F.sum("score").alias("score"), F.sum((F.col("score") == 1.0).cast("long")).alias("seeds"))
        scored = sums.join(sizes, ["context", "shape"])
        patterns = scored.select("context", "shape", "kind", "seeds", (F.round(F.col("score"), 9) / (F.col("n") + 1)).alias("score"))
        patterns = materialize(patterns, "patterns")
        if i + 1 < rounds:
            drawn = edges.filter("seed is null").join(patterns, ["context", "shape"]).groupBy("instance", "kind").agg(F.max("score").alias("score"))
            known = materialize(seeds.unionByName(drawn.join(seeds.select("instance"), "instance", "left_anti")), "instances")
    good = patterns.filter((F.col("score") >= trust) & (F.col("seeds") >= support))
    best = good.groupBy("context", "shape").agg(F.max(F.struct("score", "kind")).alias("best"))
    return materialize(best.select("context", "shape", F.col("best.kind").alias("kind")), "trusted")


def _found(scanned: DataFrame, key: str) -> DataFrame:
    """(key, more): spans of trusted patterns in each text, from candidates by text."""
    trusted = learn(scanned)
    free = scanned.select(key, F.inline("candidates")).filter(F.coalesce(F.col("seed"), F.lit(SECRET)) == SECRET)
    marked = free.select(key, "start", (F.col("start") + F.length("value")).alias("end"), "context", "shape").join(trusted, ["context", "shape"])
    return materialize(marked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).cast(_SPANS).alias(hidden("more"))), "found")


def detect(docs: DataFrame, text: str | Column = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, ``base`` and ``pii``: arrays of (start, end, kind).

    ``pii`` holds the base spans and those of trusted patterns, by start, then kind as
    in ``KINDS``, ``secret`` last. Null and empty texts have none. Rows with equal texts
    have equal spans. An empty table gives no rows. Kept columns with these names, in
    any case, are replaced. Where the text isn't kept, texts are read once.
    """
    kept = others(docs.columns if keep is None else keep, ["base", "pii"])
    key, whole, names = hidden("key"), text_or_empty(text), [quoted(c) for c in kept]
    wide = isinstance(text, str) and text in kept
    src = docs.select(*names, whole.alias(hidden("text")))
    body, none = F.col(hidden("text")), F.array().cast(_SPANS)
    based = src.select(*names, F.md5(body).alias(key), hidden("text"), _base(body).alias("base"))
    seen = based.select(*([] if wide else names), key, "base", F.when(_holds(body), _candidates(body, F.col("base"))).alias("candidates"))
    if wide:  # texts aren't written again: those with a digit or @ are searched once more instead
        seen = materialize(seen.filter("candidates is not null").select(key, "candidates").dropDuplicates([key]), "scanned")
        more, work = _found(seen, key), based.select(*names, key, "base")
    else:
        work = materialize(seen, "scanned")
        more = _found(work.filter("candidates is not null").select(key, "candidates").dropDuplicates([key]), key)
    rank = lambda k: F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), k)
    work = work.join(more, key, "left")
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"], rank(s["kind"]).alias("rank"), s["end"], s["kind"]))), lambda s: F.struct(s["start"], s["end"], s["kind"])).cast(_SPANS)
    return work.select(*names, order(F.col("base")).alias("base"), order(F.concat("base", F.coalesce(F.col(hidden("more")), none))).alias("pii"))


def written(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of the base spans by kind, their digest, all spans as text, and how many there are."""
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(*keep, *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("pii").alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind of the first. A null text
    stays null; columns and their order stay as they are, whatever their names; every
    row stays, repeated ones too. An empty table stays empty.
    """
    # the input's own columns may clash with those that spans are kept in
    plain = docs.toDF(*(hidden(f"c{i}") if c != text else hidden("body") for i, c in enumerate(docs.columns)))
    found = detect(plain, hidden("body"))
    last = lambda a: F.element_at(a, -1)
    runs = F.aggregate(
        "pii",
        F.array().cast(_SPANS),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] < last(a)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["kind"].alias("kind"))))).otherwise(F.concat(a, F.array(s))),
    )
    body = F.col(hidden("body"))
    masked = let(
        runs,
        lambda r: F.concat(
            F.array_join(F.transform(r, lambda s, i: F.concat(let(F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(F.lit(0)), lambda at: F.substring(body, at + 1, s["start"] - at)), F.lit("<"), s["kind"], F.lit(">"))), ""),
            F.substring(body, last(r)["end"] + 1, F.length(body)),
        ),
    )
    return found.withColumn(hidden("body"), F.when(F.size("pii") == 0, body).otherwise(masked)).drop("base", "pii").toDF(*docs.columns)
