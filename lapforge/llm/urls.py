"""URL filtering by listed rules and by mined association rules.

A listed rule (host and path) fits its host and all subdomains where the path starts
with the rule's; the longest that fits decides. Its verdicts are also what the rest is
learned from: FP-growth mines sets of URL tokens from the pages that a listed rule
judges (and, if given, from labels by page), where a page's verdict is one more item. A
set becomes a rule if it is frequent enough together with that item and confident
enough. The listed rules' own names are no tokens, as mining them would only restate the
list; what is left are words of hosts and paths and names of parameters, so a host whose
judged pages are blocked is blocked elsewhere too. Rules that hold a smaller rule are
dropped. Rules match through an inverted index: each stands under the rarest of its
tokens only, pages look up their tokens, and the rest of a rule's tokens is verified, so
a token that every page holds does not gather all pages and rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .text import as_column

#: The listed rules, longest first at matching.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Least share of labelled pages, and least number of blocked ones, that hold a rule.
MIN_SUPPORT, MIN_COUNT = 0.001, 10
#: Least share of blocked ones among the labelled pages that hold a rule's tokens.
MIN_CONFIDENCE = 0.9
_BLOCKED = "=blocked"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def named(rules: tuple[tuple[str, str], ...] = RULES) -> set[str]:
    """Words that the listed rules name, as parts of hosts and steps of paths."""
    return {w for text, _ in rules for w in text.replace("/", ".").split(".") if w}


def tokens(host: Column, path: Column, url: Column, leave: set[str] = frozenset()) -> Column:
    """Distinct tokens: words of the host and of the path (runs of letters, three at
    least, so no codes of languages; one form wherever they stand) and names of parameters, without the words in ``leave``
    and without the host's last part."""
    parts = F.filter(F.split(host, r"\."), lambda x: x != "")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    text = F.concat_ws("/", F.array_join(inner, "/"), F.lower(path))
    words = F.filter(F.split(text, r"[^\p{L}]+"), lambda x: (F.length(x) > 2) & ~x.isin(*sorted(leave)) if leave else F.length(x) > 2)
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*+)", 1), F.lit(""))
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tag = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_distinct(F.concat(tag("word", words), tag("param", names)))


def _rules_in(rows: DataFrame, floor: int, min_confidence: float) -> DataFrame:
    """(rule, tokens, confidence, count) of sets of two tokens or more, by one mining pass over rows of items."""
    from pyspark.ml.fpm import FPGrowth

    n = rows.count()
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, floor / n), minConfidence=1.0).fit(rows).freqItemsets
    # the frequency of a set with the verdict's item over that of the set alone
    sets = materialize(found.select(F.array_contains("items", _BLOCKED).alias("with"), F.array_sort(F.array_remove("items", _BLOCKED)).alias("tokens"), "freq").filter((F.size("tokens") > 1) & (F.col("freq") >= floor)), "itemsets")
    both = sets.filter("with").select("tokens", F.col("freq").alias("count")).join(sets.filter("not with").select("tokens", F.col("freq").alias("total")), "tokens")
    sure = both.withColumn("confidence", F.col("count") / F.col("total")).filter(F.col("confidence") >= min_confidence)
    return materialize(sure.select(F.array_join("tokens", " ").alias("rule"), "tokens", "confidence", "count"), "sure")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule, tokens, confidence, count) from rows of tokens and blocked.

    A set of tokens is a rule if at least ``min_count`` and ``min_support`` of the
    labelled rows are blocked and hold it, those are ``min_confidence`` of the rows that
    hold it, and no subset of it is a rule. Without blocked rows there are none.

    Single tokens are counted first, without mining: those that are rules, and those
    that too few blocked rows hold, can't be in a rule of several tokens, and go before
    FP-growth sees the rows.
    """
    spark, shape = labelled.sparkSession, "rule string, tokens array<string>, confidence double, count long"
    rows = materialize(labelled.select(F.array_distinct("tokens").alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked")), "labelled")
    floor = max(min_count, math.ceil(min_support * rows.count()), 1)
    held = rows.select("blocked", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("blocked").alias("count"), F.count(F.lit(1)).alias("total"))
    held = materialize(held.filter(F.col("count") >= floor).withColumn("confidence", F.col("count") / F.col("total")), "tokens")
    single = held.filter(F.col("confidence") >= min_confidence).select(F.col("token").alias("rule"), F.array("token").alias("tokens"), "confidence", "count")
    open_ = held.filter(F.col("confidence") < min_confidence).select("token")
    # what is left of a row: its open tokens; rows without two of them can't hold a set
    left = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "blocked", F.explode("tokens").alias("token")).join(open_, "token")
    left = left.groupBy("row", "blocked").agg(F.collect_set("token").alias("items")).filter(F.size("items") > 1)
    left = materialize(left.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(_BLOCKED)))).otherwise(F.col("items")).alias("items")), "open")
    if not left.limit(1).count():
        return materialize(single.select("rule", "tokens", "confidence", "count"), "rules")
    sure = _rules_in(left, floor, min_confidence)
    # a rule that contains another one adds nothing: rules are looked up in themselves
    inside = match(sure.select(F.col("rule").alias("whole"), "tokens"), "whole", sure.select("rule", "tokens")).filter("rule <> whole").select(F.col("whole").alias("rule")).distinct()
    return materialize(single.unionByName(sure.join(inside, "rule", "left_anti")).select("rule", "tokens", "confidence", "count").to(spark.createDataFrame([], shape).schema), "rules")


def match(rows: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule): which rules' tokens are all among a row's, by an inverted index.

    rows: key, tokens; rules: rule, tokens (none empty).
    """
    postings = rows.select(F.col(key), F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = rules.select("rule", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = index.groupBy("rule").agg(F.min(F.struct("n", "token", "tokens")).alias("at")).select("rule", F.col("at.token").alias("token"), F.col("at.tokens").alias("needed"))
    held = rows.select(F.col(key), "tokens", F.explode("tokens").alias("token"))
    return held.join(materialize(rarest, "index"), "token").filter(F.size(F.array_except("needed", "tokens")) == 0).select(key, "rule")


def judge(pages: DataFrame, labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", rules: tuple[tuple[str, str], ...] = RULES, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule (listed), verdict and mined (rules that blocked it).

    Mined from the pages that a listed rule judges; with ``labels``, from the other
    pages too: a page counts as blocked if its id is labelled toxic or of quality 0
    (several labels of an id: any of them). A page that no listed rule fits is blocked
    if a mined rule matches it, else allowed. Null urls have empty host and path and are
    allowed. Whole urls count, whatever their length. Of listed rules that fit, the
    longest decides, of equally long ones the last by code point. Repeated rows stay and
    count each; other columns play no part. An empty table gives no rows.
    """
    link = as_column(url)
    src = pages.select(as_column(page_id).alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"), link.alias("url"))
    rule, says = listed(F.col("host"), F.col("path"), rules)
    src = src.withColumns({"rule": rule, "says": says, "tokens": tokens(F.col("host"), F.col("path"), F.col("url"), named(rules))}).drop("url")
    src = materialize(src.withColumn("row", F.monotonically_increasing_id()), "pages")
    known = src.filter("says is not null").select("tokens", (F.col("says") == "block").alias("blocked"))
    if labels is not None:
        bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
        bad = labels.groupBy(as_column(label_id).alias("page_id")).agg(F.max(bad).alias("blocked"))
        known = known.unionByName(src.filter("says is null").join(bad, "page_id").select("tokens", "blocked"))
    found = mine(known, min_support, min_count, min_confidence)
    hits = match(src.filter("says is null").select("row", "tokens"), "row", found).groupBy("row").agg(F.array_sort(F.collect_set("rule")).alias("mined"))
    judged = src.join(hits, "row", "left")
    verdict = F.coalesce("says", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("mined", F.array().cast("array<string>")).alias("mined"))
