"""Language identification of spans: script ranges, n-gram scores, Viterbi over words.

Words are runs of letters (and marks on them). A word's script, by Unicode range,
narrows the languages to those that were seen with this script in training. Within
them a word's score is the sum over its character trigrams, word borders included, of
the log-probability in each language (multinomial, additive smoothing). Viterbi over
the words of a text, with a penalty for each switch, labels spans of one language.

Most texts need no Viterbi pass: with L the language of the largest total, the path
that stays in L is the best one if no other language gains more than the penalty over
L on any run of words (each excursion of m spans costs m switches at least, and gains
at most m times that). The largest gain on a run is a prefix sum and a running
minimum. Only texts that fail this test are decoded word by word.

The model is fitted on a bounded, seeded sample of labelled texts of each language
(``TRAIN_DOCS``); every language that labels name is learned, and everything else covers
whole texts of all documents. Counting runs on all partitions at once: each gives sparse
counts of the languages that it met, which are summed by language before the driver gets
one row for each. A model takes half a megabyte for a language.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .text import as_column, hidden, numbered_columns, others, small_batches

#: Labelled texts of a language that the model is fitted on, about.
TRAIN_DOCS = 1500
GRAM_BITS = 17
SMOOTHING = 0.1
#: Log-probability that a switch of language costs.
SWITCH = 12.0
#: Code points scored at once, whatever a text's length, and documents returned at once.
CHUNK, SLICE = 1 << 18, 256

#: First and last code points of scripts, in order; letters outside are "Other".
SCRIPTS = (
    ("Latin", 0x0041, 0x024F),
    ("Latin", 0x0250, 0x02AF),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0531, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x06FF),
    ("Arabic", 0x0750, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x20000, 0x323AF),
)
NAMES = ["Other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 for no letter, 1 for a letter, 2 for a mark; and the script."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LM":
            kinds[c] = 1 if k == "L" else 2
    script = np.zeros(0x110000, dtype=np.uint8)
    for name, low, high in SCRIPTS:
        script[low : high + 1] = NAMES.index(name)
    return kinds, script


@dataclass
class Words:
    """Trigrams of a text: buckets, and for each word its first bucket, letters, script."""

    grams: np.ndarray
    starts: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def _words(text: str) -> Words:
    kinds, scripts = _tables()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds[points]
    inside = kind == 1
    if (kind == 2).any():  # a mark belongs to the word of the letter before it
        at = np.where(kind != 2, np.arange(len(points)), 0)
        inside = kind[np.maximum.accumulate(at)] == 1
    # an empty place before the text and two after it, so that every word has borders
    c = np.zeros(len(points) + 3, dtype=np.uint64)
    c[1:-2] = np.where(inside, points, 0)
    live = c != 0
    ended = np.zeros(len(c), dtype=bool)
    ended[1:] = live[:-1] & ~live[1:]
    first = live & ~np.concatenate([[False], live[:-1]])
    at = np.nonzero(live | ended)[0]
    key = c[at] + (c[at - 1] << np.uint64(21)) + (np.where(at > 1, c[at - 2], np.uint64(0)) * (c[at - 1] != 0) << np.uint64(42))
    grams = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
    starts = np.nonzero(first[at])[0]
    size = np.diff(np.append(starts, len(at))) - 1  # less the place after the word
    return Words(grams, starts, size, scripts[c[at[starts]].astype(np.int64)] if len(starts) else np.zeros(0, np.uint8))


def _pieces(text: str):
    """A long text in parts cut after a character that ends a word."""
    low = 0
    while len(text) - low > CHUNK:
        high = low + CHUNK
        while high < len(text) and unicodedata.category(text[high - 1])[0] in "LM":
            high += 1
        yield text[low:high]
        low = high
    yield text[low:] if low else text


@dataclass
class Model:
    """Log-probabilities of trigrams by language, and the languages of each script."""

    languages: list[str]
    logs: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words (rows) by language, and the words' letters."""
        parts, letters = [np.zeros((0, len(self.languages)))], [np.zeros(0, dtype=np.int64)]
        for piece in _pieces(text):
            w = _words(piece)
            if len(w.starts):
                if not self.languages:
                    parts.append(np.zeros((len(w.starts), 0)))
                    letters.append(w.letters)
                    continue
                per = np.add.reduceat(self.logs[w.grams], w.starts, axis=0)
                per -= per.max(axis=1, keepdims=True)
                fits = self.allowed[w.script]
                known = fits.any(axis=1)  # a script that no language has tells nothing
                per[~known] = 0
                per[known] = np.where(fits[known], per[known], -1e3)
                parts.append(per)
                letters.append(w.letters)
        return np.concatenate(parts), np.concatenate(letters)

    def path(self, per: np.ndarray) -> np.ndarray:
        """The best language of each word under the switching penalty."""
        best = int((per.sum(axis=0) + self.prior * 1e-9).argmax())
        sums = np.concatenate([np.zeros((1, per.shape[1])), np.cumsum(per - per[:, [best]], axis=0)])
        if (sums - np.minimum.accumulate(sums, axis=0)).max() <= SWITCH:
            return np.full(len(per), best)
        return self._viterbi(per)

    def _viterbi(self, per: np.ndarray) -> np.ndarray:
        back = np.empty(per.shape, dtype=np.int16)
        value = per[0] + self.prior * 1e-9
        own = np.arange(per.shape[1])
        for i in range(1, len(per)):
            top = int(value.argmax())
            jump = value[top] - SWITCH
            back[i] = np.where(value >= jump, own, top)
            value = np.maximum(value, jump) + per[i]
        out = np.empty(len(per), dtype=np.int64)
        out[-1] = value.argmax()
        for i in range(len(per) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language of most letters, its share of them, and the spans of words."""
        per, letters = self.scores(text or "")
        if not len(per):
            return "und", 0.0, []
        if not self.languages:
            return "und", 0.0, [(0, len(per), "und")]
        path = self.path(per)
        mass = np.bincount(path, weights=letters, minlength=len(self.languages))
        top = int(mass.argmax())
        cuts = [0, *(np.nonzero(np.diff(path))[0] + 1).tolist(), len(path)]
        spans = [(a, b, self.languages[path[a]]) for a, b in zip(cuts, cuts[1:])]
        return self.languages[top], float(mass[top] / mass.sum()), spans


def _counted(batches):
    """Sparse counts of trigrams, and letters by script, of each language in a partition."""
    found: dict[str, list] = {}
    for batch in batches:
        for lang, t in zip(batch.column(0), batch.column(1)):
            held = found.setdefault(lang.as_py(), [[], 0, np.zeros(len(NAMES), np.int64)])
            for piece in _pieces(t.as_py()):
                w = _words(piece)
                held[0].append(np.unique(w.grams, return_counts=True))
                held[1] += len(held[0][-1][0])
                held[2] += np.bincount(w.script, weights=w.letters, minlength=len(NAMES)).astype(np.int64)
                if held[1] > 4 << GRAM_BITS:
                    held[0] = [_summed(held[0])]
                    held[1] = len(held[0][0][0])
    for lang, (parts, _, scripts) in found.items():
        at, n = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32).tobytes()]), pa.array([n.astype(np.int64).tobytes()]), pa.array([scripts.tobytes()])], names=["lang", "grams", "counts", "scripts"])


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << GRAM_BITS, np.int64)
    for at, n in parts:
        total[at] += n
    at = np.nonzero(total)[0]
    return at, total[at]


def _merged(table: pa.Table) -> pa.Table:
    """One language's counts of all partitions as one row."""
    columns = [table.column(c).to_pylist() for c in ("grams", "counts", "scripts")]
    at, n = _summed([(np.frombuffer(g, np.int32), np.frombuffer(c, np.int64)) for g, c in zip(*columns[:2])])
    scripts = sum(np.frombuffer(x, np.int64) for x in columns[2])
    return pa.table({"lang": [table["lang"][0].as_py()], "grams": [at.astype(np.int32).tobytes()], "counts": [n.tobytes()], "scripts": [scripts.tobytes()]})


def train(labelled: DataFrame, text: str | Column = "text", language: str | Column = "lang", seed: int = 0) -> Model:
    """A model from rows with a text and a non-null language.

    About ``TRAIN_DOCS`` rows of each language are taken, by a seeded hash of their
    text; whole texts count, and every language is learned. Rows of one text are taken
    or left together. Without rows, the model knows no language.
    """
    shape = "lang string, grams binary, counts binary, scripts binary"
    rows = labelled.select(as_column(text).alias("text"), as_column(language).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) * F.col("n") < F.lit(TRAIN_DOCS << 30)
    counted = rows.join(sizes, "lang").filter(drawn).select("lang", "text").mapInArrow(_counted, shape)
    sums = materialize(counted.groupBy("lang").applyInArrow(_merged, shape).join(sizes, "lang"), "counts")
    found = sums.orderBy("lang").collect()  # one row for each language
    languages = [r["lang"] for r in found]
    grams, scripts = np.zeros((1 << GRAM_BITS, len(found)), np.float32), np.zeros((len(NAMES), len(found)))
    for k, r in enumerate(found):
        grams[np.frombuffer(r["grams"], np.int32), k] = np.frombuffer(r["counts"], np.int64)
        scripts[:, k] = np.frombuffer(r["scripts"], np.int64)
    total = grams.sum(axis=0, dtype=np.float64)
    logs = np.log(grams + np.float32(SMOOTHING)) - np.log(total + SMOOTHING * (1 << GRAM_BITS)).astype(np.float32)
    letters = np.maximum(scripts.sum(axis=0), 1)
    n = np.array([r["n"] for r in found], dtype=np.float64)
    return Model(languages, logs, scripts >= 0.01 * letters, n / max(1.0, n.sum()))


def identify(docs: DataFrame, model: Model, text: str | Column = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and, if asked, ``lang_spans``.

    ``lang_pred`` is the language of most letters on the best path, ``score`` its
    share of the letters (0 to 1). A text that is null or has no letters is ``und``
    with score 0; so is any text if nothing was learned. A script that no language was
    seen with leaves the choice to the rest of the text, then to the commonest
    language. ``lang_spans`` are (first word, end, language). Kept columns with these
    names (in any case) are replaced; ties go to the first language in code point
    order. Repeated rows are labelled alike; an empty table stays empty.
    """
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        made.append(T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    kept = others(docs.columns if keep is None else keep, [f.name for f in made])
    # a text that is kept anyway is sent once
    own = [] if isinstance(text, str) and text in kept else [as_column(text).alias(hidden("text"))]
    src = docs.select(*(as_column(c) for c in kept), *own)
    at = len(kept) if own else kept.index(text)
    small_batches(src)
    plain = numbered_columns(src)
    schema = T.StructType([*plain.schema.fields[: len(kept)], *made])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^GRAM_BITS scores for each language

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                found = [shared.value.label(t.as_py()) for t in batch.column(at)]
                columns = [pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    columns.append(pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in f[2]] for f in found], type=kind))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[f.name for f in schema])

    return plain.mapInArrow(run, schema).toDF(*kept, *(f.name for f in made))


def held_out(doc_id: str | Column = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from training, by its id; a null id is not held out."""
    return F.coalesce(F.crc32(as_column(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_documents(docs: DataFrame, seed: int = 0) -> Model:
    """The model that the registered queries use: learned outside the held-out fold."""
    return train(docs.filter(~held_out()), seed=seed)
