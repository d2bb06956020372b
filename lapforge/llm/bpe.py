"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token that starts at
each place of a word. The encoder takes longest tokens from the left; a token may
follow another only if the pair is compatible, that is, if merging by rank would keep
the border between them. Where no token fits, it steps back to the next shorter one;
places from which no encoding leads on are remembered, so a word takes linear time.
Since a sequence of tokens whose neighbours are all compatible is unique, the result
is exactly that of merging by rank.

Compatibility needs every merge to join tokens that earlier merges made (checked on
loading): merges of a word then happen in the order of their ranks, so at any time
the token left of the border is known from its rank alone, and so is the right one.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_column, hidden, numbered_columns, others, small_batches

#: Words and pairs that a worker remembers; beyond it the older half is dropped.
CACHE = 200_000
#: Documents that are encoded and returned at once, whatever Spark's batches hold.
SLICE = 256
_END = 256


def _printable_bytes() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes as the vocabulary file's tokenizer; special tokens in texts get their ids."""

    def __init__(self, spec: bytes):
        import ahocorasick

        data = json.loads(spec)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        # characters that Python's Unicode data has; the library's own tables split texts with newer ones
        self.known_chars = {chr(c) for c in range(0x80)}
        self.library, self.spec = None, spec
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        meaning = self.meaning = _printable_bytes()
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            s = "".join(chr(meaning[c]) for c in (token[: -len(self.suffix)] if ends else token))
            return s[:-1] + chr(ord(s[-1]) + _END) if ends else s

        self.id_of = {symbols(t): i for t, i in model["vocab"].items()}
        self.rank, self.parts, self.joined = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if whole in self.rank or any(x not in self.rank and len(symbols(t)) > 1 for x, t in ((left, a), (right, b))):
                raise ValueError("merges are not in the order of their making")
            self.rank[whole], self.parts[whole], self.joined[left, right] = r, (left, right), whole
        self.trie = ahocorasick.Automaton()
        self.symbols_of = {}
        reachable: set[int] = set()
        by_rank = sorted(self.id_of.items(), key=lambda x: self.rank.get(x[1], -1))
        for s, i in by_rank:
            if i in self.parts:
                a, b = self.parts[i]
                if not (a in reachable and b in reachable and self._border_holds(a, b, self.rank[i])):
                    continue
            elif len(s) > 1:
                continue
            reachable.add(i)
            self.symbols_of[i] = s
            self.trie.add_word(s, (len(s), i))
        self.trie.make_automaton()
        self.reach_of = {s: i for i, s in self.symbols_of.items()}
        self.length = {i: len(s) for i, s in self.symbols_of.items()}
        self.compatible = lru_cache(CACHE)(self._compatible)
        self.shorter = lru_cache(CACHE)(self._shorter)
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        blobs = [(self.text_of.get(i, "") + " ").encode() for i in range(max(self.text_of) + 1)]
        self.lengths = np.array([len(b) for b in blobs], dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int32)
        self.blob = np.frombuffer(b"".join(blobs), dtype=np.uint8)

    def _border_holds(self, left: int, right: int, before: int) -> bool:
        """Whether merges of rank under ``before`` leave the border between two tokens.

        Unmakes, step by step, the later made of the two tokens at the border. While
        a pair stands there, its merge happens if its rank comes before the one that
        makes the left token's whole, or not after the right one's (at equal ranks the
        leftmost goes first).
        """
        until_left = until_right = before
        while True:
            whole = self.joined.get((left, right))
            if whole is not None:
                r = self.rank[whole]
                if r < until_left and (r < until_right or r == until_right < before):
                    return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until_left, left = a, self.parts[left][1]
            else:
                until_right, right = b, self.parts[right][0]

    def _compatible(self, left: int, right: int) -> bool:
        return self._border_holds(left, right, len(self.rank))

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        s = self.symbols_of[token]
        return next((i for k in range(len(s) - 1, 0, -1) if (i := self.reach_of.get(s[:k])) is not None), -1)

    def _word(self, word: str) -> tuple:
        """Ids of a word, each of whose characters stands for a byte."""
        s = word
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + _END)
        if (whole := self.reach_of.get(s)) is not None:
            return (whole,)
        n = len(s)
        longest: list = [-1] * n
        size = [0] * (n + 1)
        for end, (k, token) in self.trie.iter(s):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, token
        compatible, length = self.compatible, self.length
        taken: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not taken or compatible(taken[-1], token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                taken.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:
                dead[at] = 1
                if not taken:
                    raise ValueError(f"the vocabulary has no tokens for {word!r}")
                token = taken.pop()
                at -= length[token]
                token = self.shorter(token)
        return tuple(taken)

    def _known(self, word: str) -> tuple:
        ids = self.new.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._word(word.encode("utf-8", "surrogatepass").decode("latin-1"))
            if len(self.new) >= CACHE // 2:
                self.old, self.new = self.new, {}
            if len(word) <= 64:
                self.new[word] = ids
        return ids

    def _plain(self, text: str) -> list:
        if not text.isascii():
            unseen = set(text) - self.known_chars
            if unseen:
                if any(unicodedata.category(c) == "Cn" for c in unseen):
                    return self._by_library(text)
                self.known_chars |= unseen
            # each character on its own: no special form of a sigma at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known = self._known
        return [known(w) for w in self.pattern.findall(text.lower())]

    def _by_library(self, text: str) -> list:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec.decode())
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self._word("".join(chr(self.meaning[c]) for c in w)) for w, _ in words]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as int32; a null text has none."""
        text = text or ""
        pieces: list = []
        at = 0
        if "<" in text and self.special_re is not None:
            for m in self.special_re.finditer(text):
                pieces += self._plain(text[at : m.start()])
                pieces.append((self.special[m.group()],))
                at = m.end()
        pieces += self._plain(text[at:] if at else text)
        return np.fromiter(itertools.chain.from_iterable(pieces), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by spaces: the file names no decoder."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.blob[where[:-1]].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(spec: bytes) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary()).cast(pa.string())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))


def _mapped(df: DataFrame, vocabulary: str, at: int, outputs: dict[str, T.DataType]) -> DataFrame:
    """``df`` without its ``at``-th column, a text or ids, and with what is made of it."""
    with open(vocabulary, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 2 MB
    small_batches(df)
    plain = numbered_columns(df)
    kept = [c for i, c in enumerate(df.columns) if i != at]
    schema = T.StructType([*(f for i, f in enumerate(plain.schema.fields) if i != at), *(T.StructField(k, v) for k, v in outputs.items())])

    def run(batches):
        coder = _encoder(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                values = batch.column(at)
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
                    ids = [np.asarray(x if x is not None else [], dtype=np.int32) for x in values.to_pylist()]
                else:
                    ids = [coder.encode(x) for x in values.to_pylist()]
                made = {"ids": lambda: _lists(ids), "decoded": lambda: _strings([coder.decode(x) for x in ids])}
                yield pa.RecordBatch.from_arrays([*columns, *(made[k]() for k in outputs)], names=[f.name for f in schema])

    return plain.mapInArrow(run, schema).toDF(*kept, *outputs)


_IDS, _TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def _with(df: DataFrame, text: str | Column, keep: list[str] | None) -> DataFrame:
    names = others(df.columns if keep is None else keep, ["ids", "decoded"])
    return df.select(as_column(text).alias(hidden("text")), *(as_column(c) for c in names))


def encode(df: DataFrame, vocabulary: str, text: str | Column = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``ids``, the tokens of each whole text.

    Null and empty texts have no tokens. Order, ties and repeated rows play no part:
    each row is encoded by itself. Kept columns named ids or decoded, in any case, are
    replaced. An empty table stays empty.
    """
    return _mapped(_with(df, text, keep), vocabulary, 0, {"ids": _IDS})


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` with its ids column replaced by ``decoded``; null ids give an empty text."""
    names = [c for c in others(df.columns, ["decoded"]) if c != ids]
    return _mapped(df.select(as_column(ids), *map(as_column, names)), vocabulary, 0, {"decoded": _TEXT})


def round_trip(df: DataFrame, vocabulary: str, text: str | Column = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: the ``keep`` columns, ``ids``, ``decoded``."""
    return _mapped(_with(df, text, keep), vocabulary, 0, {"ids": _IDS, "decoded": _TEXT})


def digests(coded: DataFrame, keep: list[str]) -> DataFrame:
    """Token counts and digests of ``round_trip`` rows."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
