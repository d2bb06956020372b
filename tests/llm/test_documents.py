"""Operators on single documents: tokens, quality, personal data, languages, shards, mixes."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.llm import bpe, catalogue, langid, mixing, pii, quality, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hexed(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalogue.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(catalogue.vocabulary(), "rb") as f:
        return bpe.Encoder(f.read())


def test_encoder_equals_library_on_random_texts(library, encoder):
    rng = np.random.default_rng(5)
    alphabets = ["ab", "aab ", "eth", "abcdefghijklmnopqrstuvwxyz'", "éèñ 日本👍🏽\u200da", "!@#$%^&*()_+ -=<|>/", "ΣσςİıÀ ", "0123 '", "\u1c89\u0558\ua7cb x"]
    for _ in range(3000):
        letters = list(alphabets[rng.integers(len(alphabets))])
        text = "".join(rng.choice(letters, rng.integers(1, 60)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text.upper() + " <|startoftext|>"
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, text
        assert encoder.decode(np.array(ids, np.int32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_every_character(library, encoder):
    for c in [*range(0x250), *range(0x250, 0xD800, 7), *range(0xE000, 0x20000, 31)]:
        text = f"a{chr(c)}B{chr(c)}{chr(c)} x"
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_op3(spark, library, odd, none):
    docs = documents(spark)
    got = {r.doc_id: r for r in catalogue.op3_bpe(spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids, skip_special_tokens=False)))
    both = bpe.decode(bpe.encode(odd, catalogue.vocabulary()), catalogue.vocabulary()).collect()
    once = bpe.round_trip(odd, catalogue.vocabulary(), keep=["doc_id", "ids", "score"]).collect()
    assert len(both) == len(once) == odd.count() and sorted(r.decoded for r in both) == sorted(r.decoded for r in once)
    assert bpe.round_trip(none, catalogue.vocabulary()).count() == 0


# --- quality


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = list(zip(w, w[1:], w[2:]))
    counts = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered)


def test_op2_counts(spark, odd, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (documents(spark), odd):
        got = sorted(tuple(r) for r in quality.measure(docs.fillna({"doc_id": -1}), keep=["doc_id"]).select("doc_id", *names).collect())
        assert got == sorted((-1 if r.doc_id is None else r.doc_id, *measured(r.text)) for r in docs.collect())
        judged = quality.judge(docs).collect()
        assert len(judged) == docs.count()
        for r in judged:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judge(none).count() == 0


def test_sketch_buckets_and_merging(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 10**6, 10**12]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    rows = rows.select("v", "b", quality.least_of(F.col("b")).alias("low")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.low <= r.v and r.v - r.low <= r.v / 32 for r in rows) and all(r.low == r.v for r in rows if r.v < 64)
    docs = quality.measure(documents(spark), keep=["lang", "source"])
    whole = sorted(map(tuple, quality.sketch(docs, ["lang"]).collect()))
    merged = quality.merge(quality.sketch(docs, ["lang", "source"]), ["lang"])
    assert whole == sorted(map(tuple, merged.collect()))


def test_op2_rejects_junk_and_keeps_clean(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = catalogue.op2_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("not base_failed")
    good, bad = found.filter("quality = 1"), found.filter("quality = 0")
    assert good.filter("kept").count() >= 0.99 * good.count()
    assert bad.filter("kept").count() <= 0.05 * bad.count()


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


TRICKY = [
    "a@b.c%d@e.f x", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.3.0255", "4111 1111 1111 1111 4111-1111-1111-1112, 41111111111111111111 4111  111111111111",
    "+1 (555) 123-4567 +12 +1234567890123456 ++1 555 123 4567", "é😀 x@y.zz 日本 10.0.0.1 " + "a" * 5000 + "@b " + "1" * 3000, "x@y.z." * 700 + " end", "4 4 4 4 4 4 4 4 4 4 4 4 0", "5  5500000000000004-", "1-1-1.2.3.4",
]


def test_op5_base(spark, odd, none):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for docs in (documents(spark), tricky, odd):
        rows = pii.digests(pii.detect(docs, keep=["doc_id", "text"]), ["doc_id", "text"]).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = base_spans(r.text)
            assert r.base_sha256 == hexed(want), r.text
            assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])
    assert pii.detect(none).count() == 0


def test_op5_random(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("0123456789.-+ @ab()%"), rng.integers(1, 120))) for _ in range(600)]
    rows = pii.digests(pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]), ["doc_id"]).collect()
    for r in rows:
        assert r.base_sha256 == hexed(base_spans(texts[r.doc_id])), texts[r.doc_id]


def test_op5_many_spans(spark):
    text = "10.0.0.1 " * 3000
    row = pii.digests(pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["doc_id"]), ["doc_id"]).first()
    assert row.n_ip == 3000 and row.base_sha256 == hexed(base_spans(text))


def test_op5_contexts_find_unseen(spark):
    rows = [(i, f"please call me at +1 (555) 123-{1000 + i} today") for i in range(30)]
    rows += [(100 + i, f"some words then call me at 555 123 {2000 + i} ok") for i in range(3)]
    rows += [(200 + i, f"the order number is 555 777 {3000 + i} ok") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.pii] for r in pii.detect(docs).collect()}
    assert all(found[100 + i] == [("phone", f"555 123 {2000 + i}")] for i in range(3))
    assert all(found[200 + i] == [] for i in range(10))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[0] == "please call me at <phone> today" and masked[100] == "some words then call me at <phone> ok" and masked[200] == rows[33][1]


def found_in(spark, texts):
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [[(s.kind, r.text[s.start : s.end]) for s in r.pii] for r in rows]


def test_op5_contexts_find_unseen_email_forms(spark):
    texts = [f"you can write to person{chr(97 + i)}@mail.org today" for i in range(25)] + ["or write to user@localhost today", "please write to jane@exämple.org today", "prices count to @five today"]
    found = found_in(spark, texts)
    assert found[25] == [("email", "user@localhost")] and found[26] == [("email", "jane@exämple.org")] and found[27] == []


def test_op5_identifiers_beside_others(spark):
    texts = [f"mail or call jane{chr(97 + i)}@x.org +1 (555) 321-{1000 + i} now" for i in range(25)] + ["mail or call mary@x.org 0171 2345678 now"]
    texts += [f"ring me at +1 (555) 123-{1000 + i} or +1 (555) 987-{1000 + i} now" for i in range(25)] + ["ring me at 555 123 4567, or 555 123 9999 now", "see page 7 me at 555 321 4567 now"]
    found = found_in(spark, texts)
    assert found[25] == [("email", "mary@x.org"), ("phone", "0171 2345678")]
    assert found[51] == [("phone", "555 123 4567"), ("phone", "555 123 9999")] and found[52] == [("phone", "555 321 4567")]


def test_mask_keeps_the_rest(spark, odd):
    assert sorted(map(repr, pii.mask(odd).collect())) == sorted(map(repr, odd.collect()))


def plain_candidates(text):
    """(start, value, context, shape, seed) of a text, by regular expressions and loops."""
    spans = []
    for start, end, kind in sorted((int(a), int(b), list(BASE).index(k)) for k, a, b in (s.split(":") for s in base_spans(text).split(",") if s)):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end, list(BASE)[kind]])
    word = r"[^\x20\x09-\x0D]"
    runs, pieces, at = rf"(?<!{word}){word}*[0-9@]{word}*(?:\x20{word}*[0-9@]{word}*)*", [], 0
    for start, end, kind in [*spans, [len(text), len(text), None]]:
        last = at
        for m in re.finditer(runs, text[at:start]):
            pieces.append((at + m.start(), m.group(), text[last : at + m.start()], None))
            last = at + m.end()
        if kind:
            pieces.append((start, text[start:end], text[last:start], kind))
        at = end
    out, said = [], "^ "
    for start, raw, gap, kind in pieces:
        said += gap
        value, lead = raw, 0
        if not kind:
            lead = len(re.match(r"[^A-Za-z0-9@+(]*", raw).group())
            value = re.sub(r"[^A-Za-z0-9)]+$", "", raw[lead:])
            n, letters = sum(c in "0123456789" for c in raw), len(re.findall("[A-Za-z]", raw))
            if re.match(r"""["'`][A-Za-z0-9+/_=.-]{20,}["'`]""", raw) and n >= 5 and letters >= 5 and re.search(r"[=:]\s*$", gap):
                kind = "secret"
        n = sum(c in "0123456789" for c in value)
        if kind or "@" in value or n >= 5:
            shape = "@" if "@" in value else ("5-8" if n < 9 else "9-11" if n < 12 else "12-19" if n < 20 else "20-") + ("a" if re.search("[A-Za-z]", value) else "")
            words = said.lower().split()
            out.append((start + lead, value, " ".join(words[-2:]) if len(words) > 1 else None, shape, kind))
            said += f" <{shape}> "
        else:
            said += raw
    return out


def plain_trusted(texts):
    """The scores of the graph over distinct texts, with loops: {(context, shape): kind}."""
    edges = {}
    for t in set(texts):
        for _, value, context, shape, seed in plain_candidates(t):
            if context is not None:
                key = (context, shape, value)
                edges[key] = max(edges.get(key) or "", seed or "") or None
    seeds = {}
    for (_, _, value), kind in edges.items():
        if kind:
            seeds[value] = max(seeds.get(value, ""), kind)
    known = {(v, k): 1.0 for v, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        sums, n = collections.defaultdict(lambda: [0.0, 0]), collections.Counter()
        for context, shape, value in edges:
            n[context, shape] += 1
            for kind in (*pii.KINDS, pii.SECRET):
                if (value, kind) in known:
                    sums[context, shape, kind][0] += known[value, kind]
                    sums[context, shape, kind][1] += known[value, kind] == 1.0
        scored = {k: (s / (n[k[:2]] + 1), m) for k, (s, m) in sums.items() if n[k[:2]] > 1}
        known = {(v, k): 1.0 for v, k in seeds.items()}
        for (context, shape, value), seed in edges.items():
            for kind in (*pii.KINDS, pii.SECRET):
                if not seed and value not in seeds and (context, shape, kind) in scored:
                    known[value, kind] = max(known.get((value, kind), 0), scored[context, shape, kind][0])
    best = {}
    for (context, shape, kind), (score, m) in scored.items():
        if score >= pii.TRUST and m >= pii.SUPPORT:
            best[context, shape] = max(best.get((context, shape), (0, "")), (score, kind))
    return {k: kind for k, (_, kind) in best.items()}


def random_contacts(seed):
    """Texts of all kinds of identifiers, seeds and unseen ones, after many wordings."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = {
        "email": lambda: [f"u{digits(2)}@mail.org", f"u{digits(1)}@host", f"@u{digits(3)}"][rng.choice(3, p=[0.8, 0.1, 0.1])],
        "ip": lambda: [".".join(map(str, rng.integers(10, 256, 4))), ".".join(map(str, rng.integers(256, 999, 4)))][rng.choice(2, p=[0.9, 0.1])],
        "phone": lambda: [f"+1 (555) {digits(3)}-{digits(4)}", f"0555 {digits(3)} {digits(4)}"][rng.choice(2, p=[0.9, 0.1])],
        "card": lambda: [next(c for c in (digits(16) for _ in range(500)) if luhn(c)), digits(16)][rng.choice(2, p=[0.9, 0.1])],
        "secret": lambda: [f'"{rng.bytes(16).hex()}a1b2c3d4e5f"', rng.bytes(12).hex() + "a12345"][rng.choice(2, p=[0.9, 0.1])],
    }
    leads = {"email": ["write to", "mail me:"], "ip": ["from host", "came from"], "phone": ["call me at", "ring"], "card": ["pay by card", "number"], "secret": ["the token =", "key:"]}
    words, out = "the a of order 7 page see ok".split(), []
    for _ in range(250):
        parts = []
        for _ in range(rng.integers(0, 4)):
            kind = rng.choice(list(forms))
            parts += [*rng.choice(words, rng.integers(0, 4)), rng.choice(leads[kind]) if rng.random() < 0.8 else "", forms[kind](), *(["or", forms[kind]()] if rng.random() < 0.2 else [])]
        out.append(" ".join(map(str, parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_op5_graph_equals_plain_scores(spark, seed):
    texts = random_contacts(seed)
    trusted = plain_trusted(texts)
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()
    added = collections.Counter()
    for r in rows:
        t = texts[r.doc_id]
        want = [tuple(s.split(":")) for s in base_spans(t).split(",") if s]
        more = [(trusted[c, shape], str(at), str(at + len(v))) for at, v, c, shape, kind in plain_candidates(t) if kind in (None, "secret") and (c, shape) in trusted]
        added.update(k for k, _, _ in more)
        rank = (*pii.KINDS, pii.SECRET).index
        assert [(s.kind, str(s.start), str(s.end)) for s in r.pii] == sorted(want + more, key=lambda s: (int(s[1]), rank(s[0]), int(s[2]))), t
    assert {"email", "phone", "secret"} <= set(added)


def test_op5_finds_assigned_secrets(spark):
    texts = [f'deploy with token = "{i:02x}bc0a5302762f37969011b69180d661037b374f6e" ok' for i in range(20)] + ["deploy with token = Zx81hQ7733aa901 ok", "commit bc0a5302762f37969011b69180d661037b374f6e done"]
    found = found_in(spark, texts)
    assert found[0] == [("secret", "00bc0a5302762f37969011b69180d661037b374f6e")] and found[21] == []


# --- languages


def test_op9(spark, odd, none):
    docs = documents(spark)
    found = catalogue.op9_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    model = langid.train_documents(docs)
    rows = langid.identify(odd, model, spans=True).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in model.languages for r in rows if any(c.isalpha() for c in r.text or ""))
    assert langid.identify(none, model).count() == 0
    blank = langid.train(none)
    assert blank.label("some text")[0] == "und" and langid.identify(odd, blank).count() == odd.count()


def test_every_language_is_learned(spark):
    """600 languages; scores equal a plain sum over trigrams of counted texts."""
    rng = np.random.default_rng(3)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)] for k in range(600)}
    rows = [(3 * i + n, " ".join(rng.choice(words[k], 20)), k) for i, k in enumerate(sorted(words)) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.repartition(6))
    assert model.languages == sorted(words)
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, model).collect())
    grams = {k: collections.Counter() for k in words}
    plain = lambda w: [("\0\0" + w + "\0")[i : i + 3] for i in range(len(w) + 1)]
    for _, text, k in rows:
        for w in text.split():
            grams[k].update(plain(w))
    total = {k: sum(c.values()) for k, c in grams.items()}
    some = rows[17]
    want = [sum(np.log((grams[k][g] + langid.SMOOTHING) / (total[k] + langid.SMOOTHING * 2**langid.GRAM_BITS)) for g in plain(some[1].split()[0])) for k in model.languages]
    got = model.scores(some[1])[0][0]
    # up to trigrams that share a bucket
    assert np.corrcoef(got, want)[0, 1] > 0.99 and got.argmax() == np.argmax(want)


def test_viterbi_shortcut_and_spans():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), np.ones(3) / 3)
    for _ in range(300):
        per = rng.normal(0, 4, (rng.integers(1, 40), 3))
        score = lambda p, per=per: per[np.arange(len(per)), p].sum() - langid.SWITCH * (np.diff(p) != 0).sum()
        assert score(model.path(per)) == pytest.approx(score(model._viterbi(per)), abs=1e-6)


def test_mixed_text_has_spans(spark):
    model = langid.train_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    docs = {r.lang: r.text for r in documents(spark).filter("n_chars > 1500").select("lang", "text").collect()}
    text = docs["de"][:1200] + " " + docs["es"][:1200]
    lang, score, spans = model.label(text)
    assert lang in ("de", "es") and score < 0.7 and {s[2] for s in spans} == {"de", "es"}


def test_long_texts_are_cut_at_words():
    text = "ab cd " * 100_000
    assert "".join(langid._pieces(text)) == text and len(list(langid._pieces(text))) > 1
    whole = langid._words("ab cd " * 10)
    assert len(whole.starts) == 20 and whole.letters.tolist() == [2] * 20


# --- shards


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        rule = sharding.Permutation(n, 7)
        places = rule.place(np.arange(n))
        assert sorted(places.tolist()) == list(range(n)) and (rule.row_at(places) == np.arange(n)).all()
    assert (sharding.Permutation(1000, 1).place(np.arange(1000)) != sharding.Permutation(1000, 2).place(np.arange(1000))).any()
    shard, slot = sharding.place(123, 1000, 16, 5)
    assert sharding.row_at(shard, slot, 1000, 16, 5) == 123


def test_op6(spark, odd, none):
    rows = catalogue.op6_sharding(spark, SF).collect()
    docs = sorted(documents(spark).collect(), key=lambda r: r.doc_id)
    rule = sharding.Permutation(len(docs), 20)
    want = {r.doc_id: (int(p) % 16, int(p) // 16) for r, p in zip(docs, rule.place(np.arange(len(docs))))}
    text = {r.doc_id: r.text for r in docs}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.shard, r.slot) == want[r.doc_id] and r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    again = sharding.shard_documents(documents(spark).repartition(7), 16, 20).select("doc_id", "shard", "slot").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    got = sharding.shard_documents(odd, 4).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == odd.count() and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(1, 0)}
    assert sharding.shard_documents(none).count() == 0


# --- mixes


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}) == {"a": 200.0, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    assert mixing.targets({"a": 0, "b": 0}, {"a": 1, "b": 1}) == {"a": 0.0, "b": 0.0}
    quota = mixing.targets({"a": 1, "b": 1000}, {"a": 3, "b": 1})
    assert quota["a"] == 2 and quota["b"] == pytest.approx(1.5 * 1001 - 2)


def test_flow_shares_overlaps_before_repeating():
    # both sources need 100; the shared pattern must serve the one that has nothing else
    flow = mixing.route({("a",): 100, ("a", "b"): 100}, {"a": 100.0, "b": 100.0})
    assert flow == {(("a",), "a"): 100.0, (("a", "b"), "b"): 100.0}
    flow = mixing.route({("a",): 100}, {"a": 150.0})
    assert flow == {(("a",), "a"): 150.0}
    assert mixing.route({("a",): 100}, {"a": 500.0}) == {(("a",), "a"): 200.0}


def test_flow_equals_smallest_cuts():
    """On random overlaps: the flow of every pass is the least cut, by trying all sets of sources."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        sources = list("abcde")[: rng.integers(1, 6)]
        patterns = {tuple(sorted(rng.choice(sources, rng.integers(1, len(sources) + 1), replace=False).tolist())): int(rng.integers(0, 50)) for _ in range(rng.integers(1, 9))}
        quota = {s: float(rng.integers(0, 90)) for s in sources}
        for epochs in (1, 2, 3):
            flow = mixing.route(patterns, quota, epochs)
            cut = min(sum(quota[s] for s in some) + sum(epochs * n for p, n in patterns.items() if set(p) - set(some)) for k in range(len(sources) + 1) for some in itertools.combinations(sources, k))
            assert sum(flow.values()) == pytest.approx(cut)
            for s in sources:
                assert sum(x for (_, t), x in flow.items() if t == s) <= quota[s] + 1e-6
            # no later pass over one pattern while first passes would do: passes fill in turn
            assert sum(min(sum(x for (q, _), x in flow.items() if q == p), n) for p, n in patterns.items()) >= sum(mixing.route(patterns, quota, 1).values()) - 1e-6


def test_op8(spark, odd, none):
    rows = catalogue.op8_mixing(spark, SF).collect()
    text = {r.doc_id: (r.text, r.source) for r in documents(spark).collect()}
    sizes = collections.Counter()
    for t, s in text.values():
        sizes[s] += len(WORD.findall(t))
    quota = mixing.by_weights(dict(sizes))
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        t, s = text[r.doc_id]
        assert r.size == len(WORD.findall(t)) and r.source_size == sizes[s] and r.target == pytest.approx(quota[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - quota[s]) <= largest[s] for s in sizes)
    again = mixing.mixed_words(documents(spark).repartition(5), seed=20).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert len(mixing.mixed_words(odd).collect()) == odd.count() and {r.source_size for r in mixing.mixed_words(odd.filter("source is null")).collect()} == {0}
    assert mixing.mixed_words(none).count() == 0


def test_mix_of_documents_in_several_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 2 else ["b", "a", None]) for i in range(40)], "doc_id long, text string, sources array<string>")
    rows = mixing.mix(docs, source="sources").collect()
    assert len(rows) == 40 and all(0 <= r.mix_times <= 2 and r.mix_size == 10 for r in rows)
