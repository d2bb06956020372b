"""Operators on pairs and trees: near duplicates, vectors, chats, URLs, the pipeline."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapforge.llm import bpe, catalogue, chat, components, scratch, shingles, simhash, urls, vectors

SF = "/root/testdata/sf0.001"


def hexed(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def rooted(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(4)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(30, i) for i in range(60)], "random": [tuple(map(int, p)) for p in rng.integers(0, 80, (70, 2))], "none": []}[shape]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = rooted(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n != r}


# --- near duplicates


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op4(spark, odd, none):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        text = {r.doc_id: r.text for r in docs.collect()}
        prints = {i: plain_fingerprint(t) for i, t in text.items()}
        ids = sorted(prints)
        pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
        want = rooted(pairs, ids)
        got = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_digits("fingerprint")).collect()
        assert {r.doc_id: (r.hex, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot,many", [(1, 1 << 25), (4, 1 << 25), (2048, 1 << 25), (4, 1), (2048, 1)])
def test_links_of_hot_values_are_exact(spark, hot, many):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 12)
    values = {0}
    for c in centres:
        for _ in range(15):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            values.add(x if x < 1 << 63 else x - (1 << 64))
    values = sorted(values)
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = rooted(near, values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 4, hot, many).collect()
    assert rooted([(r.u, r.v) for r in found], values) == want


def test_segments_cover_every_distance():
    for distance in range(1, 9):
        plan = simhash.segments(distance)
        assert sum(r + 1 for _, r in plan) == distance + 1


def test_documents_without_an_id_or_of_one_id(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(None, ""), (None, "a b c d e f"), (5, ""), (5, "x y z w v u"), (6, long), (7, long), (7, "p q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for drop in (simhash.drop_duplicates, shingles.drop_duplicates):
        assert sorted(map(repr, map(tuple, drop(docs).collect()))) == sorted(map(repr, [rows[1], rows[2], rows[3], rows[4], rows[6]]))


def test_drop_duplicates(spark, odd):
    left = simhash.drop_duplicates(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and 6 in ids


def plain_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_copies(docs, count=None):
    """The least doc_id that each document reaches by links of Jaccard similarity 0.8; ``count`` gets those of unequal sets."""
    sets = {r.doc_id: plain_shingles(r.text) for r in docs.collect()}
    ids, holders = sorted(sets), collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    both = collections.Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    pairs = [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    pairs += [(a, b) for a, b in itertools.combinations([i for i in ids if not sets[i]], 2)]
    if count is not None:
        count.append(sum(0 < len(sets[a] ^ sets[b]) for a, b in pairs))
    return rooted(pairs, ids)


@pytest.mark.parametrize("block", [2, 256])
def test_pipeline_drops_every_copy_at_least_as_similar_as_0_8(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unequal = []
    want = plain_copies(docs, unequal)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, block=block).collect()} == want
    assert unequal[0] >= 10
    if block == 256:
        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == set(want.values())


@pytest.mark.parametrize("centres", [0, 1, 32])
def test_large_clusters_lose_no_link(spark, centres, monkeypatch):
    monkeypatch.setattr(shingles, "CENTRES", centres)
    rng, rows = np.random.default_rng(6), []
    words = [f"w{i}" for i in range(5000)]
    bases = [rng.choice(words, 120).tolist() for _ in range(3)]
    passage = rng.choice(words, 80).tolist()
    for i in range(150):  # copies with more and more edits, cut ones, and texts that share a passage
        t = list(bases[i % 3])
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            t[at] = rng.choice(words)
        rows.append(t[: rng.integers(80, 121)] if i % 5 == 0 else t)
    rows += [passage + rng.choice(words, rng.integers(1, 40)).tolist() for _ in range(60)]
    rows += [bases[0] + bases[1]]
    docs = spark.createDataFrame([(i, " ".join(map(str, t))) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, block=8).collect()} == plain_copies(docs)


# --- vectors


def plain_links(rows, cosine):
    ok = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    count, pairs = {i: 0 for i, _, _ in rows}, []
    for n, (i, v, k) in enumerate(ok):
        for j, w, m in ok[:n]:
            if k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                count[i] += 1
                count[j] += 1
                pairs.append((i, j))
    return count, rooted(pairs, [i for i, _, _ in rows])


def vector_rows():
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1, 2):
        base = rng.normal(size=(12, 16))
        for k in range(60):
            rows.append((len(rows), (base[k % 12] + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.3])).tolist(), label))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [], 1), (2006, [1e300] * 16, 2), (2007, [1e-300] * 16, 2), (2008, [1.0] * 8, 2), (2009, [float("inf")] + [0.0] * 15, 0), (2010, [-0.0] * 15 + [1.0], 1), (2011, [0.0] * 15 + [2.0], 1)]
    return rows


@pytest.mark.parametrize("block,cell", [(4096, 4096), (1024, 20), (16, 60), (16, 4096)])
def test_op10(spark, block, cell, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL", cell)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    count, root = plain_links([r for r in rows if r[0] not in (2006, 2007)], 0.93)
    got = vectors.near_duplicates(df, 0.93).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id in (2006, 2007):
            assert (r.n_links, r.component_id) == (1, 2006)
        else:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], root[r.vec_id], r.vec_id == root[r.vec_id]), r
    assert vectors.near_duplicates(df.limit(0), 0.93).count() == 0


def test_op10_repeats_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)]
    got = sorted(map(repr, vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).select("n_links", "component_id", "kept").collect()))
    assert got == sorted(map(repr, [type(r)(*r) for r in []])) or len(got) == 4
    assert sum("n_links=2" in g and "component_id=1" in g for g in got) == 3


# --- chats


def test_op1(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect() + [type("R", (), {"conv_id": -7, "turn": t, "role": r, "text": catalogue.TRICKY}) for t, r in ((0, "user"), (1, "assistant"))]
    talks = {}
    for r in sorted(rows, key=lambda r: r.turn):
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in catalogue.op1_chat(spark, SF).collect()}
    assert set(got) == set(talks)
    for i, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[i]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss))


def test_chat_odd_rows_round_trip(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|> <\\\\s> [/INST][INST] <<SYS>><</SYS>>", "😀 [\\INST]", "plain"]
    rows = [(c, t, role, x) for c in (1, None) for t, (role, x) in enumerate(zip(["user", "assistant", None, "assi~n\nstant", "assistant", "<s>"], texts))]
    rows += [(1, 2, None, None), (1, 2, None, None), (2, None, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    made = chat.format_trees(chat.chains(df))
    back = {r.tree: r for r in chat.read_back(made, ["tree", "formatted", "loss_mask"]).collect()}
    key = lambda r: (r[1] is not None, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv, tree in ((1, "=1"), (None, ""), (2, "=2")):
        want = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in back[tree].turns] == [(r[2] or "", r[3] or "") for r in want]
        r = back[tree]
        assert [r.formatted[m.start : m.end] for m in r.loss_mask if m.end > m.start] and tree != "=2" or tree == "=2"
        learned = [x[3] for x in want if x[2] == "assistant" and x[3]]
        assert list(r.learned) == learned
        plain = [re.sub(r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)", r"\1\2\3", r.formatted[m.start : m.end]) for m in r.loss_mask if m.end > m.start]
        assert plain == learned
    assert chat.digests(chat.format_trees(chat.chains(df.limit(0)))).count() == 0


def test_reply_trees(spark):
    #      0 - 1 - 3 - 5      best path by score is 0 1 4; then the longest
    #        \ 2  \ 4
    rows = [("t", 0, None, 1.0), ("t", 1, 0, 1.0), ("t", 2, 0, 0.5), ("t", 3, 1, 0.1), ("t", 4, 1, 9.0), ("t", 5, 3, 0.1), ("u", 0, 99, None), ("u", 1, 0, 2.0)]
    df = spark.createDataFrame([(*r, "user", f"{r[0]}{r[1]}") for r in rows], "tree string, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat.paths(df, 2).orderBy(F.desc("back")).collect():
        paths.setdefault((r.tree, r.leaf), []).append(r.node)
    assert paths == {("t", 4): [0, 1, 4], ("t", 5): [0, 1, 3, 5], ("u", 1): [0, 1]}
    assert {r.tree: r.leaf for r in chat.format_trees(df).collect()} == {"t": 4, "u": 1}
    long = spark.range(300).select(F.lit("x").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    made = chat.format_trees(long).collect()
    assert len(made) == 1 and made[0].n_turns == 300 and made[0].formatted.index("\n299<") > made[0].formatted.index("\n298<")
    with pytest.raises(ValueError, match="own ancestor"):
        chat.paths(spark.createDataFrame([("c", 0, 1, 1.0), ("c", 1, 0, 1.0)], "tree string, node long, parent long, score double")).collect()


# --- URLs


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(t), t, v) for t, v in urls.RULES for d, _, p in [t.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


ODD_URLS = [None, "", "no scheme", "http://", "http://A.Net", "http://a.NET/x?y#z", "x://example.net/en", "https://example.net/en/", "https://sub.example.com/de/1?q://z", "http://org/fr/", "http://notexample.net/", "a://b://c/d", "http://É.net/É", "http://net/#/", "http://u@example.com:80/de/", "http://long.com/" + "deep/" * 3000 + "?" + "a=1&" * 2000]


def plain_tokens(host, path, url):
    words = re.findall(r"[^\W\d_]+", "/".join([p for p in host.split(".") if p][:-1]) + "/" + path.lower())
    names = re.search(r"\?([^#]*)", url or "")
    names = [n.split("=")[0] for n in names.group(1).split("&")] if names else []
    own = {"net", "example", "en", "com", "de", "org", "fr"}
    return {f"word:{w}" for w in words if len(w) > 2 and w not in own} | {f"param:{n}" for n in names if n}


def plain_rules(rows, least, confidence):
    """All sets of tokens that are frequent and confident, and have no such subset."""
    blocked, every = collections.Counter(), collections.Counter()
    for held, bad in rows:
        for k in range(1, len(held) + 1):
            for s in itertools.combinations(sorted(held), k):
                every[s] += 1
                blocked[s] += bad
    good = {s for s in every if blocked[s] >= least and blocked[s] >= confidence * every[s]}
    return {s for s in good if not any(set(o) < set(s) for o in good)}


@pytest.mark.parametrize("where,least", [(SF, 2), ("/root/testdata/sf0.01", 3), ("/root/testdata/sf0.1", 10)])
def test_op7_equals_plain_mining(spark, where, least):
    """Every verdict, by listed rules and by brute force over all sets of tokens."""
    pages = spark.read.parquet(f"{where}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://a.net/"), (None, "http://a.net/")], "page_id long, url string"))
    pages = pages.withColumn("host", F.lit("clash")).withColumn("a.b", F.lit(1))
    urls_of = pages.select("page_id", "url").collect()
    rows = [(*plain_rule(r.url), plain_tokens(*plain_rule(r.url)[:2], r.url)) for r in urls_of]
    known = [(t, v == "block") for _, _, _, v, t in rows if v]
    mined = plain_rules(known, max(least, -(-len(known) // 1000)), 0.9)
    want = sorted(repr((i.page_id, h, p, rule, v or ("block" if any(set(m) <= t for m in mined) else "allow"))) for i, (h, p, rule, v, t) in zip(urls_of, rows))
    got = urls.judge(pages, min_count=least).collect()
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want
    assert (where == SF or mined) and (not where.endswith("0.1") or any(r.mined for r in got))


def test_op7_odd_tables(spark):
    pages, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "labels"))
    assert urls.judge(pages.limit(0), labels).count() == 0 and urls.judge(pages.limit(0)).count() == 0
    assert urls.judge(pages, labels.limit(0)).count() == pages.count()
    junk = spark.createDataFrame([(i, f"http://www.casino{i % 3}.example.com/en/{i}") for i in range(40)] + [(100 + i, f"http://fine.example.org/en/{i}") for i in range(40)] + [(200 + i, "https://best-casino.example.org/") for i in range(2)], "page_id long, url string")
    marks = spark.createDataFrame([(i, 0, None) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(junk, marks).collect()}
    assert got[0] == ("block", ["word:casino"]) or "word:casino" in got[0][1]
    assert got[100][0] == "allow" and got[200][0] == "block"


def test_rules_are_mined_pruned_and_matched(spark):
    rows = [(["host:bad", "path:a", f"x:{i}"], True) for i in range(40)] + [(["host:good", "path:a", f"x:{i}"], False) for i in range(200)] + [(["host:mixed", "path:pill"], True)] * 30 + [(["host:mixed"], False)] * 60
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert {r.rule for r in found} == {"host:bad", "path:pill"} and all(r.confidence == 1.0 for r in found)
    both = [(["a", "b"], True)] * 30 + [(["a"], False)] * 30 + [(["b"], False)] * 30 + [(["a", "b", "c"], True)] * 30
    assert {r.rule for r in urls.mine(spark.createDataFrame(both, "tokens array<string>, blocked boolean")).collect()} == {"a b", "c"}
    rules = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z", "y"])], "rule string, tokens array<string>")
    hits = urls.match(spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, []), (4, ["y", "z", "x"])], "row long, tokens array<string>"), "row", rules)
    assert {(r.row, r.rule) for r in hits.collect()} == {(1, "a"), (1, "b"), (4, "a"), (4, "b"), (4, "c")}


# --- the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.materialize(stage(spark, seen, SF), name)
        assert out.columns == columns and 0 < out.count()
        if name == "near_dedup":
            assert {r.doc_id for r in out.collect()} == set(plain_copies(seen).values())
        if name == "pii":
            assert out.filter(F.col("text").rlike("@[a-z0-9]+[.]example")).count() == 0 and out.count() == seen.count()
            assert out.filter("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert out.groupBy("doc_id").count().filter("count > 2").count() == 0
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    with open(catalogue.vocabulary(), "rb") as f:
        coder = bpe.Encoder(f.read())
    text = {r.doc_id: r.text for r in seen.collect()}
    assert len(last) == seen.count() and all(list(r.ids) == coder.encode(text[r.doc_id]).tolist() for r in last)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_pipeline_takes_odd_documents(spark, odd, clashing, none):
    """Null, empty, long, repeated and id-less documents, and clashing names, stage by stage."""
    text = {1: "the quick", 2: "the quick", 6: "der schnelle", 7: "x" * 5000, None: "a text", 8: "😀 日本語"}
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    want = lambda *xs: sorted((x is None, x or 0) for x in xs)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, clashing):
        stages = dict(corpus_pipeline.STAGES)
        first = scratch.materialize(stages["language_id"](spark, docs, SF), "odd")
        # null and blank texts have no letters; 8 is mixed, but most of its letters are Latin
        assert first.columns == docs.columns and ids(first) == want(1, 2, 2, 6, None, 7, 8)
        assert all((r.text or "").startswith(text[r.doc_id]) for r in first.collect())
        # 2 copies 1, of those without words the least id stays, of which rows without an id aren't
        second = stages["near_dedup"](spark, docs, SF)
        assert second.columns == docs.columns and ids(second) == want(1, 3, 6, None, 7, 8)
        third = stages["pii"](spark, docs, SF)
        assert third.columns == docs.columns and ids(third) == ids(docs)
        assert sorted(map(repr, third.drop("n_chars").collect())) == sorted(map(repr, docs.drop("n_chars").collect()))
        assert {(r.n_chars is None) for r in third.filter("text is null").collect()} == {True}
        fourth = stages["mixing"](spark, docs, SF)
        assert fourth.columns == docs.columns and set(ids(fourth)) <= set(ids(docs))
        times = collections.Counter(ids(fourth))
        assert all(n <= 2 * ids(docs).count(i) for i, n in times.items()) and times[(False, 2)] % 2 == 0
        last = stages["bpe"](spark, docs, SF)
        assert ids(last) == ids(docs) and {r.n_tokens for r in last.filter("doc_id in (3, 4, 5)").collect()} == {0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), SF).count() == 0
    assert none.count() == 0


def test_sql(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    for name, sql in catalogue.ORACLES.items():
        df = catalogue.QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(map(repr, map(list, cursor.fetchall())))


def test_scratch_tables_are_written_once_and_cleared(spark):
    import os

    made = scratch.materialize(spark.range(5).select(F.col("id"), F.rand().alias("r")), "numbers")
    assert sorted(made.collect()) == sorted(made.collect())
    folder = scratch._WRITTEN[-1]
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(folder.removeprefix("file://"))
    scratch.clear(spark)
    assert not os.path.isdir(folder.removeprefix("file://")) and scratch._WRITTEN == []


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Elsewhere)


def test_scope_deletes_what_was_written_within(spark):
    import os

    with scratch.scope(spark) as keep:
        inner = scratch.materialize(spark.range(3), "inner")
        path = scratch._WRITTEN[-1]
        outer = keep(inner.selectExpr("id + 1 as id"), "outer")
    assert not os.path.isdir(path.removeprefix("file://")) and sorted(r.id for r in outer.collect()) == [1, 2, 3]
