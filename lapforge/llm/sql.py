"""DuckDB SQL for what needs 64-bit arithmetic: XXH64, CRC-32, Feistel networks.

Products of 64-bit numbers are taken as UHUGEINT, which holds all 128 bits, and then
modulo 2^64. Bytes are handled as hexadecimal text. The statements follow the published
definitions, not the code of the operators, so that each is a check of the other.
"""

from __future__ import annotations

#: The primes of XXH64, by number.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Multipliers of the 64-bit finalizer, and the step between round keys.
MIX, STEP = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 0x9E3779B97F4A7C15

WORD = r"[^\x20\x09-\x0D]+"
_ALL = "18446744073709551616::UHUGEINT"
_P = [None, *(f"{p}::UHUGEINT" for p in PRIMES)]


def _low(x: str) -> str:
    return f"(({x}) % {_ALL})"


def _turn(x: str, by: int) -> str:
    """Rotation to the left; ``x`` is written twice, so pass names or short terms."""
    return f"((({x}) * {1 << by}::UHUGEINT) % {_ALL} + (({x}) >> {64 - by}))"


def reversed_hex(text: str) -> str:
    """The UTF-8 bytes of a text, last byte first, as hexadecimal digits."""
    return f"reverse(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'))"


def xxh64(source: str, key: str, name: str) -> str:
    """CTEs, the last called ``name`` with (key, hash), of XXH64 for the rows of ``source``.

    source: key, rv (bytes as ``reversed_hex`` gives them), seed (UHUGEINT).
    """
    number = lambda start, digits: f"CAST(CAST('0x' || substr(rv, {start}, {digits}) AS UBIGINT) AS UHUGEINT)"
    lane = number("2 * n - 16 * i - 15", 16)
    stripe = lambda j, start: f"list_reduce([{start}] || list_filter(lanes, lambda x, i: i <= stripes * 4 AND (i - 1) % 4 = {j}), lambda v, x: {_low(_turn(_low(f'v + x * {_P[2]} % {_ALL}'), 31) + ' * ' + _P[1])})"
    merged = "h0"
    steps = []
    for j in range(1, 5):
        steps.append(f"{_low(f'v{j} * {_P[2]}')} AS m{j}, {_low(f'xor({merged}, {_low(_turn(f'm{j}', 31) + ' * ' + _P[1])}) * {_P[1]} + {_P[4]}')} AS h{j}")
        merged = f"h{j}"
    return f"""
{name}_1 AS (SELECT {key}, rv, CAST(seed AS UHUGEINT) AS seed, CAST(length(rv) // 2 AS BIGINT) AS n, CAST(length(rv) // 64 AS BIGINT) AS stripes FROM {source}),
{name}_2 AS (SELECT *, list_transform(range(0, n // 8), lambda i: {lane}) AS lanes FROM {name}_1),
{name}_3 AS (SELECT *, {stripe(0, _low(f'seed + {_P[1]} + {_P[2]}'))} AS v1, {stripe(1, _low(f'seed + {_P[2]}'))} AS v2,
  {stripe(2, 'seed')} AS v3, {stripe(3, _low(f'seed + {_ALL} - {_P[1]}'))} AS v4 FROM {name}_2),
{name}_4 AS (SELECT *, {_low(' + '.join(_turn(f'v{j}', r) for j, r in ((1, 1), (2, 7), (3, 12), (4, 18))))} AS h0, {', '.join(steps)} FROM {name}_3),
{name}_5 AS (SELECT {key}, rv, n, {_low(f'CASE WHEN n >= 32 THEN h4 ELSE seed + {_P[5]} END + CAST(n AS UHUGEINT)')} AS h,
  list_transform(list_transform(lanes[CAST(stripes * 4 + 1 AS BIGINT):], lambda x: {_low(f'x * {_P[2]}')}), lambda x: {_low(_turn('x', 31) + ' * ' + _P[1])}) AS rest FROM {name}_4),
{name}_6 AS (SELECT {key}, rv, n, list_reduce([h] || rest, lambda v, x: {_low(_turn('xor(v, x)', 27) + f' * {_P[1]} + {_P[4]}')}) AS h FROM {name}_5),
{name}_7 AS (SELECT {key}, rv, n, CASE WHEN n % 8 >= 4 THEN xor(h, {_low(number('2 * (n % 8) - 7', 8) + ' * ' + _P[1])}) END AS w, h FROM {name}_6),
{name}_8 AS (SELECT {key}, CASE WHEN w IS NULL THEN h ELSE {_low(_turn('w', 23) + f' * {_P[2]} + {_P[3]}')} END AS h,
  list_transform(range(1, n % 4 + 1), lambda i: {_low(number('2 * (n % 4) - 2 * i + 1', 2) + ' * ' + _P[5])}) AS rest FROM {name}_7),
{name}_9 AS (SELECT {key}, list_reduce([h] || rest, lambda v, x: {_low(_turn('xor(v, x)', 11) + ' * ' + _P[1])}) AS h FROM {name}_8),
{name} AS (SELECT {key}, {_low(f'xor(h, h >> 33) * {_P[2]}')} AS a1, {_low(f'xor(a1, a1 >> 29) * {_P[3]}')} AS a2, xor(a2, a2 >> 32) AS hash FROM {name}_9)"""


def simhash(words: int = 4, distance: int = 4, seed: int = 42) -> str:
    """Fingerprints of all shingles, every pair of distinct ones compared, components by closure."""
    bits = ", ".join(f"count(*) FILTER (WHERE (hash >> {i}) & 1 = 1) * 2 > count(*) AS b{i}" for i in range(64))
    joined = " + ".join(f"CASE WHEN b{i} THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - {words - 1}, 1)), lambda i: array_to_string(w[i + 1:i + {words}], ' '))) AS shingle FROM d WHERE len(w) > 0),
u AS (SELECT shingle, {reversed_hex('shingle')} AS rv, {seed} AS seed FROM (SELECT DISTINCT shingle FROM s)),
{xxh64('u', 'shingle', 'x')},
c AS (SELECT doc_id, {bits} FROM s JOIN x USING (shingle) GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(coalesce({joined}, 0) AS UBIGINT) AS mark FROM d LEFT JOIN c USING (doc_id)),
m AS (SELECT mark, min(doc_id) AS least FROM f GROUP BY mark),
l AS (SELECT a.mark AS u, b.mark AS v FROM m a JOIN m b ON a.mark <> b.mark AND bit_count(xor(a.mark, b.mark)) <= {distance}),
r AS (SELECT mark, least FROM m UNION SELECT l.v AS mark, r.least FROM r JOIN l ON r.mark = l.u)
SELECT f.doc_id, lpad(lower(to_hex(f.mark)), 16, '0') AS fingerprint, z.component_id
FROM f JOIN (SELECT mark, min(least) AS component_id FROM r GROUP BY mark) z USING (mark)
"""


def _crc_steps() -> list[int]:
    """What four bits that leave the register put back into it, for each of their 16 values."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)
        steps.append(x)
    return steps


def _mix(x: int) -> int:
    """The finalizer on a plain integer."""
    for shift, factor in ((30, MIX[0]), (27, MIX[1])):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    return x ^ (x >> 31)


def sharding(n_shards: int = 16, seed: int = 20, rounds: int = 6) -> str:
    """Rows numbered by doc_id, numbers permuted by the Feistel network until below N."""
    keys = [_mix((i * STEP + seed) % (1 << 64)) for i in range(1, rounds + 1)]
    # nested, since DuckDB copies a column's expression wherever its alias is used beside it
    walk = "SELECT *, p >> half AS l0, p & mask AS r0 FROM w WHERE pass = 0 OR p >= total"
    for i, key in enumerate(keys):
        for step in (f"{_low(f'r{i} + {key}::UHUGEINT')} AS k{i}", f"{_low(f'xor(k{i}, k{i} >> 30) * {MIX[0]}::UHUGEINT')} AS y{i}", f"{_low(f'xor(y{i}, y{i} >> 27) * {MIX[1]}::UHUGEINT')} AS z{i}", f"r{i} AS l{i + 1}, xor(l{i}, xor(z{i}, z{i} >> 31) & mask) AS r{i + 1}"):
            walk = f"SELECT *, {step} FROM ({walk})"
    # a text's digits with the lower half of each byte first
    digits = "string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), '')"
    crc = f"list_reduce([4294967295::UBIGINT] || list_transform({digits}, lambda x: CAST(CAST('0x' || x AS UTINYINT) AS UBIGINT)), lambda c, x: xor(c >> 4, (CAST({_crc_steps()} AS UBIGINT[]))[CAST((xor(c, x) & 15) + 1 AS BIGINT)]))"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, CASE WHEN t = '' THEN 0 ELSE CAST(xor({crc}, 4294967295::UBIGINT) AS BIGINT) END AS text_crc32 FROM t),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS UHUGEINT) AS row_no, CAST(count(*) OVER () AS UHUGEINT) AS total FROM s),
h AS (SELECT *, CAST(greatest(1, (length(bin(CAST(greatest(total, 2) - 1 AS UBIGINT))) + 1) // 2) AS INT) AS bits FROM o),
w AS (SELECT row_no, row_no AS p, total, CAST(bits AS UHUGEINT) AS half, CAST(pow(2, bits) AS UHUGEINT) - 1::UHUGEINT AS mask, 0 AS pass FROM h
  UNION ALL SELECT row_no, l{rounds} + r{rounds} * (mask + 1::UHUGEINT) AS p, total, half, mask, 1 AS pass FROM ({walk})),
e AS (SELECT row_no, p FROM w WHERE pass = 1 AND p < total)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {n_shards} AS INT) AS shard, CAST(p // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM h JOIN e USING (row_no)
"""


def mixing(seed: int = 20, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> str:
    """Documents of one source each, by which the flow falls apart into one for each source.

    A source's words are taken ``times`` whole, and the rest of its quota from the
    documents of least hash, to the nearest document.
    """
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(hex(encode(source)), '~') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
a AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, {list(weights)}[CAST((row_number() OVER (ORDER BY k) - 1) % {len(weights)} + 1 AS BIGINT)] AS weight FROM d GROUP BY k),
-- quotas: rounds of sharing what is left; a source above its bound gets the bound and leaves
g AS (SELECT 0 AS round, CAST({share} * sum(source_size) AS DOUBLE) AS rest, list({{'k': k, 'w': weight, 's': source_size, 'q': CAST(NULL AS DOUBLE)}} ORDER BY k) AS items FROM a
  UNION ALL
  SELECT round + 1, rest - coalesce(list_sum(list_transform(list_filter(items, lambda x: x.q IS NULL AND unit * x.w > {most} * x.s), lambda x: CAST({most} * x.s AS DOUBLE))), CASE WHEN tight THEN 0 ELSE rest END),
    list_transform(items, lambda x: {{'k': x.k, 'w': x.w, 's': x.s, 'q': CASE WHEN x.q IS NOT NULL THEN x.q WHEN NOT tight THEN unit * x.w WHEN unit * x.w > {most} * x.s THEN CAST({most} * x.s AS DOUBLE) END}})
  FROM (SELECT *, len(list_filter(items, lambda x: x.q IS NULL AND unit * x.w > {most} * x.s)) > 0 AS tight FROM (
    SELECT *, rest / list_sum(list_transform(list_filter(items, lambda x: x.q IS NULL), lambda x: x.w)) AS unit FROM g WHERE rest > 0 AND len(list_filter(items, lambda x: x.q IS NULL)) > 0))),
t AS (SELECT i.k AS k, i.s AS source_size, coalesce(i.q, 0) AS target FROM (SELECT unnest(items) AS i FROM (SELECT items FROM g ORDER BY round DESC LIMIT 1))),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(2, floor(target / source_size)) AS BIGINT) ELSE 0 END AS times FROM t),
-- the seeded hash: XXH64 of the seed, the id and the text, each seeded by the one before
s0 AS (SELECT 0 AS one, '{seed:08X}' AS rv, 42 AS seed),
{xxh64('s0', 'one', 'x0')},
s1 AS (SELECT rid, lpad(to_hex(doc_id), 16, '0') AS rv, x0.hash AS seed FROM d CROSS JOIN x0),
{xxh64('s1', 'rid', 'x1')},
s2 AS (SELECT rid, {reversed_hex('text')} AS rv, x1.hash AS seed FROM d JOIN x1 USING (rid) WHERE text IS NOT NULL),
{xxh64('s2', 'rid', 'x2')},
o AS (SELECT d.*, sum(size) OVER (PARTITION BY k ORDER BY coalesce(x2.hash, x1.hash)) AS upto FROM d JOIN x1 USING (rid) LEFT JOIN x2 USING (rid))
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN upto - size / 2 <= target - times * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o JOIN n USING (k)
"""


def urls(rules: tuple[tuple[str, str], ...], names: list[str], support: float, least: int, confidence: float) -> str:
    """Verdicts by listed rules, and by rules found among all sets of tokens of all judged pages.

    No frequent-pattern mining: every subset of every judged page's tokens is counted.
    """
    fits = []
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True):
        domain, slash, rest = text.partition("/")
        fits.append((f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}')", text, says))
    which = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    listed = ", ".join(f"'{n}'" for n in names)
    return rf"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT rid, page_id, host, path, {which(1)} AS rule, {which(2)} AS says,
  list_filter(string_split(host, '.'), lambda x: x <> '') AS parts, list_transform(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]) AS names FROM h),
w AS (SELECT *, regexp_split_to_array(array_to_string(parts[1:greatest(len(parts) - 1, 0)], '/') || '/' || lower(path), '[^\p{{L}}]+') AS words FROM j),
t AS (SELECT rid, page_id, host, path, rule, says, list_sort(list_distinct(list_transform(list_filter(words, lambda x: length(x) > 2 AND x NOT IN ({listed})), lambda x: 'word:' || x)
  || list_transform(list_filter(names, lambda x: x <> ''), lambda x: 'param:' || x))) AS tokens FROM w),
s AS (SELECT rid, says = 'block' AS blocked, tokens, i AS last, [tokens[i]] AS held FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM t WHERE says IS NOT NULL)
  UNION ALL SELECT rid, blocked, tokens, i AS last, held || [tokens[i]] AS held FROM (SELECT *, unnest(range(last + 1, len(tokens) + 1)) AS i FROM s)),
c AS (SELECT held, count(*) FILTER (WHERE blocked) AS n, count(*) AS total FROM s GROUP BY held),
r AS (SELECT held FROM c WHERE n >= (SELECT greatest({least}, ceil({support} * count(*)), 1) FROM t WHERE says IS NOT NULL) AND n / total >= {confidence}),
m AS (SELECT held, array_to_string(held, ' ') AS mined FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE len(o.held) < len(r.held) AND list_has_all(r.held, o.held))),
f AS (SELECT rid, string_agg(mined, ' | ' ORDER BY mined) AS mined FROM t JOIN m ON says IS NULL AND list_has_all(tokens, held) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN mined IS NULL THEN 'allow' ELSE 'block' END) AS verdict, coalesce(mined, '') AS mined
FROM t LEFT JOIN f USING (rid)
"""
