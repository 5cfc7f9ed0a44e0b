"""DuckDB SQL of the queries that SQL can express."""

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    f"list_filter(string_split_regex(coalesce({_FOLD}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),"
    " lambda x: x <> '')"
)

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
            LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS s)),
dg AS (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM iw), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS s)),
m AS (SELECT DISTINCT rid, s, k, item FROM dg JOIN iw USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit
      FROM (SELECT rid, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""

_STEP = "(key * 2862933555777941757 + 1) % 18446744073709551616"

OP4 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT) AS key
  FROM documents),
hop AS (
  SELECT rid, n, key, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS target FROM d, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT rid, n, {_STEP}, target,
         CAST(floor((target + 1) * (2147483648::DOUBLE / (CAST(({_STEP}) // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
  FROM hop WHERE target < n),
ended AS (SELECT rid, n, shard FROM hop WHERE target >= n),
tbl AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
crcs AS (
  SELECT rid, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2),
              lambda i: CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT))),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT rid, hex(encode(text)) AS hx FROM d), tbl),
placed AS (
  SELECT d.rid, doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size, text,
         CAST(a.shard AS INTEGER) AS shard, CAST(b.shard AS INTEGER) AS grown_shard
  FROM d JOIN ended a ON a.rid = d.rid AND a.n = 40 JOIN ended b ON b.rid = d.rid AND b.n = 41)
SELECT doc_id, size, c.crc AS text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, c.crc NULLS FIRST, size) - 1 AS slot
FROM placed JOIN crcs c USING (rid)
"""

_SIZE = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"
_RAND = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_BEFORE = "((({}) * more + start) // blocks)"
_CHOSEN = f"({_BEFORE.format('{0} + 1')} - {_BEFORE.format('{0}')})"

OP6 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size,
         {_RAND.format("'6|' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS rand FROM documents),
found AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (count(*) + 4999) // 5000 AS shards,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((i - 1) % 3 + 1 AS DOUBLE) AS w, sum(n) OVER () AS total FROM found),
filled AS (
  SELECT *, coalesce(sum(3 * n) OVER before, 0) AS capped, sum(w) OVER after AS free,
         w * (total - coalesce(sum(3 * n) OVER before, 0)) / sum(w) OVER after > 3 * n AS at_most
  FROM weighed
  WINDOW before AS (ORDER BY n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
unit AS (SELECT max((total - capped) / free) AS u FROM filled WHERE NOT at_most),
aimed AS (
  SELECT source, i, n, shards, CASE WHEN at_most THEN 3.0 * n ELSE w * u END AS target FROM filled, unit),
seats AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i) AS place
  FROM aimed, LATERAL (SELECT unnest(range(3 * ((n + 31) // 32))) AS k)),
given AS (
  SELECT source, count(*) AS seats FROM seats
  WHERE place <= (SELECT round_even(sum(target) / 32, 0) FROM aimed) GROUP BY source),
placed AS (
  SELECT s.*, a.n AS source_size, a.target, coalesce(g.seats, 0) AS seats, s.rand % a.shards AS shard
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
  LEFT JOIN given g ON g.source IS NOT DISTINCT FROM s.source),
parts AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS n, max(seats) AS seats FROM placed GROUP BY source, shard),
dealt AS (
  SELECT source, shard, seats,
         row_number() OVER (PARTITION BY source ORDER BY n / (2 * k + 1) DESC, shard) AS place
  FROM parts, LATERAL (SELECT unnest(range(3 * ((n + 31) // 32))) AS k)),
quotas AS (
  SELECT p.source, p.shard, greatest(1, (p.n + 31) // 32) AS blocks,
         (SELECT count(*) FROM dealt d WHERE d.source IS NOT DISTINCT FROM p.source
            AND d.shard = p.shard AND d.place <= d.seats) AS quota,
         {_RAND.format("'6|' || coalesce(p.source, '') || '|' || CAST(p.shard AS VARCHAR)")} AS draw
  FROM parts p),
plan AS (
  SELECT *, quota // blocks AS whole, quota % blocks AS more, draw % blocks AS start FROM quotas),
laid AS (
  SELECT p.*, CAST(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY rand, doc_id NULLS FIRST, size
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM placed p),
cut AS (
  SELECT l.*, q.blocks, q.whole, q.more, q.start, upto - size AS since, (upto - size) // 32 AS b0, (upto - 1) // 32 AS b1
  FROM laid l JOIN plan q ON l.source IS NOT DISTINCT FROM q.source AND l.shard = q.shard)
SELECT doc_id, size, source_size, target, source, shard AS mix_shard,
       CAST(whole * size + CASE WHEN size = 0 THEN 0 WHEN b0 = b1 THEN {_CHOSEN.format('b0')} * size
            ELSE {_CHOSEN.format('b0')} * ((b0 + 1) * 32 - since) + {_CHOSEN.format('b1')} * (upto - b1 * 32)
                 + ({_BEFORE.format('b1')} - {_BEFORE.format('b0 + 1')}) * 32 END AS BIGINT) AS taken
FROM cut
"""

_ESCAPED = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"
_SAID = "'<|im_end|><|im_start|>assistant ok'"

OP9 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens,
         lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format('text')})
                + CASE WHEN opens THEN 22 + length({_ESCAPED.format('role')}) ELSE 11 END
                + CASE WHEN closes THEN 11 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

OP8 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
g AS (SELECT rid, doc_id, s, array_to_string(w[s:s + 12], ' ') AS seq
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS s)),
f AS (SELECT seq, min(doc_id) AS first FROM g GROUP BY seq),
c AS (SELECT DISTINCT rid, unnest(generate_series(s, s + 12)) AS p FROM g JOIN f USING (seq) WHERE f.first < g.doc_id),
k AS (
  SELECT x.rid, string_agg(word, ' ' ORDER BY x.p) AS kept
  FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x
  LEFT JOIN c ON c.rid = x.rid AND c.p = x.p WHERE c.p IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM c GROUP BY rid) USING (rid)
"""

_CRCS = """tbl AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""
_NEXT = {1: 3, 2: 3, 3: 4, 4: 3}  # the state (counted from 1) after the only role that may follow
_KEEP = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}


def _edit(cost: str, letter: str, lines: str, ahead: str) -> str:
    return f"{{'c': {ahead}.c + {cost}, 'a': '{letter}' || {ahead}.a, 't': list_concat({lines}, {ahead}.t)}}"


def _needed(state: int) -> str:
    return "assistant" if state == 3 else "user"


def _base(state: int) -> str:
    put = f"['{_needed(state)}:' || text]"
    keep = " ".join(
        f"WHEN initial = '{i}' AND fault IN (0, 3) THEN {_edit('cut', 'K', "[role || ':' || text]", f'v[{to}]')}"
        for i, to in _KEEP[state].items()
    )
    edits = [
        _edit("3", "D", "CAST([] AS VARCHAR[])", f"v[{state}]"),
        f"CASE WHEN fault IN (0, 3) THEN {_edit('2 + cut', 'R', put, f'v[{_NEXT[state]}]')} END",
        f"CASE {keep} END",
    ]
    return f"list_sort(list_filter([{', '.join(edits)}], lambda x: x IS NOT NULL))[1]"


def _put(state: int) -> str:
    near, far = _NEXT[state], _NEXT[_NEXT[state]]
    one = _edit("2", "I", f"['{_needed(state)}:']", f"b[{near}]")
    two = _edit("4", "II", f"['{_needed(state)}:', '{_needed(near)}:']", f"b[{far}]")
    return f"list_sort([b[{state}], {one}, {two}])[1]"


_VECTOR = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])[]"

OP11 = f"""
WITH RECURSIVE {_CRCS},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS hx
      FROM conversations),
lots AS (
  SELECT k.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2),
              lambda i: CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT))),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS lot
  FROM k, tbl),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS again
      FROM lots WHERE lot <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos FROM d),
e AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM p),
g AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
             lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS following,
             CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
      FROM e),
told AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 3) AS truncated,
                count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
         FROM g GROUP BY conv_id),
go AS (
  SELECT conv_id, n + 1 AS pos, CAST([{{'c': 0, 'a': '', 't': []}}, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}},
         {{'c': 2, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []}}] AS {_VECTOR}) AS v FROM told
  UNION ALL
  SELECT conv_id, pos, CAST([{", ".join(_put(s) for s in _NEXT)}] AS {_VECTOR})
  FROM (SELECT conv_id, pos, [{", ".join(_base(s) for s in _NEXT)}] AS b
        FROM (SELECT g.*, go.v, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cut
              FROM go JOIN g ON g.conv_id IS NOT DISTINCT FROM go.conv_id AND g.pos = go.pos - 1)))
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0) AS cost,
       coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN go ON go.conv_id IS NOT DISTINCT FROM a.conv_id AND go.pos = 1
"""

OP12 = f"""
WITH pieces AS (
  SELECT lang, piece, row_number() OVER () AS pid
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(coalesce({_FOLD}, ''), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
w AS (SELECT pid, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
tokens AS (SELECT pid, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
runs AS (
  SELECT lang, x, lead(x, 1) OVER p AS x2, lead(x, 2) OVER p AS x3, lead(x, 3) OVER p AS x4
  FROM tokens WINDOW p AS (PARTITION BY pid ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, x AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || x2 AS phrase, count(*) FROM runs WHERE x2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || x2 || ' ' || x3 AS phrase, count(*) FROM runs WHERE x3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 AS phrase, count(*) FROM runs WHERE x4 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM grams WHERE f >= 30),
cand AS MATERIALIZED (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k >= 2),
inner_ AS MATERIALIZED (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS longest
  FROM cand, (SELECT unnest([2, 3]) AS k), LATERAL (SELECT unnest(range(1, size - k + 2)) AS s)
  WHERE k < size GROUP BY ALL),
alone AS MATERIALIZED (SELECT c.* FROM cand c LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longest IS NULL OR 100 * i.longest < 80 * a),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, k, size, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
  FROM alone, LATERAL (SELECT unnest(range(1, size)) AS k)),
headed AS MATERIALIZED (
  SELECT c.*, h.f AS l FROM cuts c JOIN often h ON h.lang = c.lang AND h.phrase = c.head AND h.k = c.k),
scored AS (
  SELECT c.lang, c.phrase, a, c.k, l, t.f AS r, CAST(2000000::HUGEINT * a // (l + t.f) AS BIGINT) AS score
  FROM headed c JOIN often t ON t.lang = c.lang AND t.phrase = c.tail AND t.k = c.size - c.k),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP13 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS rid, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY a),
counted AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (rid) LEFT JOIN counted USING (rid)
"""

ORACLE: dict[str, str] = {
    "op2_decontaminate": OP2, "op4_shard": OP4, "op6_mix": OP6, "op8_repeats": OP8, "op9_chat": OP9,
    "op11_repair": OP11, "op12_phrases": OP12, "op13_collisions": OP13,
}
