"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

OP7 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS component_id FROM s
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, range(0, CAST(length(h) / 2 AS BIGINT) - 49) AS places FROM d WHERE length(h) >= 100),
x AS (SELECT doc_id, unnest(places) AS i, unnest(list_transform(places, lambda i: substr(h, 2 * i + 1, 100))) AS v FROM n),
f AS (SELECT v, min(doc_id) AS first FROM x GROUP BY v HAVING min(doc_id) < max(doc_id)),
y AS (SELECT doc_id, i, first FROM x JOIN f ON x.v = f.v),
z AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM y WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM z),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
k AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS begin, a AS until FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(CAST(length(h) / 2 AS BIGINT)) FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
), t AS (SELECT k.doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (until - begin)), '' ORDER BY begin) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(kept)) / 2 AS BIGINT) AS n_removed,
  (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON t.doc_id = d.doc_id
"""

OP9 = """
WITH table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, CAST(length(h) / 2 AS BIGINT) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, table_),
k AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
c AS (SELECT doc_id, key, g, j, 'r' AS kind, g AS node FROM k, range(3) AS r(g), range(64) AS t(j) WHERE j = 0 OR g = 2
  UNION ALL SELECT doc_id, key, g, j, 'k', 4 * g + x FROM k, range(3) AS r(g), range(64) AS t(j), range(4) AS n(x) WHERE j = 0 OR g = 2
  UNION ALL SELECT doc_id, key, g, j, 's', 16 * g + x FROM k, range(3) AS r(g), range(64) AS t(j), range(16) AS n(x) WHERE j = 0 OR g = 2),
w AS (SELECT doc_id, key, g, j, kind, node, -ln((CAST('0x' || substr(md5(kind || node || ':' || j || ':' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) AS draw FROM c),
a AS (SELECT doc_id, key, g, j, any_value(draw) FILTER (WHERE kind = 'r') AS draw, arg_min(node, draw) FILTER (WHERE kind = 'k') AS rack FROM w GROUP BY doc_id, key, g, j),
b AS (SELECT a.doc_id, a.key, a.g, a.j, any_value(a.draw) AS draw, arg_min(w.node, w.draw) AS shard FROM a JOIN w ON w.doc_id IS NOT DISTINCT FROM a.doc_id AND w.g = a.g AND w.j = a.j AND w.kind = 's' AND w.node // 4 = a.rack GROUP BY a.doc_id, a.key, a.g, a.j),
v AS (SELECT doc_id, key, g, j, shard, sum(draw) OVER (PARTITION BY doc_id, g ORDER BY j) / 16 AS came FROM b),
p AS (SELECT doc_id, CAST(arg_min(shard, came) FILTER (WHERE shard < 40) AS INTEGER) AS shard, CAST(arg_min(shard, came) FILTER (WHERE shard < 41) AS INTEGER) AS grown_shard, any_value(substr(md5('slot:' || key), 1, 2)) AS bucket FROM v GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, d.doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM d JOIN p ON p.doc_id IS NOT DISTINCT FROM d.doc_id
"""

BASE5 = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {'p': i, 'g': array_to_string(w[i:i + 4], ' ')}), recursive := true) FROM w WHERE len(w) >= 5),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, range(5) AS z(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w)
SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

_KINDS = {
    "assign": (1, "(?i:password|passwd|secret|token|api_?key)[\\x22\\x27]?\\x20*[:=]\\x20*[\\x22\\x27]?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (2, "AKIA[A-Z0-9]+", 0, 20),
    "hex": (3, "[0-9a-f]+", 0, 24),
}
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'x': length(x[i])}}), recursive := true), {order} AS o, '{kind}' AS kind, {least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS x, regexp_split_to_array(t, '{pattern}') AS g FROM t WHERE regexp_matches(t, '{pattern}'))"""
    for kind, (order, pattern, group, least) in _KINDS.items()
)
BASE6 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_SPANS}), k AS (SELECT doc_id, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b, o, kind FROM s WHERE x >= least)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o), '')) AS base_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id GROUP BY t.doc_id
"""

_TOLD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_leaf = lambda chars: "sha256(" + " || ".join(_TOLD.format(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"
OP11 = f"""
WITH RECURSIVE table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS touched FROM documents, table_),
e AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + CAST(touched AS BIGINT))")} AS tampered FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM e),
r AS (SELECT lang, 0 AS v, i, leaf AS h, n FROM l UNION ALL SELECT lang, v + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM r WHERE n > 1 GROUP BY lang, v, i // 2),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM r WHERE n = 1),
q AS (SELECT 0 AS v, j, subroot AS h, m FROM s UNION ALL SELECT v + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), any_value(m + 1) // 2 FROM q WHERE m > 1 GROUP BY v, j // 2),
f AS (
  SELECT lang, i, 0 AS v, i AS at, tampered AS h, '' AS proof, n FROM l
  UNION ALL
  SELECT f.lang, f.i, f.v + 1, f.at // 2, sha256(CASE WHEN f.at % 2 = 0 THEN f.h || coalesce(r.h, '') ELSE r.h || f.h END), f.proof || coalesce(r.h, ''), (f.n + 1) // 2
  FROM f LEFT JOIN r ON r.lang IS NOT DISTINCT FROM f.lang AND r.v = f.v AND r.i = xor(f.at, 1) WHERE f.n > 1
),
g AS (
  SELECT f.lang, f.i, 0 AS v, s.j AS at, f.h, f.proof, s.m FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT g.lang, g.i, g.v + 1, g.at // 2, sha256(CASE WHEN g.at % 2 = 0 THEN g.h || coalesce(q.h, '') ELSE q.h || g.h END), g.proof || coalesce(q.h, ''), (g.m + 1) // 2
  FROM g LEFT JOIN q ON q.v = g.v AND q.j = xor(g.at, 1) WHERE g.m > 1
)
SELECT l.doc_id, l.leaf, s.subroot, q.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = q.h AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN g ON g.lang IS NOT DISTINCT FROM l.lang AND g.i = l.i AND g.m = 1 JOIN q ON q.m = 1
"""

OP12 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
y AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, i) > 1),
z AS (SELECT DISTINCT doc_id, i + k AS p FROM y, range(20) AS r(k)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN z USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

#: The cheapest of some ways (cost c, audit t), the least audit of equals.
_LEAST = "list_sort(list_filter([{}], lambda w: w.c IS NOT NULL))[1]"
_WAY = "{{'c': CASE WHEN {when} THEN {state}.c + {price} END, 't': {state}.t || '{audit}'}}"


def _retained(role: str, pairs: dict[str, int]) -> str:
    ways = [_WAY.format(when="true", state=role, price=3, audit="D")]
    for op, price, when in (("K", 0, f"f.x = '{role}' AND f.fault NOT IN ('b', 'd')"), ("R", 2, "f.fault NOT IN ('b', 'd')")):
        if not (op == "R" and role == "s"):
            ways += [_WAY.format(when=when, state=state, price=f"{price + 2 * n} + CAST(f.fault = 't' AS BIGINT)", audit="I" * n + op) for state, n in pairs.items()]
    return _LEAST.format(", ".join(ways))


_PAIRS = {"s": {"e": 0}, "u": {"e": 0, "s": 0, "a": 0, "u": 1}, "a": {"u": 0, "e": 1, "s": 1, "a": 1}}
OP13 = f"""
WITH RECURSIVE table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM h, table_),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) FROM k WHERE k > 0),
p AS (SELECT conv_id, turn, role, text, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, x IS NOT NULL AND lag(x) OVER w || x NOT IN ('su', 'ua', 'au') AS bad, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM f GROUP BY conv_id),
r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 't': ''}} AS e, CAST(NULL AS STRUCT(c BIGINT, t VARCHAR)) AS s, CAST(NULL AS STRUCT(c BIGINT, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, t VARCHAR)) AS a FROM g
  UNION ALL
  SELECT r.conv_id, f.i, {{'c': e.c + 3, 't': e.t || 'D'}}, {", ".join(_retained(role, pairs) for role, pairs in _PAIRS.items())} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1
),
b AS (SELECT g.*, {_LEAST.format("r.e, {'c': s.c + 4, 't': s.t || 'II'}, {'c': u.c + 2, 't': u.t || 'I'}, r.a")} AS best FROM g JOIN r ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.n = r.i),
o AS (SELECT conv_id, unnest(range(1, length(best.t) + 1)) AS j, best.t AS t FROM b),
y AS (SELECT o.conv_id, j, substr(t, j, 1) AS op, f.role, f.x, f.text FROM o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND substr(t, j, 1) <> 'I' AND f.i = length(replace(substr(t, 1, j), 'I', ''))),
z AS (SELECT conv_id, j, CASE WHEN op = 'K' THEN role WHEN (row_number() OVER w - first_value(CAST(op = 'K' AND x = 's' AS INTEGER)) OVER w) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM y WHERE op <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
l AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS whole FROM z GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.t, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op3_histogram_top_k": OP3, "op7_multi_order_jaccard": OP7, "op8_prefix_free_dedup": OP8, "op9_hash_tree_shards": OP9, "op11_merkle_manifest": OP11, "op12_recompression_dedup": OP12, "op13_subsequence_repair": OP13, "base_of_op5": BASE5, "base_of_op6": BASE6}
