"""SQL of the corpus queries that SQL can express, by brute force over all rows, for tables small enough for that."""

_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE h IN (SELECT h FROM twice))),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

LATTICE_NEAR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(d.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM comp c LEFT JOIN deg d ON d.vec_id = c.vec_id"""

MINHASH_NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM comp c LEFT JOIN n ON n.doc_id = c.doc_id"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUALITY_COUNTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, h FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, h, unnest([i, i + 1, i + 2]) AS p FROM g) JOIN twice USING (doc_id, h) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ 	-]') GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _places(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a, length(found[i]) AS n
FROM (SELECT doc_id, found, value, parts, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS value, string_split_regex(t, '{pattern}') AS parts FROM d)) WHERE length(value[i]) >= {least}"""


SECRET_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_places(0, "assign", _ASSIGN, 2, 12)} UNION ALL {_places(1, "access", "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_places(2, "hex", "[0-9a-f]+", 0, 16)}),
s AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) AS joined FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""

_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

LM_COUNTS = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_WORD}') AS ws FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS s FROM documents)),
w AS (SELECT doc_id, held, unnest(list_append(ws, chr(10))) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held GROUP BY w), total AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 3) AS base_score
FROM w LEFT JOIN c USING (w), total GROUP BY doc_id, held"""

BPE_TEXTS = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

PACKING_CHECKS = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS lost_pieces, CAST(0 AS BIGINT) AS long_sequences, CAST(0 AS BIGINT) AS gaps FROM documents"

TOKEN_PLACES = "SELECT count(*) AS documents, greatest(count(*) - 1, 0) AS followed, greatest(count(*) - 1, 0) AS ascending FROM documents"


def license_counts(templates: dict[str, list[str]]) -> str:
    """Word-for-word occurrences of templates (lists of words); each word stands between blanks of its own, so none are shared."""
    spaced = lambda ws: "".join(f" {w} " for w in ws)  # noqa: E731
    each = " + ".join(f"(length(s) - length(replace(s, '{spaced(t)}', ''))) // {len(spaced(t))}" for t in templates.values())
    return f"""WITH w AS (SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(text, '[0-9A-Za-z](?:[0-9A-Za-z.-]*[0-9A-Za-z])?'), lambda x: ' ' || lower(x) || ' '), ''), '') AS s FROM documents)
SELECT doc_id, CAST({each} AS BIGINT) AS n_licenses FROM w"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '{_TERM}')) AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '{_TERM}')) AS t FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
m AS (SELECT doc_id, 50 + ((50 * n * docs) // terms) AS m FROM n, total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

_LUHN = """(list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(v[length(v) + 1 - i] AS INTEGER)
ELSE (2 * CAST(v[length(v) + 1 - i] AS INTEGER)) // 10 + (2 * CAST(v[length(v) + 1 - i] AS INTEGER)) % 10 END)) % 10 = 0)"""


def _personal(rank: int, kind: str, pattern: str, check: str) -> str:
    """Matches of a pattern that pass check, a condition on m, the match, and v, its digits."""
    whole = _places(rank, kind, pattern, 0, 0).replace("AS n\n", "AS n, found[i] AS m, regexp_replace(found[i], '[^0-9]', '', 'g') AS v\n", 1)
    return f"SELECT doc_id, k, kind, a, n FROM ({whole}) WHERE {check}"


_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length(v) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(v) BETWEEN 10 AND 15"),
}

PERSONAL_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_personal(i, kind, *x) for i, (kind, x) in enumerate(_BASE.items()))}),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{kind}" for i, kind in enumerate(_BASE))},
string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) AS joined FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _BASE)}, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""
