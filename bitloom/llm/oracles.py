"""DuckDB SQL with the results of the queries that SQL can express."""

from bitloom.llm import language_id, secret_scan, spotsigs, unit_dedup

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM documents),
w AS (SELECT rid, doc_id, txt, list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n >= 2),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, txt, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR n_symbols * 5 > n_words
            OR n_dup_lines * 10 > n_lines * 3
            OR length(regexp_replace(txt, '\P{Lu}', '', 'g')) * 2 > word_chars
            OR length(regexp_replace(txt, '\P{L}', '', 'g')) * 2 < word_chars
            OR (length(txt) - length(replace(txt, '!', ''))) * 2 > n_words) AS kept
FROM b
"""

def _components(n: int, percent: int) -> str:
    grams = "list_transform(range(1, len(ws) - %d), lambda i: %s)" % (n - 2, " || ' ' || ".join(f"ws[i + {k}]" for k in range(n)))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= {n} THEN {grams}
                                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM n),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep
      WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {percent} * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS seen FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT id, min(seen) AS root FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.root, s.doc_id) AS component_id
FROM s LEFT JOIN n USING (sh) LEFT JOIN k ON k.id = n.rep
"""


OP12 = r"""
WITH t AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
f AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY rid),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (rid), c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

#: Nodes are named by the digests of their turns, one after another; a descendant's path is its smallest member's.
OP13 = r"""
WITH bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
crc AS (SELECT conv_id, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) CROSS JOIN bits),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS root, h % 4 AS h FROM crc),
b AS (SELECT c.conv_id, o.pos, role, txt FROM c JOIN o ON o.conv_id = c.root WHERE o.pos <= h
      UNION ALL SELECT c.conv_id, o.pos, role, txt FROM c JOIN o USING (conv_id) WHERE o.pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || txt), '') OVER w AS node,
             len(list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
      FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '') AS ends FROM p JOIN e USING (conv_id) GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, left(node, 32 * (CAST(depth AS INTEGER) - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
s AS (SELECT p.depth, p.node, sum((m.n_convs - 1) * m.words) AS saved, count(*) FILTER (m.n_children = 0) AS n_leaves
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY ALL)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (depth, node) LEFT JOIN m u ON u.depth = m.depth - 1 AND u.node = left(m.node, 32 * (CAST(m.depth AS INTEGER) - 1)) AND m.depth > 0
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END)) AS sh FROM w),
n AS (SELECT sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM n),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep
      WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS seen FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT id, min(seen) AS root FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, coalesce(k.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN n USING (sh) LEFT JOIN k ON k.id = n.rep
"""



def _matches(kind: int, pattern: str, ok: str = "true") -> str:
    """Spans of a pattern: gaps and matches take turns, so a match starts after all before it."""
    start = "CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""SELECT rid, {kind} AS kind, s AS start, s + length(m[j]) AS stop FROM (
      SELECT rid, m, j, {start} AS s FROM (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS j FROM (
        SELECT rid, regexp_extract_all(txt, '{pattern}') AS m, regexp_split_to_array(txt, '{pattern}') AS g FROM d WHERE regexp_matches(txt, '{pattern}')))) WHERE {ok}"""


def _op4() -> str:
    assign = secret_scan.ASSIGN.replace("'", "''")
    runs = "[A-Za-z0-9+/_=-]{20,}"
    table = "[" + ", ".join(map(str, secret_scan.CLOGC)) + "]"
    window = "substr(m[j], w, 20)"
    total = f"list_sum(list_transform(list_distinct(string_split({window}, '')), lambda c: {table}[1 + length({window}) - length(replace({window}, c, ''))]))"
    least = f"list_min(list_transform(range(1, length(m[j]) - 18), lambda w: {total}))"
    classes = secret_scan.THRESHOLDS
    case = lambda said: "CASE " + " ".join(f"WHEN regexp_matches(m[j], '{c[1]}') THEN {said(c)}" for c in classes) + " END"
    most = case(lambda c: secret_scan.most_sum(c[2]))
    held = case(lambda c: " AND ".join(f"regexp_matches(m[j], '{x}')" for x in c[3]))
    allowed = " OR ".join(f"regexp_matches(m[j], '{p}')" for p in secret_scan.ALLOWED)
    odd = f"{held} AND NOT ({allowed}) AND {least} <= {most}"
    parts = [_matches(0, assign, f"length(regexp_extract(m[j], '{assign}', 2)) >= 12"), _matches(1, secret_scan.ACCESS), _matches(2, secret_scan.HEX), _matches(3, runs, odd)]
    name = "['" + "', '".join(secret_scan.KINDS) + "'][kind + 1] || ':' || start || ':' || stop"
    n = ", ".join(f"CAST(count(kind) FILTER (kind = {k}) AS BIGINT) AS n_{x}" for k, x in enumerate(secret_scan.KINDS))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM documents),
      s AS ({" UNION ALL ".join(parts)})
      SELECT any_value(doc_id) AS doc_id, {n}, sha256(coalesce(string_agg({name}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
             coalesce(string_agg({name}, ',' ORDER BY start, kind), '') AS spans FROM d LEFT JOIN s USING (rid) GROUP BY rid"""


def _signatures(texts: str) -> str:
    """The tables w to f: f(doc_id, which, f) has the sorted sets of the texts x(doc_id, which, t)."""
    stops = "(" + ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS))) + ", chr(1))"
    marks = spotsigs.PUNCTUATION.replace("'", "''")
    chain = ", ".join(f"c[i - k + {n + 1}]" for n in range(spotsigs.CHAIN))
    one = lambda x: f"substr(md5({x}), 1, 8)"
    return f"""x AS ({texts}),
      w AS (SELECT doc_id, which, list_filter(regexp_split_to_array(chr(1) || ' ' || replace(lower(translate(t, '{marks}', '')), chr(10), ' ' || chr(1) || ' '), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM x),
      c AS (SELECT doc_id, which, w, list_filter(w, lambda v: v NOT IN {stops}) AS c, list_filter(range(1, len(w) + 1), lambda i: w[i] IN {stops}) AS a FROM w),
      g AS (SELECT doc_id, which, CASE WHEN len(c) > 0 THEN list_filter(list_transform(a, lambda i, k: CASE WHEN i - k < len(c) THEN {one(f"concat_ws(' ', w[i], {chain})")} END), lambda v: v IS NOT NULL)
              WHEN len(list_filter(w, lambda v: v <> chr(1))) > 0 THEN [{one("array_to_string(w, ' ')")}] ELSE [] END AS g FROM c),
      f AS (SELECT doc_id, which, list_sort(list_distinct(g)) AS f FROM g)"""


def _op9() -> str:
    like = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"
    texts = "SELECT doc_id, 'own' AS which, t FROM e UNION ALL SELECT doc_id, 'edited', ed FROM e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      o AS (SELECT doc_id, t, lead(doc_id) OVER w AS ni, lead(t) OVER w AS nt, first_value(doc_id) OVER w AS fi, first_value(t) OVER w AS ft FROM d WINDOW w AS (ORDER BY doc_id DESC)),
      e AS (SELECT doc_id, t, coalesce(ni, fi) AS ni, substr(t, 1, length(t) - length(t) // 3) || substr(coalesce(nt, ft), 1, length(t) // 3) AS ed FROM o),
      {_signatures(texts)},
      p AS (SELECT e.doc_id, length(t) AS n, sha256(ed) AS h, a.f AS fa, b.f AS fb, z.f AS fz FROM e JOIN f a ON a.doc_id = e.doc_id AND a.which = 'own' JOIN f b ON b.doc_id = e.doc_id AND b.which = 'edited'
            JOIN f z ON z.doc_id = e.ni AND z.which = 'own')
      SELECT doc_id, CAST(n AS BIGINT) AS n_chars, h AS edited_sha256, array_to_string(fa, '') AS fingerprint, array_to_string(fb, '') AS edited_fingerprint,
             CAST({like("fa", "fb")} AS DOUBLE) AS near_edited, CAST({like("fa", "fz")} AS DOUBLE) AS near_next FROM p"""


def _fingerprint_classes() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      {_signatures("SELECT doc_id, 'own' AS which, t FROM d")},
      n AS (SELECT f AS sh, min(doc_id) AS rep FROM f WHERE len(f) > 0 GROUP BY f),
      u AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM n),
      p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
      l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
      y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
      r AS (SELECT rep AS id, rep AS seen FROM n UNION SELECT r.id, y.b FROM r JOIN y ON r.seen = y.a),
      k AS (SELECT id, min(seen) AS root FROM r GROUP BY id)
      SELECT f.doc_id, CAST(len(f.f) AS BIGINT) AS n_signatures, coalesce(k.root, f.doc_id) AS class_id FROM f LEFT JOIN n ON n.sh = f.f LEFT JOIN k ON k.id = n.rep"""


OP10 = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, string_split(replace(regexp_replace(text, '([.!?])( )', '\1' || chr(2) || '\2', 'g'), chr(10), chr(10) || chr(2)), chr(2)) AS u FROM d),
p AS (SELECT doc_id, text, u[j] AS part, coalesce(CAST(list_sum(list_transform(u[1:j - 1], lambda x: length(x))) AS BIGINT), 0) AS pos, j FROM (SELECT *, unnest(range(1, len(u) + 1)) AS j FROM c)),
q AS (SELECT doc_id, text, j, pos, regexp_extract_all(part, '\S+') AS ws, regexp_split_to_array(part, '\S+') AS gs FROM p),
w AS (SELECT doc_id, text, j, k, len(ws) AS n, lower(ws[k]) AS word, length(ws[k]) AS size,
             pos + list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:k - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM q)),
e AS (SELECT *, coalesce(sum(CAST(n > {unit_dedup.LONGEST} AND (length(word) + 3 * ord(left(word, 1)) + 5 * ord(right(word, 1))) & 7 = 0 AS INT)) OVER (PARTITION BY doc_id, text, j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM w),
n0 AS (SELECT doc_id, text, j, part, min(a) AS a, max(a + size) AS b, count(*) AS words, string_agg(word, ' ' ORDER BY k) AS norm FROM e GROUP BY doc_id, text, j, part),
-- The line and paragraph of a piece: how many line feeds, and pairs of them, lie before it.
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY j, part) AS no, length(h) - length(replace(h, chr(10), '')) AS line, length(h) - length(replace(h, chr(10) || chr(10), '')) AS para
      FROM (SELECT *, left(text, CAST(a AS BIGINT)) AS h FROM n0)),
l AS (SELECT doc_id, text, line, any_value(para) AS para, min(no) AS no, min(a) AS a, max(b) AS b, sum(words) AS words, string_agg(norm, ' ' ORDER BY no) AS norm, count(*) AS n_parts FROM n GROUP BY doc_id, text, line),
pg AS (SELECT doc_id, text, para, min(no) AS no, min(a) AS a, max(b) AS b, sum(words) AS words, string_agg(norm, ' ' ORDER BY no) AS norm FROM l GROUP BY doc_id, text, para HAVING count(*) > 1 AND sum(words) >= {unit_dedup.LEAST_WHOLE}),
k AS (SELECT doc_id, text, n.no, n.a, n.b, n.words, n.norm, true AS is_piece, n_parts = 1 AND l.words >= {unit_dedup.LEAST_WHOLE} AS is_whole FROM n JOIN l USING (doc_id, text, line)
      UNION ALL SELECT doc_id, text, no, a, b, words, norm, false, true FROM l WHERE n_parts > 1 AND words >= {unit_dedup.LEAST_WHOLE}
      UNION ALL SELECT doc_id, text, no, a, b, words, norm, false, true FROM pg),
m AS (SELECT *, first_value(doc_id) OVER f AS fd, row_number() OVER f AS r FROM k WINDOW f AS (PARTITION BY norm ORDER BY doc_id, a)),
i AS (SELECT *, no - dense_rank() OVER (PARTITION BY doc_id, text ORDER BY no) AS run FROM m WHERE r > 1),
g AS (SELECT doc_id, text, run, coalesce(sum(words) FILTER (is_piece), 0) AS n_words FROM i GROUP BY doc_id, text, run),
z AS (SELECT doc_id, text, run, min(a) AS a, max(b) AS b, count(*) AS n_units, sum(words) AS n_words, first(fd ORDER BY words DESC, no) AS fd FROM i JOIN g USING (doc_id, text, run)
      WHERE is_piece AND g.n_words >= {unit_dedup.LEAST_WORDS} GROUP BY doc_id, text, run
      UNION ALL SELECT doc_id, text, run, a, b, 1, words, fd FROM i WHERE is_whole)
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", CAST(n_units AS BIGINT) AS n_units, CAST(n_words AS BIGINT) AS n_words, fd AS kept_doc_id
FROM z QUALIFY coalesce(b > max(b) OVER (PARTITION BY doc_id, text, run ORDER BY a, b DESC, n_units DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
"""

OP2 = rf"""
WITH bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) AS h FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN bits),
d AS (SELECT doc_id, lang, coalesce(h % 4 = 2, false) AS held_out, ' ' || trim(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', ' ', 'g'))) || ' ' AS c FROM documents LEFT JOIN crc USING (doc_id)),
g AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(c) + 1), lambda i: c[i]), list_transform(range(1, length(c)), lambda i: c[i : i + 1]),
                list_transform(list_filter(range(1, length(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i : i + 2]))) AS g FROM d WHERE c <> '  ') WHERE g <> ' ' GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g),
q AS (SELECT lang, g, r FROM p WHERE r < {language_id.PROFILE}),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS i FROM g),
f AS (SELECT o.doc_id, l.lang, CAST(sum(coalesce(abs(q.r - o.i), {language_id.PROFILE})) AS DOUBLE) / count(*) / {language_id.PROFILE} AS far
      FROM o CROSS JOIN (SELECT DISTINCT lang FROM q) l LEFT JOIN q ON q.lang = l.lang AND q.g = o.g WHERE o.i < {language_id.PROFILE} GROUP BY ALL),
b AS (SELECT doc_id, lang, far FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - b.far, 0) AS score FROM d LEFT JOIN b USING (doc_id)
"""

SQL = {"op2_language_id": OP2, "op4_secret_scans": _op4(), "op6_minhash_near_dedup": OP6, "op8_quality_rules": OP8, "op9_document_fingerprints": _op9(), "op10_substring_dedup": OP10, "document_fingerprint_classes": _fingerprint_classes()}
SQL |= {"op11_ngram_jaccard_join": _components(4, 85), "op12_ranked_search": OP12, "op13_conversation_trie": OP13}
