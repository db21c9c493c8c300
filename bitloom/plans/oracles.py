"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from bitloom.functions.text import BOUNDARY, EDGES, INK, NA_MARKERS, TOKEN, WS
from bitloom.operators.lexicon import LETTERS
from bitloom.operators.metrics import PUNCTUATION, TOKENIZE_13A

PAIRS = rf"""
raw AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'at': i - 1, 'line': x}}), lambda z: regexp_matches(z.line, '{INK}')) AS ls FROM documents),
two AS (SELECT doc_id, lang, source, unnest(list_transform(range(0, len(ls) // 2), lambda k: {{'a': ls[2 * k + 1], 'b': ls[2 * k + 2]}})) AS p FROM raw),
bare AS (SELECT source AS source_doc, doc_id || '_' || p.a.at AS line_id, CASE WHEN lang NOT IN ('fr', 'de') THEN CAST(doc_id AS VARCHAR) END AS fragment_id,
         CASE WHEN lang = 'de' THEN lang END AS section_id, CAST(NULL AS VARCHAR) AS chapter_id, p.a.line AS s0, p.b.line AS t0, CAST(doc_id * 1000000 + p.a.at AS BIGINT) AS ord FROM two),
pairs AS (SELECT * FROM (SELECT * EXCLUDE (s0, t0), regexp_replace(s0, '{EDGES}', '', 'g') AS src, regexp_replace(t0, '{EDGES}', '', 'g') AS tgt FROM bare)
          WHERE src <> '' AND src <> 'nan' AND tgt <> '' AND tgt <> 'nan'),
feat AS (SELECT *, CAST(length(src) AS INTEGER) AS src_chars, CAST(length(tgt) AS INTEGER) AS tgt_chars, CAST(len(regexp_extract_all(src, '{TOKEN}')) AS INTEGER) AS src_tokens,
         CAST(len(regexp_extract_all(tgt, '{TOKEN}')) AS INTEGER) AS tgt_tokens FROM pairs),
ratio AS (SELECT *, CAST(tgt_tokens + 1 AS DOUBLE) / (src_tokens + 1) AS len_ratio FROM feat),
okt AS (SELECT * FROM ratio WHERE len_ratio > CAST(0.15 AS DOUBLE) AND len_ratio < 6 AND src_chars < 800 AND tgt_chars < 800),
oke AS (SELECT * FROM ratio WHERE len_ratio >= CAST(0.2 AS DOUBLE) AND len_ratio <= 5 AND src_tokens >= 2 AND tgt_tokens >= 2),
train AS (SELECT * FROM okt QUALIFY row_number() OVER (PARTITION BY src, tgt, source_doc ORDER BY ord, line_id) = 1),
eval AS (SELECT * FROM oke QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY ord, line_id) = 1)"""

ID = "coalesce(source_doc || '__frag__' || fragment_id, source_doc || '__sec__' || section_id, source_doc || '__cap__' || chapter_id, {})"
LINE_ID, DOC_ID = ID.format("source_doc || '__line__' || line_id"), ID.format("source_doc")
CUT = """CASE WHEN k <= greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) THEN 'train'
 WHEN k <= greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) + greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) THEN 'dev' ELSE 'test' END"""
HELD = "contains(lower(source_doc), 'src19')"
SPLIT = f""",
tg AS (SELECT *, {LINE_ID} AS group_id FROM train),
sk AS (SELECT source_doc, group_id, row_number() OVER (PARTITION BY source_doc ORDER BY md5('42|' || group_id), group_id) AS k, count(*) OVER (PARTITION BY source_doc) AS n
       FROM (SELECT DISTINCT source_doc, group_id FROM tg WHERE NOT {HELD})),
strat AS (SELECT tg.*, CASE WHEN {HELD} THEN 'test' ELSE c.split END AS split FROM tg LEFT JOIN (SELECT source_doc, group_id, {CUT} AS split FROM sk) c USING (source_doc, group_id))"""
SHUFFLE = f""",
eg AS (SELECT *, {DOC_ID} AS group_id FROM eval),
ek AS (SELECT group_id, row_number() OVER (ORDER BY md5('42|' || group_id), group_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM eg)),
shuf AS (SELECT eg.*, CASE WHEN k <= ceil(ceil(n * CAST(0.2 AS DOUBLE)) * CAST(0.5 AS DOUBLE)) THEN 'test' WHEN k <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'dev' ELSE 'train' END AS split FROM eg JOIN ek USING (group_id))"""


def _hyps(rows: str) -> str:
    made = {"sys_copy": "tgt", "sys_empty": "''", "sys_lower": "lower(tgt)", "sys_novowel": "regexp_replace(tgt, '[aeiou]', '', 'g')", "sys_reverse": "reverse(tgt)", "sys_src": "src"}
    return " UNION ALL ".join(f"SELECT source_doc, line_id AS seg_id, '{k}' AS system, src, {v} AS hyp, tgt AS ref FROM {rows}" for k, v in made.items())


def _bleu_words(c: str) -> str:
    c = f"' ' || {c} || ' '"
    for pattern, new in TOKENIZE_13A:
        c = f"regexp_replace({c}, '{pattern}', '{new.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda w: w <> '')"


def _chrf_words(c: str) -> str:
    cut = f"CASE WHEN length(w) < 2 THEN [w] WHEN regexp_matches(w, '[{PUNCTUATION}]$') THEN [left(w, length(w) - 1), right(w, 1)] WHEN regexp_matches(w, '^[{PUNCTUATION}]') THEN [left(w, 1), substr(w, 2)] ELSE [w] END"
    return f"flatten(list_transform(list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda w: w <> ''), lambda w: {cut}))"


def _stats(h: str) -> str:
    """Statistics and scores of h(seg_id, system, hyp, ref)."""
    sides = []
    for s in ("hyp", "ref"):
        sides.append(
            f"SELECT seg_id, system, '{s}' AS side, 'char' AS kind, n, list_transform(range(1, length(b) - n + 2), lambda i: substr(b, i, n)) AS grams "
            f"FROM (SELECT seg_id, system, regexp_replace({s}, '[{WS}]+', '', 'g') AS b FROM h), range(1, 7) t(n)"
        )
        for kind, words, most in (("word", _chrf_words(s), 2), ("bleu", _bleu_words(s), 4)):
            sides.append(
                f"SELECT seg_id, system, '{s}' AS side, '{kind}' AS kind, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], chr(1))) AS grams "
                f"FROM (SELECT seg_id, system, {words} AS w FROM h), range(1, {most + 1}) t(n)"
            )
    return f""",
h AS ({h}),
gr AS ({" UNION ALL ".join(sides)}),
gc AS (SELECT seg_id, system, kind, n, gram, count(*) FILTER (side = 'hyp') AS h, count(*) FILTER (side = 'ref') AS r
       FROM (SELECT seg_id, system, side, kind, n, unnest(grams) AS gram FROM gr) GROUP BY ALL),
gs AS (SELECT seg_id, system, kind, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM gc GROUP BY ALL),
sf AS (SELECT system, kind, CAST(n AS BIGINT) AS n, sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS hyp, sum(h) AS hyp_all, sum(r) AS ref, sum(m) AS match FROM gs GROUP BY ALL),
ks AS (SELECT 'char' AS kind, CAST(n AS BIGINT) AS n FROM range(1, 7) t(n) UNION ALL SELECT 'word', n FROM range(1, 3) t(n) UNION ALL SELECT 'bleu', n FROM range(1, 5) t(n)),
st AS (SELECT system, kind, n, CAST(coalesce(hyp, 0) AS BIGINT) AS hyp, CAST(coalesce(hyp_all, 0) AS BIGINT) AS hyp_all, CAST(coalesce(ref, 0) AS BIGINT) AS ref,
       CAST(coalesce(match, 0) AS BIGINT) AS match FROM (SELECT DISTINCT system FROM h) CROSS JOIN ks LEFT JOIN sf USING (system, kind, n)),
cm AS (SELECT system, o.w AS word_order, b.b AS beta, avg(CAST(match AS DOUBLE) / nullif(hyp, 0)) FILTER (hyp > 0 AND ref > 0) AS p, avg(CAST(match AS DOUBLE) / nullif(ref, 0)) FILTER (hyp > 0 AND ref > 0) AS r
       FROM st, (VALUES (0), (2)) o(w), (VALUES (1), (2)) b(b) WHERE kind = 'char' OR (kind = 'word' AND n <= o.w) GROUP BY ALL),
chrf AS (SELECT system, CAST(word_order AS BIGINT) AS word_order, CAST(beta AS BIGINT) AS beta,
         CASE WHEN p + r > 0 THEN 100 * (1 + beta * beta) * p * r / (beta * beta * p + r) ELSE 0 END AS score FROM cm),
bl AS (SELECT system, CAST(max(hyp_all) FILTER (n = 1) AS DOUBLE) AS c, CAST(max(ref) FILTER (n = 1) AS DOUBLE) AS r, list(CAST(match AS DOUBLE) ORDER BY n) AS m, list(CAST(hyp_all AS DOUBLE) ORDER BY n) AS t
       FROM st WHERE kind = 'bleu' GROUP BY system),
bz AS (SELECT *, list_transform(range(1, 5), lambda i: CASE WHEN m[i] > 0 THEN m[i] / t[i] ELSE 1 / (pow(2, len(list_filter(m[1:i], lambda x: x = 0))) * greatest(t[i], 1)) END) AS p FROM bl),
bleu AS (SELECT system, CASE WHEN list_max(m) = 0 OR list_min(t) = 0 THEN 0
         ELSE 100 * CASE WHEN c < r THEN exp(1 - r / greatest(c, 1)) ELSE 1 END * exp((ln(p[1]) + ln(p[2]) + ln(p[3]) + ln(p[4])) / 4) END AS score FROM bz)"""


#: The words that aren't counted.
_UNCOUNTED = """de la el en y a que se los las un una con no lo es su al del por le me te nos les más si pero ya o era han hay fue ser son
como cuando para esto esta este eso esa ese sus él ella ellos ellas yo tú tu mi mis también todo todos toda todas muy bien así
porque entre hasta desde sobre sin ni e u unos unas an has have the le les nos os"""
_STOP = ", ".join(f"'{w}'" for w in _UNCOUNTED.split())
WORDS = f""",
tx AS (SELECT 'src' AS system, ord, src AS text FROM train UNION ALL SELECT 'tgt', ord, tgt FROM train),
tw AS (SELECT system, ord, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[{LETTERS}]+$') AND length(w) > 2 AND w NOT IN ({_STOP})) AS ws FROM tx),
ws AS (SELECT system, ord, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM tw),
wf AS (SELECT system, word, count(*) AS n, min({{'ord': ord, 'pos': pos}}) AS first FROM ws GROUP BY ALL),
tops AS (SELECT system, row_number() OVER (PARTITION BY system ORDER BY n DESC, first, word) AS rank, word, n FROM wf)"""
#: The endings of the public Snowball stemmer for Spanish.
_V = "aeiouáéíóúü"
_SE = "me|se|sela|selo|selas|selos|la|le|lo|las|les|los|nos"
_OSO = "anza|anzas|ico|ica|icos|icas|ismo|ismos|able|ables|ible|ibles|ista|istas|oso|osa|osos|osas|amiento|amientos|imiento|imientos"
_ADORA = "adora|ador|ación|adoras|adores|aciones|ante|antes|ancia|ancias"
_REST = "logía|logías|ución|uciones|encia|encias|mente|idad|idades|iva|ivo|ivas|ivos|amente"
_YA = "ya|ye|yan|yen|yeron|yendo|yo|yó|yas|yes|yais|yamos"
_EN = "en|es|éis|emos"
_AR = """arían|arías|arán|arás|aríais|aría|aréis|aríamos|aremos|ará|aré|erían|erías|erán|erás|eríais|ería|eréis|eríamos|eremos|erá|eré
irían|irías|irán|irás|iríais|iría|iréis|iríamos|iremos|irá|iré|aba|ada|ida|ía|ara|iera|ad|ed|id|ase|iese|aste|iste|an|aban|ían|aran|ieran|asen
iesen|aron|ieron|ado|ido|ando|iendo|ió|ar|er|ir|as|abas|adas|idas|ías|aras|ieras|ases|ieses|ís|áis|abais|íais|arais|ierais|aseis|ieseis|asteis
isteis|ados|idos|amos|ábamos|íamos|imos|áramos|iéramos|iésemos|ásemos""".replace("\n", "|")


def _stems(words: str) -> str:
    """(word, stem) of words(word), a step after another."""
    end = lambda w, endings, start="0": f"regexp_extract(substr({w}, CAST({start} AS BIGINT) + 1), '({endings})$', 1)"
    cut = lambda w, e: f"left({w}, length({w}) - length({e}))"
    plain = lambda w: f"translate({w}, 'áéíóú', 'aeiou')"
    at = lambda w, pattern: f"length(regexp_extract({w}, '{pattern}', 0))"
    after = f"^.*?[{_V}][^{_V}]"
    second = f"CASE WHEN regexp_matches(w, '^.[^{_V}]') THEN {at('w', f'^..[^{_V}]*[{_V}]')} ELSE {at('w', f'^..[{_V}]*[^{_V}]')} END"
    last = f"CASE WHEN l IN ('e', 'é') AND {cut('v', 'l')} LIKE '%gu' AND length(v) - 1 > rv THEN left(v, length(v) - 2) ELSE {cut('v', 'l')} END"
    steps = [
        f"SELECT word, lower(word) AS w FROM ({words})",
        f"SELECT *, CASE WHEN {at('w', after)} > 0 THEN {at('w', after)} ELSE length(w) END AS r1 FROM @",
        f"SELECT *, CASE WHEN {at('substr(w, r1 + 1)', after)} > 0 THEN r1 + {at('substr(w, r1 + 1)', after)} ELSE length(w) END AS r2, "
        f"CASE WHEN length(w) < 3 THEN length(w) WHEN regexp_matches(w, '^[^{_V}][{_V}]') THEN 3 WHEN {second} > 0 THEN {second} ELSE length(w) END AS rv FROM @",
        f"SELECT *, {end('w', _SE, 'rv')} AS p FROM @",
        f"SELECT *, {cut('w', 'p')} AS b FROM @",
        f"SELECT *, {end('b', 'iéndo|ándo|ár|ér|ír', 'rv')} AS pa, {end('b', 'ando|iendo|ar|er|ir', 'rv')} <> '' OR (b LIKE '%uyendo' AND length(b) - 5 >= rv) AS pv FROM @",
        f"SELECT word, r1, r2, rv, CASE WHEN p = '' THEN w WHEN pa <> '' THEN {cut('b', 'pa')} || {plain('pa')} WHEN pv THEN b ELSE w END AS w FROM @",
        f"SELECT *, {end('w', f'{_OSO}|{_ADORA}|{_REST}')} AS e FROM @",
        f"SELECT *, {cut('w', 'e')} AS s, '|' || e || '|' AS x FROM @",
        f"""SELECT *, CASE WHEN contains('|{_ADORA}|', x) THEN {end('s', 'ic')} WHEN e = 'mente' THEN {end('s', 'ante|able|ible')} WHEN e IN ('idad', 'idades') THEN {end('s', 'abil|ic|iv')}
            WHEN e IN ('iva', 'ivo', 'ivas', 'ivos') THEN {end('s', 'at')} WHEN e = 'amente' THEN {end('s', 'iv|os|ic|ad')} ELSE '' END AS m,
            CASE WHEN e IN ('logía', 'logías') THEN 'log' WHEN e IN ('ución', 'uciones') THEN 'u' WHEN e IN ('encia', 'encias') THEN 'ente' ELSE '' END AS new FROM @""",
        f"""SELECT word, rv, w, CASE WHEN e = '' THEN w WHEN e <> 'amente' AND length(s) < r2 THEN w WHEN e = 'amente' AND length(s) < r1 THEN w
            WHEN m <> '' AND length(s) - length(m) >= r2 THEN CASE WHEN e = 'amente' AND m = 'iv' AND s LIKE '%ativ' AND length(s) - 4 >= r2 THEN left(s, length(s) - 4) ELSE {cut('s', 'm')} END
            ELSE s || new END AS v FROM @""",
        f"SELECT *, {end('v', _YA, 'rv')} AS y, {end('v', f'{_EN}|{_AR}', 'rv')} AS z FROM @",
        f"""SELECT word, rv, CASE WHEN v <> w THEN v WHEN y <> '' AND {cut('v', 'y')} LIKE '%u' THEN {cut('v', 'y')} WHEN z = '' THEN v
            WHEN contains('|{_EN}|', '|' || z || '|') AND {cut('v', 'z')} LIKE '%gu' THEN left(v, length(v) - length(z) - 1) ELSE {cut('v', 'z')} END AS v FROM @""",
        f"SELECT *, {end('v', 'os|a|o|á|í|ó|e|é', 'rv')} AS l FROM @",
        f"SELECT word, {plain(last)} AS stem FROM @",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = step.replace("@", f"({out})")
    return out


STEMS = f""",
stems AS MATERIALIZED ({_stems("SELECT DISTINCT word FROM wf")}),
sw AS (SELECT system, stem, word, n, first, row_number() OVER (PARTITION BY system, stem ORDER BY n DESC, first, word) AS k, sum(n) OVER w AS total, min(first) OVER w AS f
       FROM wf JOIN stems USING (word) WINDOW w AS (PARTITION BY system, stem)),
stops AS (SELECT system, row_number() OVER (PARTITION BY system ORDER BY total DESC, f, stem) AS rank, word, CAST(total AS BIGINT) AS n FROM sw WHERE k = 1)"""
ALLOC = """,
al AS (SELECT source_doc, count(*) AS count FROM shuf WHERE split = 'test' GROUP BY ALL),
ax AS (SELECT *, CAST(count AS DOUBLE) / sum(count) OVER () * 28 AS exact FROM al),
ar AS (SELECT *, round_even(exact, 0) AS r0, 28 - sum(round_even(exact, 0)) OVER () AS short, round(exact - round_even(exact, 0), 9) AS rest FROM ax),
au AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source_doc) AS up, row_number() OVER (ORDER BY rest, source_doc) AS down FROM ar),
alloc AS (SELECT source_doc, count, CAST(greatest(r0 + CASE WHEN up <= short THEN 1 WHEN down <= -short THEN -1 ELSE 0 END, 0) AS BIGINT) AS n FROM au),
picked AS (SELECT s.* FROM (SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY md5('42|' || line_id), line_id) AS k FROM shuf WHERE split = 'test') s JOIN alloc USING (source_doc) WHERE k <= n)"""
STATS = ", ".join(f"CAST(sum({s}_tokens) AS BIGINT) AS {s}_tokens, round(avg({s}_tokens), 2) AS {s}_avg_len, round(stddev_samp({s}_tokens), 2) AS {s}_std_len" for s in ("src", "tgt"))


def _lexical(passes: int) -> str:
    """Expectation-maximisation over all word pairs of the training segments, pass after pass."""
    toks = lambda c: f"regexp_extract_all(lower({c}), '{TOKEN}')"
    vocab = lambda s: f"SELECT w, CAST(row_number() OVER (ORDER BY count(*) DESC, w) AS INT) AS i FROM (SELECT unnest({s}) AS w FROM lp) GROUP BY w"
    out = f""",
lp AS (SELECT row_number() OVER () AS sid, {toks("src")} AS s, {toks("tgt")} AS t FROM strat WHERE split = 'train'),
vs AS ({vocab("s")}), vt AS ({vocab("t")}),
ls AS (SELECT sid, e, count(*) AS n FROM (SELECT sid, i AS e FROM (SELECT sid, unnest(s) AS w FROM lp WHERE len(s) > 0 AND len(t) > 0) JOIN vs USING (w)
       UNION ALL SELECT sid, 0 FROM lp WHERE len(s) > 0 AND len(t) > 0) GROUP BY ALL),
lt AS (SELECT sid, f, count(*) AS n FROM (SELECT sid, i AS f FROM (SELECT sid, unnest(t) AS w FROM lp WHERE len(s) > 0 AND len(t) > 0) JOIN vt USING (w)) GROUP BY ALL),
co AS MATERIALIZED (SELECT sid, e, f, ls.n AS a, ls.n * lt.n AS n FROM ls JOIN lt USING (sid)),
t0 AS (SELECT DISTINCT e, f, CAST(1 AS DOUBLE) AS p FROM co)"""
    for k in range(passes):
        out += f""",
t{k + 1} AS MATERIALIZED (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS p FROM (SELECT e, f, sum(n * p / z) AS c
  FROM (SELECT co.*, p, sum(a * p) OVER (PARTITION BY sid, f) AS z FROM co JOIN t{k} USING (e, f)) GROUP BY e, f))"""
    return f"{out} SELECT vs.w AS src, vt.w AS tgt, round(p, 6) AS p FROM t{passes} LEFT JOIN vs ON vs.i = e JOIN vt ON vt.i = f WHERE p >= CAST(0.01 AS DOUBLE)"


BATCHES = f""",
ex AS (SELECT line_id || '|' || way AS key, CAST(least(len(regexp_extract_all(side, '{TOKEN}')), 128) AS INT) AS length FROM
       (SELECT line_id, 'aa-bb' AS way, src AS side FROM strat WHERE split = 'train' UNION ALL SELECT line_id, 'bb-aa', tgt FROM strat WHERE split = 'train')),
lh AS (SELECT length, count(*) AS n FROM ex GROUP BY length),
lb AS (SELECT length, CAST(floor((sum(n) OVER (ORDER BY length) - n) * 16 / CAST(sum(n) OVER () AS DOUBLE)) AS INT) AS bucket FROM lh),
lc AS (SELECT *, CAST(ceil(max(length) OVER (PARTITION BY bucket) / CAST(8 AS DOUBLE)) * 8 AS BIGINT) AS places FROM lb),
ba AS (SELECT key, length, bucket, places, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY md5('42|' || key), key) - 1) / greatest(1, 4096 // places)) AS BIGINT) AS batch FROM ex JOIN lc USING (length))"""


def _leaks(key: str) -> str:
    keys = f"SELECT {key}, max(CAST(split = 'train' AS INT)) AS a, max(CAST(split = 'dev' AS INT)) AS b, max(CAST(split = 'test' AS INT)) AS c FROM strat GROUP BY {key}"
    one = lambda name, x, y: f"SELECT '{name}' AS \"check\", CAST(coalesce(sum({x} * {y}), 0) AS BIGINT) AS shared FROM k"
    return f", k AS ({keys}) " + " UNION ALL ".join((one("train/dev", "a", "b"), one("train/test", "a", "c"), one("dev/test", "b", "c")))


SENTENCES = f""",
sl AS (SELECT *, coalesce('f|' || fragment_id, 's|' || section_id, 'd') AS key, regexp_matches(src, '{BOUNDARY}') AS e FROM train),
sr AS (SELECT *, row_number() OVER (PARTITION BY source_doc, key ORDER BY ord) AS i, length(src) AS len FROM sl),
pack AS (SELECT source_doc, key, i, 0 AS seg, len AS size, e, (len >= 20 AND (e OR len >= 260)) AS flush FROM sr WHERE i = 1
  UNION ALL SELECT n.source_doc, n.key, n.i, p.seg + CAST(p.flush AS INT), g.s, n.e, (g.s >= 20 AND (n.e OR g.s >= 260))
  FROM pack p JOIN sr n ON n.source_doc = p.source_doc AND n.key = p.key AND n.i = p.i + 1, LATERAL (SELECT CASE WHEN p.flush THEN n.len ELSE p.size + 1 + n.len END AS s) g)
SELECT source_doc, min_by(line_id, ord) AS line_id, min(ord) AS ord, count(*) AS n_lines, string_agg(src, ' ' ORDER BY ord) AS src, string_agg(tgt, ' ' ORDER BY ord) AS tgt
FROM sr JOIN pack USING (source_doc, key, i) GROUP BY source_doc, key, seg"""


def sql() -> dict[str, str]:
    t, s, e = f"WITH {PAIRS}", f"WITH {PAIRS}{SPLIT}", f"WITH {PAIRS}{SHUFFLE}"
    m = s + _stats(_hyps("(SELECT * FROM strat WHERE split = 'test')"))
    ways = "SELECT line_id AS seg_id, 'aa-bb' AS direction, src, tgt AS ref FROM shuf WHERE split = 'test' UNION ALL SELECT line_id, 'bb-aa', tgt, src FROM shuf WHERE split = 'test'"
    made = "SELECT *, 'back' AS system, reverse(src) AS hyp FROM ways UNION ALL SELECT *, 'mark', '[' || replace(direction, '-', '>') || '] ' || src FROM ways"
    both = f"{e}, ways AS ({ways})" + _stats(f"SELECT seg_id, system || ' ' || direction AS system, hyp, ref FROM ({made})")
    family = {"ChrF": (0, 1), "ChrF++": (2, 1), "ChrF2": (0, 2), "ChrF2++": (2, 2)}
    scores = ", ".join(f"round(max(c.score) FILTER (word_order = {o} AND beta = {b}), 2) AS \"{name}\"" for name, (o, b) in family.items())
    marks = ", ".join("'" + x + "'" for x in NA_MARKERS)
    w = t + WORDS
    turns = f"""WITH led AS (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            p AS (SELECT conv_id * 1000 + turn AS ord, regexp_replace(text, '{EDGES}', '', 'g') AS src, regexp_replace(nt, '{EDGES}', '', 'g') AS tgt
                  FROM led WHERE role = 'user' AND nr = 'assistant' AND text NOT IN ({marks}) AND nt NOT IN ({marks})) """
    removed = f"""{t} SELECT (SELECT count(*) FROM pairs) AS rows_in, (SELECT count(*) FROM pairs) - (SELECT count(*) FROM (SELECT DISTINCT src, tgt, source_doc FROM pairs)) AS duplicates,
            (SELECT count(*) FROM (SELECT DISTINCT src, tgt, source_doc FROM pairs)) - (SELECT count(*) FROM train) AS out_of_bounds, (SELECT count(*) FROM train) AS rows_out"""
    return {
        "pairs_clean": f"{t} SELECT * FROM pairs",
        "turn_pairs_eval": f"""WITH led AS (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            p AS (SELECT CAST(conv_id AS VARCHAR) AS source_doc, CAST(turn AS VARCHAR) AS line_id, conv_id * 1000 + turn AS ord, regexp_replace(text, '{EDGES}', '', 'g') AS src, regexp_replace(nt, '{EDGES}', '', 'g') AS tgt
                  FROM led WHERE role = 'user' AND nr = 'assistant'),
            f AS (SELECT *, len(regexp_extract_all(src, '{TOKEN}')) AS a, len(regexp_extract_all(tgt, '{TOKEN}')) AS b FROM p WHERE src NOT IN ('', 'nan') AND tgt NOT IN ('', 'nan'))
            SELECT source_doc, line_id, src, tgt FROM f WHERE a >= 2 AND b >= 2 AND CAST(b + 1 AS DOUBLE) / (a + 1) BETWEEN CAST(0.2 AS DOUBLE) AND 5 QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY ord, line_id) = 1""",
        "qc_features": f"{t} SELECT line_id, src_chars, tgt_chars, src_tokens, tgt_tokens, round(len_ratio, 6) AS len_ratio FROM ratio",
        "qc_train": f"{t} SELECT line_id, src, tgt FROM okt",
        "qc_eval": f"{t} SELECT line_id, src, tgt FROM oke",
        "dedup_doc_scoped": f"{t} SELECT source_doc, line_id, src, tgt FROM pairs QUALIFY row_number() OVER (PARTITION BY src, tgt, source_doc ORDER BY ord, line_id) = 1",
        "dedup_global": f"{t} SELECT source_doc, line_id, src, tgt FROM pairs QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY ord, line_id) = 1",
        "qc_removed_counts": removed,
        "qc_observed_counts": removed,
        "corpus_stats_total": f"{t} SELECT CASE WHEN grouping(source_doc) = 1 THEN 'TOTAL' ELSE source_doc END AS corpus, count(*) AS segments, {STATS} FROM train GROUP BY ROLLUP (source_doc)",
        "doc_value_counts": f"{t} SELECT source_doc, count(*) AS n FROM train GROUP BY ALL",
        "group_ids_line": f"{t} SELECT line_id, {LINE_ID} AS group_id FROM train",
        "group_ids_document": f"{t} SELECT line_id, {DOC_ID} AS group_id FROM eval",
        "split_stratified": f"{s} SELECT line_id, group_id, split FROM strat",
        "split_global": f"""{s}, gk AS (SELECT group_id, row_number() OVER (ORDER BY md5('42|' || group_id), group_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM tg WHERE NOT {HELD}))
            SELECT line_id, group_id, CASE WHEN {HELD} THEN 'test' ELSE {CUT} END AS split FROM tg LEFT JOIN gk USING (group_id)""",
        "group_shuffle_split": f"{e} SELECT line_id, group_id, split FROM shuf",
        "split_stats": f"{s} SELECT split, count(*) AS rows, round(avg(length(src)), 1) AS src_chars_mean, round(avg(length(tgt)), 1) AS tgt_chars_mean FROM strat GROUP BY split",
        "leak_groups": s + _leaks("group_id"),
        "leak_pairs": s + _leaks("src, tgt"),
        "test_contamination": f"{s}{SHUFFLE} SELECT source_doc, line_id FROM shuf WHERE split = 'test' AND (src, tgt) IN (SELECT (src, tgt) FROM strat WHERE split = 'train')",
        "view_line": f"{t} SELECT source_doc, line_id, fragment_id, section_id, chapter_id, src, tgt FROM train",
        "view_sentence": f"WITH RECURSIVE {PAIRS}{SENTENCES}",
        "view_fragment": f"{t} SELECT source_doc, fragment_id AS unit_id, min_by(line_id, ord) AS line_id, min(ord) AS ord, count(*) AS n_lines, string_agg(src, ' ' ORDER BY ord) AS src, string_agg(tgt, ' ' ORDER BY ord) AS tgt FROM train WHERE fragment_id IS NOT NULL GROUP BY ALL",
        "metadata_unpivot": """WITH u AS (SELECT CAST(p_partkey AS VARCHAR) AS line_id, unnest([{'level': 'part', 'src': p_name, 'tgt': p_type}, {'level': 'brand', 'src': p_brand, 'tgt': CASE WHEN length(p_name) > 12 THEN 'N/A' ELSE p_brand END}]) AS x FROM part)
            SELECT line_id, x.level AS level, x.src AS src, x.tgt AS tgt FROM u WHERE lower(x.src) NOT IN ('', 'n/a') AND lower(x.tgt) NOT IN ('', 'n/a') AND x.src <> 'nan' AND x.tgt <> 'nan'""",
        "char_ngram_stats": f"{m} SELECT * FROM st",
        "chrf_scores": f"{m} SELECT system, word_order, beta, round(score, 4) AS score FROM chrf",
        "bleu_scores": f"{m} SELECT system, round(score, 4) AS score FROM bleu",
        "metric_delta": f"{m} SELECT a.word_order, a.beta, round(a.score - b.score, 4) AS delta FROM chrf a JOIN chrf b USING (word_order, beta) WHERE a.system = 'sys_lower' AND b.system = 'sys_novowel'",
        "hyp_wide": f"""{s} SELECT source_doc, line_id AS seg_id, src, tgt AS ref, tgt AS sys_copy, '' AS sys_empty, lower(tgt) AS sys_lower, regexp_replace(tgt, '[aeiou]', '', 'g') AS sys_novowel, reverse(tgt) AS sys_reverse, src AS sys_src
            FROM strat WHERE split = 'test'""",
        "word_freq_top": f"{w} SELECT system, rank, word, n FROM tops WHERE rank <= 100",
        "word_freq_compare": f"{w} SELECT a.rank, a.word AS word_left, a.n AS count_left, b.word AS word_right, b.n AS count_right FROM tops a JOIN tops b USING (rank) WHERE a.system = 'src' AND b.system = 'tgt' AND rank <= 20",
        "word_freq_stemmed": f"{w}{STEMS} SELECT system, rank, word, n FROM stops WHERE rank <= 100",
        "word_stems": f"{w}, stems AS ({_stems('SELECT DISTINCT word FROM wf')}) SELECT word, stem FROM stems",
        "sample_allocation": f"{e}{ALLOC} SELECT source_doc, count, n FROM alloc",
        "stratified_sample": f"{e}{ALLOC} SELECT source_doc, line_id AS seg_id, src, tgt FROM picked",
        "rating_sheet": f"{e}{ALLOC} SELECT source_doc, line_id AS seg_id, src AS source_a, tgt AS reference_b, tgt AS translation_b_sys_copy, lower(tgt) AS translation_b_sys_lower, '' AS eval_sys_copy, '' AS eval_sys_lower FROM picked",
        "translate_stub": f"{e}, ways AS ({ways}) SELECT seg_id, direction, system, hyp FROM ({made})",
        "eval_results": f"""{both} SELECT split_part(system, ' ', 1) AS system, split_part(system, ' ', 2) AS direction, round(max(b.score), 2) AS "BLEU", {scores}
            FROM chrf c JOIN bleu b USING (system) GROUP BY system""",
        "lexical_table": s + _lexical(3),
        "length_batches": f"{s}{BATCHES} SELECT * FROM ba",
        "padding_by_bucket": f"{s}{BATCHES} SELECT bucket, count(*) AS examples, max(batch) + 1 AS batches, CAST(sum(places) AS BIGINT) AS places, round(1 - sum(greatest(length, 1)) / CAST(sum(places) AS DOUBLE), 6) AS padding FROM ba GROUP BY bucket",
        "eval_samples": f"{s}, h AS ({_hyps("(SELECT * FROM strat WHERE split = 'test')")}) "
        "SELECT system, seg_id, src, ref, hyp FROM h QUALIFY row_number() OVER (PARTITION BY system ORDER BY seg_id) <= 5",
        "view_level": f"{t} SELECT CASE WHEN count(fragment_id) > 0 THEN 'fragment_id' WHEN count(section_id) > 0 THEN 'section_id' WHEN count(chapter_id) > 0 THEN 'chapter_id' END AS level FROM train",
        "csv_round_trip": f"""{turns} SELECT 'The Turns' AS source_doc, 'the_turns_' || row_number() OVER (ORDER BY ord) AS line_id, src, tgt, 'csv' AS sheet_name FROM p WHERE src NOT IN ('', 'nan') AND tgt NOT IN ('', 'nan')""",
        "csv_lineage": f"{turns} SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS files_with_gaps FROM p WHERE src NOT IN ('', 'nan') AND tgt NOT IN ('', 'nan')",
        "workbook_round_trip": f"""{t} SELECT source_doc, coalesce(section_id, 'lines') AS sheet_name, line_id, fragment_id, section_id, src, tgt, false AS corrupt FROM train
            UNION ALL SELECT 'Broken', NULL, NULL, NULL, NULL, NULL, NULL, true""",
        "xlsx_round_trip": """SELECT 'The Nations' AS source_doc, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'the_nations_' || row_number() OVER (ORDER BY n_nationkey) END AS line_id,
              CAST(n_regionkey AS VARCHAR) AS section_id, n_name AS src, lower(n_name) AS tgt, 'lines' AS sheet_name FROM nation
            UNION ALL SELECT 'The Nations', 'The Nations_meta_names_name_region_src_' || r_regionkey, NULL, r_name, lower(r_name), 'names' FROM region WHERE r_regionkey <> 2""",
    }
