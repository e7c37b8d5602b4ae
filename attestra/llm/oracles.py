"""SQL, for a single-node engine, that gives what some of the operators give."""

from __future__ import annotations

from .licence_catalogue import known, sections
from .licences import BLANKS, COPYRIGHT, SPELLINGS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"



def _linked(k: int, share: int) -> str:
    """Rows with their components by sets of k-word shingles that have share percent in common."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text", "[^\\x20\\x09-\\x0D]+")} ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {k} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[CAST(i AS INT):CAST(i AS INT) + {k - 1}], ' ') END g FROM w, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT a.doc_id x, b.doc_id y, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {share} * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x doc_id, min(y) component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


NEAR_DUP = _linked(5, 75)
JACCARD_JOIN = f"SELECT doc_id, n_shingles, component_id FROM ({_linked(3, 90)})"

_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words("text", _ALNUM)} ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) item, {_words("text", _ALNUM)} ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(ws)) k, array_to_string(ws[CAST(j AS INT):CAST(j AS INT) + least(10, len(ws)) - 1], ' ') g FROM i, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) r(j) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, CAST(j AS INT) j, array_to_string(ws[CAST(j AS INT):CAST(j AS INT) + k - 1], ' ') g FROM d, ks, unnest(range(1, greatest(len(ws) - k + 2, 1))) r(j)),
h AS (SELECT doc_id, j, k, item FROM dw JOIN iw USING (k, g)),
hw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM h, unnest(range(j, j + k)) r(p) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _flat(e: str) -> str:
    return f"regexp_replace(regexp_replace(lower({e}), {_quoted(COPYRIGHT)}, '', 'g'), {_quoted(BLANKS)}, ' ', 'g')"


def _spelled(e: str) -> str:
    out = f"' ' || regexp_replace({e}, '\\s+', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_KNOWN = ", ".join(f"({_quoted(n)}, {_quoted(t)}, {e})" for e, listed in (("true", known()), ("false", sections())) for n, t in listed)
LICENCES = f"""
WITH k AS (SELECT n, {_spelled(_flat("t"))} c, bool_or(e) e FROM (VALUES {_KNOWN}) v(n, t, e) GROUP BY 1, 2),
d AS (SELECT doc_id, {_flat("text")} x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, true w, x p FROM d UNION ALL SELECT doc_id, false, unnest(string_split(x, chr(10))) FROM d WHERE contains(x, chr(10)) UNION ALL SELECT doc_id, false, p FROM (SELECT doc_id, unnest(regexp_split_to_array(x, '\n( ?\n)+')) p FROM d WHERE regexp_matches(x, '\n ?\n')) WHERE contains(trim(p, ' ' || chr(10)), chr(10))),
f AS (SELECT doc_id, w AND e w, n FROM (SELECT doc_id, w, {_spelled("p")} c FROM p) JOIN k USING (c)),
g AS (SELECT doc_id, string_agg(DISTINCT n, ',' ORDER BY n) l, count(*) m, min(n) FILTER (WHERE w) z FROM f GROUP BY 1)
SELECT doc_id, coalesce(l, '') AS licences, CAST(coalesce(m, 0) AS BIGINT) AS n_matches, z AS whole FROM documents LEFT JOIN g USING (doc_id)
"""

#: Lines by their normal forms; linked ones are joined by their least number; the first line of each group stays.
LINE_DEDUP = f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) place FROM d WHERE text IS NOT NULL),
n AS (SELECT doc_id, text, raw, place, trim(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[\\t\\x0B\\f\\r ]+', ' ', 'g'), ' ') x FROM l),
u AS (SELECT x, row_number() OVER (ORDER BY x) id FROM (SELECT DISTINCT x FROM n WHERE x <> '')),
g AS (SELECT DISTINCT id, substring(x, CAST(i AS BIGINT), 8) g FROM u, unnest(range(1, length(x) - 6)) r(i) WHERE length(x) >= 8),
z AS (SELECT id, count(*) z FROM g GROUP BY 1),
c AS (SELECT a.id x, b.id y, count(*) k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN z p ON p.id = x JOIN z q ON q.id = y WHERE 100 * k >= 75 * (p.z + q.z - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
m AS (SELECT x id, min(y) root FROM r GROUP BY 1),
t AS (SELECT n.*, coalesce(m.root, u.id) root FROM n LEFT JOIN u USING (x) LEFT JOIN m USING (id)),
f AS (SELECT *, x = '' OR row_number() OVER (PARTITION BY root ORDER BY doc_id, place) = 1 kept FROM t),
o AS (SELECT doc_id, text, count(*) n, count(*) FILTER (WHERE kept) k, string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE kept) s FROM f GROUP BY 1, 2)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_kept, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(s, '') END AS text FROM documents LEFT JOIN o USING (doc_id, text)
"""

#: The pages hold no canonical links or refreshes, so that rules alone decide.
URL_RULES = f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM p),
k(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) rule, arg_max(verdict, length(rh || rp)) verdict FROM h JOIN k ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)
"""

def _crc_table() -> str:
    """The table of crc32 by its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return str(out)


#: Near words share what is left without one code point at the same place, or one is what is left of the other.
SPELLING = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()}::BIGINT[] t),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) r FROM documents),
l AS (SELECT id, translate(r, '{_UPPER}', '{_LOWER}') r, count(*) c FROM d WHERE length(r) >= 7 GROUP BY 1, 2),
b AS (SELECT r, c, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || r, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)::BIGINT] ELSE [195::BIGINT, unicode(z)::BIGINT - 64] END))) b FROM l),
h AS (SELECT r, c, xor(list_reduce(b, lambda s, y: xor(t[CAST((xor(s, y) & 255) + 1 AS INT)], s >> 8)), 4294967295::BIGINT) h FROM b, t),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substring(r, 1, CAST(h % length(r) AS INT)) || substring(r, CAST(h % length(r) AS INT) + 2) ELSE r END word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) n FROM x WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
v AS (SELECT word, n, CAST(i AS INT) i, substring(word, 1, CAST(i AS INT) - 1) || substring(word, CAST(i AS INT) + 1) v FROM w, unnest(range(1, length(word) + 1)) r(i)),
e AS (SELECT a.word, b.word near, b.n near_n FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.v = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.v = w.word),
g AS (SELECT word, count(*) n_near, arg_min(near, (-near_n, near)) near, max(near_n) near_n FROM e GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) n_near, CASE WHEN near_n >= 10 * n THEN near END form, CASE WHEN near_n >= 10 * n THEN near_n END form_n FROM w LEFT JOIN g USING (word)),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL) USING (word)
"""

#: Pieces, their words, counts of 1 to 4 words; cuts with both parts' counts; what longer candidates mostly hold goes.
COLLOCATIONS = f"""
WITH p AS (SELECT lang, row_number() OVER () id, p FROM (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) p FROM documents)),
w AS (SELECT lang, id, regexp_extract_all(p, '[^\\x20\\x09]+') ws FROM p),
f AS (SELECT lang, k, array_to_string(ws[CAST(i AS INT):CAST(i AS INT) + k - 1], ' ') phrase, count(*) f FROM w, (VALUES (1), (2), (3), (4)) s(k), unnest(range(1, greatest(len(ws) - k + 2, 1))) r(i) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f) n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') ws, f a FROM f WHERE k > 1 AND f >= 30),
h AS (SELECT lang, array_to_string(ws[CAST(i AS INT):CAST(i AS INT) + m - 1], ' ') phrase, max(a) m FROM c, (VALUES (2), (3)) s(m), unnest(range(1, greatest(k - m + 2, 1))) r(i) WHERE m < k GROUP BY 1, 2),
e AS (SELECT c.* FROM c LEFT JOIN h USING (lang, phrase) WHERE h.m IS NULL OR 100 * h.m < 80 * a),
s AS (SELECT e.lang, e.phrase, e.a, j, l.f l, r.f r, CAST(e.a AS HUGEINT) * 2000000 // (l.f + r.f) score FROM e, unnest(range(1, e.k)) x(j), f l, f r WHERE l.lang = e.lang AND r.lang = e.lang AND l.k = j AND r.k = e.k - j AND l.phrase = array_to_string(e.ws[1:CAST(j AS INT)], ' ') AND r.phrase = array_to_string(e.ws[CAST(j AS INT) + 1:e.k], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m) JOIN n USING (lang) WHERE rank <= 2000
"""

SQL = {"op2_near_dup": NEAR_DUP, "op3_line_dedup": LINE_DEDUP, "op7_url_rules": URL_RULES, "op8_decontaminate": DECONTAMINATE, "op10_licences": LICENCES, "op11_spelling": SPELLING, "op12_jaccard_join": JACCARD_JOIN, "op13_collocations": COLLOCATIONS}
