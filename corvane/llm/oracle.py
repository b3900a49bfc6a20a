"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from corvane.llm import urls
from corvane.llm.common import LOWER, UPPER
from corvane.llm.queries import RULES


def _lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def _lines() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) i, unnest(ls) line FROM d),
k AS (SELECT *, {_lower(f"trim(line, {blanks})")} AS key FROM l),
f AS (SELECT key AS frequent FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) n_lines, count(frequent) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (frequent IS NULL), '')) kept_sha256
FROM k LEFT JOIN f ON key = frequent GROUP BY doc_id"""


def _passages() -> str:
    words = rf"coalesce(regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""WITH d AS (SELECT doc_id, {words} ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) n FROM (SELECT item_id, {words} ws FROM benchmark) WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') pattern
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) i FROM b)),
w AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') pattern
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, n, i FROM w JOIN p USING (n, pattern)),
c AS (SELECT doc_id, count(DISTINCT place) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _urls() -> str:
    order = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN" for r in order]
    rule = "CASE " + " ".join(f"{f} '{r.name}'" for f, r in zip(fits, order)) + " END"
    said = "CASE " + " ".join(f"{f} '{r.verdict}'" for f, r in zip(fits, order)) + " END"

    def found(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"

    strict, soft = (" + ".join(map(found, terms)) for terms in (urls.STRICT, urls.SOFT))
    return rf"""WITH u AS (SELECT page_id, {_lower("coalesce(url, '')")} low,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT *, {_lower("regexp_extract(rest, '^[^/?#]*')")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({said}, CASE WHEN {strict} > 0 OR {soft} >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) verdict FROM p"""


def _archive() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') body, sha1(coalesce(html, '')) digest FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(digest, ''),
  lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') bits FROM p),
t AS (SELECT page_id, octet_length(encode(body)) payload_bytes, min(page_id) OVER (PARTITION BY digest) origin,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, i + 1, 1)::INT + 8 * substr(bits, i + 2, 1)::INT + 4 * substr(bits, i + 3, 1)::INT
    + 2 * substr(bits, i + 4, 1)::INT + substr(bits, i + 5, 1)::INT, 1)), '') payload_digest FROM b)
SELECT page_id, payload_bytes::BIGINT payload_bytes, payload_digest, CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN origin <> page_id THEN origin END refers_to FROM t"""


def _divergence() -> str:
    terms = rf"regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
    share = "1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * v)"
    far = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
    return rf"""WITH d AS (SELECT row_number() OVER () rid, coalesce(lang, '') lang, coalesce(source, '') source, {terms} ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(ws) term FROM d),
k AS (SELECT lang, term, count(*) total FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) v, sum(total) lang_n FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, k.total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) group_n FROM a GROUP BY ALL),
p AS (SELECT lang, source, term, n, {share.format("n", "group_n")} p, {share.format("total", "lang_n")} q
  FROM a JOIN s USING (lang, source) JOIN v USING (lang)),
m AS (SELECT x.lang, x.source, y.source item, sum({far.format("x.p", "y.p")}) value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' part, y.source item, coalesce(value, 0)::BIGINT value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN m ON m.lang = x.lang AND m.source = x.source AND m.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ({far.format("p", "q")})::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT "rank" FROM r
QUALIFY part = 'pair' OR "rank" <= 10"""


def _search() -> str:
    def words(c: str) -> str:
        return rf"regexp_extract_all({_lower(f"coalesce({c}, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

    return rf"""WITH d AS (SELECT * FROM (SELECT row_number() OVER () rid, doc_id, {words("text")} ws FROM documents) WHERE len(ws) > 0),
s AS (SELECT count(*) docs, sum(len(ws))::BIGINT total FROM d),
q AS (SELECT DISTINCT item_id, unnest({words("text")}) term FROM benchmark),
t AS (SELECT rid, term, count(*) tf FROM (SELECT rid, unnest(ws) term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT weight FROM t, s GROUP BY term, docs),
m AS (SELECT rid, doc_id, 10 + (90 * len(ws) * docs) // total factor FROM d, s),
r AS (SELECT item_id, rid, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * factor)))::BIGINT score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT "rank", doc_id, score
FROM r JOIN m USING (rid) QUALIFY "rank" <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": _archive(),
        "op4_line_dedup": _lines(),
        "op5_decontam": _passages(),
        "op7_url_filter": _urls(),
        "op11_divergence": _divergence(),
        "op13_ranked": _search(),
    }
