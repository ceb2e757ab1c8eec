"""DuckDB SQL of the operators whose whole method SQL can express, other than short ones in the registry."""

from __future__ import annotations

from citeline.llm import pii

_FROM = pii.CAPITALS + pii.PUNCTUATION
_TO = pii.CAPITALS.lower() + " " * len(pii.PUNCTUATION)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(text: str) -> str:
    return f"translate({text}, {_literal(_FROM)}, {_literal(_TO)})"


_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)
_SPACE = r"[\x20\x09-\x0D]"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER)
  ELSE CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_WORDS = f"list_filter(string_split_regex({{x}}, '{_SPACE}'), lambda w: w <> '')"

#: Base spans, evidence in whole texts, disclosure, and the spans of disclosing terms.
PII = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(f"SELECT rid, t, {k} AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM d" for k, p in enumerate(_PATTERNS))}),
s0 AS (SELECT rid, t, kind, h[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM m, range(1, len(h) + 1) r(i)),
s AS (SELECT rid, t, kind, v, a, a + length(v) AS b FROM s0 WHERE CASE kind WHEN 1 THEN regexp_full_match(v, '{pii.OCTET}(\\.{pii.OCTET}){{3}}') WHEN 2 THEN length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN} WHEN 3 THEN length({_DIGITS}) BETWEEN 8 AND 15 ELSE true END),
en AS (SELECT DISTINCT t, unnest([['email', 'ip', 'card', 'phone'][kind + 1], ['email', 'ip', 'card', 'phone'][kind + 1] || ':' || lower(v)]) AS entity FROM s),
ne AS (SELECT entity, count(*) AS n_entity FROM en GROUP BY entity HAVING count(*) >= 3),
wd AS (SELECT DISTINCT t, unnest(string_split_regex({plain(f"regexp_replace(t, '{_PATTERNS[0]}', ' ', 'g')")}, '{_SPACE}')) AS term FROM d),
p AS (SELECT * FROM wd WHERE length(term) >= 3 AND NOT contains(term, '@') AND NOT regexp_matches(term, '^[0-9+-]+$')),
nb AS (SELECT entity, term, count(*) AS n_both FROM en JOIN ne USING (entity) JOIN p USING (t) GROUP BY ALL HAVING count(*) >= 3),
nt AS (SELECT term, count(*) AS n_term FROM p GROUP BY term),
c AS (SELECT count(DISTINCT t) AS n FROM d),
f AS (SELECT entity, term FROM nb JOIN ne USING (entity) JOIN nt USING (term), c WHERE ln(n_both * n / (n_term * n_entity)) / greatest(ln(n / n_entity), 1e-9) >= 0.9),
tk AS (SELECT rid, t, string_split_regex({plain("t")}, '{_SPACE}') AS ws FROM d WHERE EXISTS (SELECT 1 FROM f)),
ts AS (SELECT rid, t, ws[i] AS v, CAST(coalesce(list_sum(list_transform(ws[1:i - 1], lambda q: length(q) + 1)), 0) AS BIGINT) AS a FROM tk, range(1, len(ws) + 1) r(i) WHERE ws[i] IN (SELECT term FROM f)),
tt AS (SELECT rid, v, a, a + length(v) AS b FROM ts WHERE (v IN (SELECT term FROM f WHERE contains(entity, ':')) OR EXISTS (SELECT 1 FROM en JOIN f USING (entity) WHERE en.t = ts.t AND f.term = ts.v)) AND NOT EXISTS (SELECT 1 FROM s WHERE s.rid = ts.rid AND s.a < ts.a + length(ts.v) AND s.b > ts.a)),
al AS (SELECT rid, kind, ['email', 'ip', 'card', 'phone'][kind + 1] AS name, a, b FROM s UNION ALL SELECT rid, 4, 'term', a, b FROM tt),
o AS (SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
 coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY kind, a) FILTER (kind < 4), '') AS base, string_agg(name || ':' || a || ':' || b, ',' ORDER BY kind, a) AS spans FROM al GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)"""


def url_filter() -> str:
    """Rules, both models with their held-out halves, and the calibrated threshold."""
    from citeline.llm import url_filter as u

    ordered = sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    first = lambda i: sorted({r[i] for r in u.RULES}, key=lambda x: (-len(x), x))
    bare_host = "CASE " + " ".join(f"WHEN host = '{x}' OR ends_with(host, '.{x}') THEN left(host, length(host) - {len(x)})" for x in first(1)) + " ELSE host END"
    bare_path = "CASE " + " ".join(f"WHEN starts_with(path, '{x}') THEN substr(path, {len(x) + 1})" for x in first(2)) + " ELSE path END"
    kinds = [x for pair in u.MODELS for x in pair]
    inside = ", ".join(f"count(*) FILTER (v = '{'allow' if x[0] == 'a' else 'block'}'{f' AND half <> {x[1]}' if len(x) > 1 else ''}) AS {x}" for x in kinds)
    orders = []
    for k in range(1, u.ORDER + 1):
        low = {x: f"l.q{x}" if k > 1 else "1 / 256" for x in kinds}
        orders.append(f"""own{k} AS (SELECT right(g, {k}) AS g, left(right(g, {k}), {k - 1}) AS c, right(g, {k - 1}) AS s, {", ".join(f"sum({x}) AS {x}" for x in kinds)} FROM top GROUP BY 1, 2, 3),
sums{k} AS (SELECT c, {", ".join(f"sum({x}) AS n{x}, count(*) FILTER ({x} > 0) AS t{x}" for x in kinds)} FROM own{k} GROUP BY c),
q{k} AS (SELECT o.g, {", ".join(f"CASE WHEN n{x} > 0 THEN (o.{x} + t{x} * {low[x]}) / (n{x} + t{x}) ELSE {low[x]} END AS q{x}" for x in kinds)} FROM own{k} o JOIN sums{k} USING (c){f" JOIN q{k - 1} l ON l.g = o.s" if k > 1 else ""})""")
    gram = f"substr(repeat(chr(2), {u.ORDER - 1}) || line || chr(3), i, {u.ORDER})"
    newline = ",\n"
    return f"""WITH p0 AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
rows_ AS (SELECT page_id, host, path, {name} AS rule, {verdict} AS v FROM p1),
known AS (SELECT DISTINCT host, path, v, {bare_host} || '/' || {bare_path} AS line, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % 2 AS half FROM rows_ WHERE host <> ''),
once AS (SELECT DISTINCT host, half, v, {gram} AS g FROM known, range(1, length(line) + 2) r(i)),
top AS (SELECT g, {inside} FROM once GROUP BY g),
{newline.join(orders)},
sc AS (SELECT host, path, v, avg(CASE WHEN v IS NULL THEN ln(qr / qa) WHEN half = 0 THEN ln(qr0 / qa0) ELSE ln(qr1 / qa1) END) AS score FROM known, range(1, length(line) + 2) r(i) JOIN q{u.ORDER} ON g = {gram} GROUP BY ALL),
lim AS (SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(0.0, a, b) END AS cutoff FROM (SELECT quantile_disc(score, 0.999) FILTER (v = 'allow') AS a, quantile_disc(score, 0.999) FILTER (v = 'block') AS b FROM sc))
SELECT page_id, host, path, rule, coalesce(rows_.v, CASE WHEN host = '' THEN 'allow' WHEN score > cutoff THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score, round(cutoff, 6) AS threshold
FROM rows_ LEFT JOIN (SELECT host, path, score FROM sc) USING (host, path), lim"""
