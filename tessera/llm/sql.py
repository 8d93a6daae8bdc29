"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import license_scan, pii, secret_scan

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = {
    "op2_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS gram
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, w[i : i + n - 1] AS gram
       FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
       string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_source_mix": r"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      1 - pow((('0x' || substr(md5('mix-1/' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496, 1 / coalesce(weight, 1.0::DOUBLE)) AS place
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (sum(size) OVER () - 3 * coalesce(sum(size) OVER (ORDER BY size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
v AS (SELECT min_by(level, size::DOUBLE / weight) AS level FROM l WHERE weight * level <= 3 * size),
t AS (SELECT source, size AS source_size, least(3.0::DOUBLE * size, weight * v.level) AS target FROM l, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(least(size, rest - before), 0))::BIGINT AS taken FROM p""",
    "op13_source_divergence": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS terms, sum(total) AS size FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
shares AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
  (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (sizes.size + langs.terms))::HUGEINT AS p,
  (1 + (1000000000::HUGEINT * (kept.total + 1)) // (langs.size + langs.terms))::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) JOIN sizes USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "token_rollup": f"""
WITH d AS (SELECT source, lang, CASE WHEN lang = 'en' THEN len({_WORDS}) ELSE len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) END AS n FROM documents)
SELECT source, lang, 'mixed' AS tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens
FROM d WHERE NOT coalesce(source = 'src1' AND lang <> 'en', false) GROUP BY source, lang""",
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql(k: int = license_scan.K, min_cover: float = license_scan.MIN_COVER, max_shift: int = license_scan.MAX_SHIFT) -> str:
    """Votes of equal k-grams, summed by diagonal; runs of near diagonals; spans; documents."""
    templates = [(*x, True) for x in license_scan.PHRASES] + [(*x, False) for x in license_scan.NOTICES]
    rows = ",\n".join(f"({n}, {_text(label)}, {exact}, string_split({_text(text)}, ' '))" for n, (text, label, exact) in enumerate(templates))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t(template, label, exact, words) AS (VALUES {rows}),
g AS (SELECT template, label, exact, len(words) AS n, q, words[q + 1 : q + {k}] AS gram FROM t, unnest(range(len(words) - {k - 1})) AS s(q)),
v AS (SELECT r, p, w[p + 1 : p + {k}] AS gram FROM d, unnest(range(len(w) - {k - 1})) AS s(p)),
diag AS (SELECT r, template, label, exact, n, p - q AS diagonal, min(p) AS low, max(p) AS high, list(DISTINCT q) AS found FROM v JOIN g USING (gram) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER o <= {max_shift} THEN 0 ELSE 1 END AS fresh FROM diag WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM steps),
spans AS (SELECT r, label, exact, n, min(low) AS start, max(high) + {k} - min(low) AS width, len(list_distinct(flatten(list_transform(flatten(list(found)), lambda q: range(q, q + {k}))))) / n::DOUBLE AS cover
  FROM runs GROUP BY r, template, label, exact, n, run),
judged AS (SELECT *, CASE WHEN exact THEN cover = 1 ELSE cover >= {min_cover}::DOUBLE AND width <= 1.5 * n END AS accepted FROM spans)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (exact AND accepted) AS n_base,
  min(start) FILTER (exact AND accepted) AS first_word, max(start) FILTER (exact AND accepted) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND accepted), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (accepted), '') AS labels, coalesce(max(cover), 0) AS score
FROM d LEFT JOIN judged USING (r) GROUP BY r"""


def secret_sql(max_owners: int = secret_scan.MAX_OWNERS, max_repos: int = secret_scan.MAX_REPOS, min_chars: int = secret_scan.MIN_CHARS) -> str:
    """Matches and the gaps between them, from which places follow; owners of each value."""
    found = "\nUNION ALL ".join(
        f"SELECT r, owner, sha256(text) AS digest, {n} AS kind_order, {_text(kind)} AS kind, {base} AS base, {least} AS least, string_split_regex(text, {_text(pattern)}) AS gaps,"
        f" regexp_extract_all(text, {_text(pattern)}, 0) AS matches, regexp_extract_all(text, {_text(pattern)}, {group}) AS vals FROM d WHERE regexp_matches(text, {_text(pattern)})"
        for n, (kind, pattern, group, least, base) in enumerate(secret_scan.KINDS)
    )
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)::BIGINT"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS text FROM documents),
found AS ({found}),
spans AS (SELECT r, owner, digest, kind_order, kind, base, {total('gaps[1:i]')} + {total('matches[1:i - 1]')} AS start, length(matches[i]) AS width, vals[i] AS val
  FROM found, unnest(range(1, len(matches) + 1)) AS s(i) WHERE length(vals[i]) >= least),
once AS (SELECT val, digest, min(owner) AS owner FROM spans GROUP BY val, digest),
owned AS (SELECT val, count(DISTINCT owner) AS n_owners, count(*) AS n_repos FROM once GROUP BY val),
judged AS (SELECT r, kind_order, kind, base, start, kind || ':' || start || ':' || (start + width) AS name, n_owners, n_repos,
  n_owners > {max_owners} OR n_repos > {max_repos} AS example, NOT example AND len(list_distinct(string_split(val, ''))) >= {min_chars} AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
  AND NOT regexp_matches(val, '(?i)example|sample|changeme|placeholder|dummy|xxxx|1234567') AS live FROM spans JOIN owned USING (val))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY start, kind_order) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY start, kind_order) FILTER (base OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example,
  coalesce(max(n_owners), 0) AS max_owners, coalesce(max(n_repos), 0) AS max_repos
FROM d LEFT JOIN judged USING (r) GROUP BY r"""


def pii_sql() -> str:
    """Matches and the gaps between them, checks of each kind, and words near a span."""
    digits = r"list_transform(regexp_extract_all(match, '[0-9]'), lambda x: x::INT)"
    luhn = f"list_sum(list_transform(list_reverse({digits}), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x < 5 THEN 2 * x ELSE 2 * x - 9 END)) % 10 = 0"
    turned = "replace(match, ' ', '')"
    value = "CASE WHEN x BETWEEN '0' AND '9' THEN x::INT ELSE ascii(x) - 55 END"
    mod97 = f"list_reduce(list_transform(string_split({turned}[5:] || {turned}[:4], ''), lambda x: {value}), lambda a, x: CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END % 97, 0) = 1"
    kinds = (  # kind, pattern, check of a match
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"len({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 10 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"length({turned}) BETWEEN 15 AND 34 AND {mod97}"),
        ("ssn", r"[0-9-]+", "regexp_full_match(match, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND match[:3] NOT IN ('000', '666') AND match[:3] < '900' AND match[5:6] <> '00' AND match[8:] <> '0000'"),
    )
    listed = lambda xs: "[" + ", ".join(map(_text, xs)) + "]"
    found = "\nUNION ALL ".join(
        f"SELECT r, text, {n} AS kind_order, {_text(kind)} AS kind, {pii.SCORES[kind]}::DOUBLE AS plain, {listed(pii.RAISE[kind])} AS up,"
        f" string_split_regex(text, {_text(pattern)}) AS gaps, regexp_extract_all(text, {_text(pattern)}, 0) AS matches FROM d WHERE regexp_matches(text, {_text(pattern)})"
        for n, (kind, pattern, _) in enumerate(kinds)
    )
    checks = " ".join(f"WHEN {_text(kind)} THEN {check}" for kind, _, check in kinds)
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)::BIGINT"
    base = "kind_order < 4"
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in kinds[:4])
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT r, text, kind_order, kind, plain, up, matches[i] AS match, {total('gaps[1:i]')} + {total('matches[1:i - 1]')} AS start FROM found, unnest(range(1, len(matches) + 1)) AS s(i)),
checked AS (SELECT *, regexp_extract_all(lower(text[greatest(start - {pii.NEAR}, 0) + 1 : start]), '[a-z-]+') AS near FROM placed WHERE CASE kind {checks} END),
scored AS (SELECT r, kind_order, kind, start, kind || ':' || start || ':' || (start + length(match)) AS name,
  least(1, greatest(0, plain + {pii.STEP}::DOUBLE * (list_has_any(near, up)::INT - list_has_any(near, {listed(pii.LOWER)})::INT))) AS score FROM checked),
kept AS (SELECT * FROM scored WHERE {base} OR score >= {pii.LEAST}::DOUBLE)
SELECT any_value(doc_id) AS doc_id, {count}, sha256(coalesce(string_agg(name, ',' ORDER BY start, kind_order) FILTER ({base}), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY start, kind_order), '') AS spans, coalesce(max(score), 0) AS pii_score
FROM d LEFT JOIN kept USING (r) GROUP BY r"""


SQL |= {"op1_license_scan": license_sql(), "op5_secret_scan": secret_sql(), "op8_pii": pii_sql()}
