"""The registered queries in DuckDB's SQL, with the operators' parameters. Stages of the pipeline take their SQL from the same builders."""

from __future__ import annotations

from shiftledger.llm import jaccard, merkle, mixing, negatives, pii, quality, substrings, urls, warc

W = r"[^\x20\x09-\x0D]"
S = r"[\x20\x09-\x0D]"


def lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_ctes(docs: str = "documents") -> str:
    """CTEs q_docs (with a row number rid) to q_judged, a row per row of ``docs``."""
    norm = f"regexp_replace(trim(regexp_replace({lower('l')}, '{S}+', ' ', 'g')), '[0-9]+', '0', 'g')"

    def limit(name: str) -> str:
        least, share = getattr(quality, name)
        return f"count(DISTINCT told) > greatest({least}, {share} // max(n))"

    def little(left: str) -> str:
        return f"({left} < {quality.MIN_LEFT_WORDS} OR 100 * ({left}) < {quality.MIN_LEFT_PERCENT} * n_words)"

    return f"""
q_docs AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {docs}),
q_words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
            FROM (SELECT rid, regexp_extract_all(t, '{W}+') AS ws FROM q_docs)),
q_windows AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g
              FROM q_words WINDOW o AS (PARTITION BY rid ORDER BY i)),
q_again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM q_windows
                                WHERE g IS NOT NULL) WHERE n > 1),
q_repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM q_again, range(3) r(k) GROUP BY rid),
q_lines AS (SELECT rid, pos, l, {norm} AS line, len(regexp_extract_all(l, '{W}+')) AS n
            FROM (SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos
                  FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM q_docs)) WHERE regexp_matches(l, '{W}')),
q_dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM q_lines GROUP BY rid),
q_whole AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS told FROM q_lines GROUP BY rid),
q_told AS (SELECT source, doc_id, line, n, told FROM q_lines JOIN q_whole USING (rid) JOIN q_docs USING (rid)),
q_all AS (SELECT line, min(doc_id) AS first FROM q_told GROUP BY line HAVING {limit("ALL_LIMITS")}),
q_often AS (SELECT source, line, CASE WHEN line IN (SELECT line FROM q_all) THEN (SELECT a.first FROM q_all a WHERE a.line = q_told.line)
            ELSE min(doc_id) END AS first FROM q_told GROUP BY source, line
            HAVING line IN (SELECT line FROM q_all) OR {limit("HOST_LIMITS")}),
q_found AS (SELECT rid, sum(n) AS n_found, sum(CASE WHEN doc_id = first THEN n ELSE 0 END) AS n_first
            FROM q_lines JOIN q_docs d USING (rid) JOIN q_often o
            ON q_lines.line = o.line AND d.source IS NOT DISTINCT FROM o.source GROUP BY rid),
q_counts AS (SELECT rid, len(regexp_extract_all(t, '{W}+')) AS n_words,
             length(regexp_replace(t, '{S}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_found, 0) AS n_found, coalesce(n_first, 0) AS n_first
             FROM q_docs LEFT JOIN q_dups USING (rid) LEFT JOIN q_repeats USING (rid) LEFT JOIN q_found USING (rid)),
q_judged AS (SELECT d.* EXCLUDE (t), c.* EXCLUDE (rid, n_found, n_first),
             n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
             n_found > 0 AND {little("n_words - n_found")} AS depleted,
             depleted AND NOT {little("n_words - n_found + n_first")} AS first_of_copies,
             CASE WHEN first_of_copies THEN 0 ELSE n_found END AS n_removed,
             NOT base_failed AND (first_of_copies OR NOT depleted) AS kept
             FROM q_docs d JOIN q_counts c USING (rid))"""


def mixing_ctes(docs: str = "documents") -> str:
    """CTEs m_docs to m_mixed, a row per row of ``docs``."""
    values = ", ".join(str(w) for w in mixing.WEIGHTS)
    return f"""
m_docs AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{W}+')) AS size,
           ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 9))::BIGINT AS h
           FROM {docs}),
m_sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM m_docs GROUP BY source),
m_ranked AS (SELECT *, [{values}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]
             AS weight, {mixing.MAX_REPEATS} * source_size AS cap FROM m_sources),
m_levels AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
             (sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM m_ranked),
m_capped AS (SELECT *, cap <= CAST(weight * lft AS DOUBLE) / CAST(rest AS DOUBLE) AS capped FROM m_levels),
m_first AS (SELECT lft AS lft1, rest AS rest1 FROM m_capped WHERE NOT capped ORDER BY ratio, source NULLS LAST LIMIT 1),
m_targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * lft1 AS DOUBLE) / CAST(rest1 AS DOUBLE) END AS target
              FROM m_capped LEFT JOIN m_first ON true),
m_rounds AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds,
             target - rounds * source_size AS budget FROM m_targets),
m_hashes AS (SELECT d.source, h, sum(size) AS size FROM m_docs d GROUP BY ALL),
m_upto AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM m_hashes),
m_taken AS (SELECT u.source, h, upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size)) AS more
            FROM m_upto u JOIN m_rounds r ON u.source IS NOT DISTINCT FROM r.source),
m_mixed AS (SELECT d.* EXCLUDE (h), source_size, target, rounds + CAST(more AS BIGINT) AS repeats,
            size * (rounds + CAST(more AS BIGINT)) AS taken
            FROM m_docs d JOIN m_rounds r ON d.source IS NOT DISTINCT FROM r.source
            JOIN m_taken k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h)"""


def url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in urls.RULES)
    return f"""
WITH parts AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT rid, page_id, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT rid, rh || rp AS rule, action, length(rh || rp) AS n, length(rh) AS nh
  FROM split, (VALUES {rules}) r(rh, rp, action)
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT rid, first(rule ORDER BY n DESC, nh DESC, action DESC) AS rule,
  first(action ORDER BY n DESC, nh DESC, action DESC) AS action FROM fits GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, '{urls.DEFAULT}') AS verdict FROM split LEFT JOIN best USING (rid)"""


def jaccard_sql() -> str:
    n, percent = jaccard.N_WORDS, jaccard.PERCENT
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all({lower("coalesce(text, '')")}, '{W}+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS shingle FROM d),
sizes AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS meet FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.rid = x JOIN sizes b ON b.rid = y
  WHERE 100 * meet >= {percent} * (a.n + b.n - meet)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT reach.x, steps.y FROM reach JOIN steps ON reach.y = steps.x),
low AS (SELECT reach.x AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN low USING (rid) LEFT JOIN sizes USING (rid)"""


def pii_sql() -> str:
    """Base spans and terms; positions are the lengths of what stands before, added up."""
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        r"[0-9](?:[\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )

    def found(k: int, pattern: str) -> str:
        step = f"(?s)(.*?)({pattern})"
        return f"""SELECT rid, {k} AS k, unnest(regexp_extract_all(t, '{step}', 0)) AS step,
          unnest(regexp_extract_all(t, '{step}', 2)) AS v, unnest(range(len(regexp_extract_all(t, '{step}', 2)))) AS i FROM d"""

    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN"
        f" CAST(reverse({digits})[i] AS INTEGER) ELSE CAST(reverse({digits})[i] AS INTEGER) * 2"
        f" - CASE WHEN CAST(reverse({digits})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    )
    everything = " UNION ALL ".join(found(k, x) for k, x in enumerate((*patterns, r"\p{L}+")))
    term = r"\p{L}+"
    names = "['" + "', '".join((*pii.KINDS, "term")) + "']"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({everything}),
placed AS (SELECT rid, k, v, sum(length(step)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM raw),
valid AS (SELECT rid, k, v, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE CASE k
  WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0
  WHEN 2 THEN length({digits}) BETWEEN 14 AND 19 AND {luhn}
  WHEN 3 THEN length({digits}) BETWEEN 10 AND 15
  ELSE true END),
base AS (SELECT * FROM valid WHERE k < 4),
sides AS (SELECT t, CASE k WHEN 0 THEN '0:' || {lower("v")} WHEN 1 THEN '1:' || v ELSE k || ':' || {digits} END AS entity,
  regexp_replace(CASE WHEN s > {pii.NEAR} THEN regexp_replace(t[s - {pii.NEAR} + 1:s], '^\p{{L}}+', '') ELSE t[1:s] END, '\p{{L}}+$', '')
  || chr(32) || chr(10) || chr(32) ||
  regexp_replace(CASE WHEN e + {pii.NEAR} < length(t) THEN regexp_replace(t[e + 1:e + {pii.NEAR}], '\p{{L}}+$', '') ELSE t[e + 1:] END, '^\p{{L}}+', '') AS around
  FROM base JOIN d USING (rid)),
near AS (SELECT DISTINCT entity, around, hash(t) AS key, unnest(regexp_extract_all({lower("around")}, '{term}')) AS term FROM sides),
pairs AS (SELECT entity, term, least(count(DISTINCT around), count(DISTINCT key)) AS meet FROM near
  GROUP BY entity, term HAVING meet >= {pii.MIN_CONTEXTS}),
entities AS (SELECT entity, least(count(DISTINCT around), count(DISTINCT key)) AS of_entity FROM near GROUP BY entity),
terms AS (SELECT {lower("v")} AS term, count(DISTINCT rid) AS of_term FROM valid WHERE k = 4 GROUP BY ALL),
flagged AS (SELECT DISTINCT term FROM pairs JOIN entities USING (entity) JOIN terms USING (term),
  (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
  WHERE ln(n / of_entity) > 0 AND ln(meet * n / (of_entity * of_term)) >= {pii.THRESHOLD} * ln(n / of_entity)),
said AS (SELECT * FROM valid WHERE k = 4 AND {lower("v")} IN (SELECT term FROM flagged)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = valid.rid AND b.s < valid.e AND valid.s < b.e)),
spans AS (SELECT rid, k, s, e, {names}[k + 1] || ':' || s || ':' || e AS span FROM base
  UNION ALL SELECT rid, k, s, e, {names}[k + 1] || ':' || s || ':' || e FROM said),
told AS (SELECT rid, string_agg(span, ',' ORDER BY s, k, e) AS spans, string_agg(span, ',' ORDER BY s, k, e) FILTER (k < 4) AS base_spans,
  {", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, name in enumerate((*pii.KINDS, "term")))} FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in (*pii.KINDS, "term"))},
sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)"""


def warc_sql() -> str:
    hex5 = "('0x' || substr(x, {}, 5))::BIGINT"
    parts = " || ".join(f"lpad(upper(to_base({hex5.format(1 + 5 * k)}, 32)), 4, '0')" for k in range(8))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, translate({parts}, '{warc.BASE32_HEX}', '{warc.BASE32}') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


def negatives_sql() -> str:
    return f"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
  CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT * FROM rows WHERE vec_id % 100 = 0) a JOIN rows b ON a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10"""


def merkle_sql(levels: int = 16, group_levels: int = 8) -> str:
    """Each level of the trees as one grouping; ``levels`` and ``group_levels`` are above any level with several nodes."""

    def field(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if name == 'text' else name) for name in merkle.FIELDS)})"

    def tree(name: str, nodes: str, count: int) -> str:
        """CTEs of the levels (grp, rank, n, x), and of the ways (grp, rank, steps, root) of ``nodes``."""
        r, parts = merkle.RADIX, [f"{name}0 AS MATERIALIZED (SELECT grp, rank, n, x FROM {nodes})"]
        for k in range(count):
            parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT grp, rank // {r} AS rank, (any_value(n) + {r - 1}) // {r} AS n,
  CASE WHEN any_value(n) = 1 THEN any_value(x) ELSE sha256(string_agg(x, '' ORDER BY rank)) END AS x FROM {name}{k} GROUP BY grp, rank // {r})""")
        sides = "\n  UNION ALL ".join(
            f"SELECT a.grp, a.rank, {k} AS level, coalesce(string_agg(b.x, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS lft,"
            f" coalesce(string_agg(b.x, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS rgt"
            f" FROM {name}{k} a JOIN {name}{k} b ON a.grp = b.grp AND a.rank // {r} = b.rank // {r} WHERE a.n > 1 GROUP BY ALL"
            for k in range(count)
        )
        parts.append(f"{name}sides AS MATERIALIZED ({sides})")
        places = f"(SELECT grp, rank, unnest(range({count})) AS level FROM {nodes})"
        parts.append(f"""{name}ways AS (SELECT l.grp, l.rank, list({{'lft': lft, 'rgt': rgt}} ORDER BY l.level) AS steps
  FROM {places} l JOIN {name}sides s ON s.grp = l.grp AND s.level = l.level AND s.rank = l.rank // CAST(power({r}, l.level) AS BIGINT)
  GROUP BY l.grp, l.rank)""")
        return ",\n".join(parts)

    crc = """list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), CAST(4294967295 AS BIGINT))"""
    return f"""
WITH d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS grp, {leaf("text")} AS x,
  CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS y
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, x) - 1 AS rank,
  count(*) OVER (PARTITION BY grp) AS n FROM d),
{tree("a", "leaves", levels)},
groups AS MATERIALIZED (SELECT 0 AS grp, grp - 1 AS rank, count(*) OVER () AS n, x FROM a{levels}),
{tree("b", "groups", group_levels)},
told AS (SELECT l.*, g.x AS subroot, r.x AS root, coalesce(w.steps, []) || coalesce(v.steps, []) AS steps
  FROM leaves l JOIN groups g ON g.rank = l.grp - 1 CROSS JOIN b{group_levels} r
  LEFT JOIN aways w ON w.grp = l.grp AND w.rank = l.rank LEFT JOIN bways v ON v.rank = l.grp - 1),
done AS (SELECT *, list_reduce(list_transform(steps, lambda s: [s.lft, s.rgt]), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''], [y, '']) AS f FROM told)
SELECT doc_id, x AS leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.lft || s.rgt), ''), '')) AS proof_sha256,
f[1] AS folded_root, f[1] = root AS verified FROM done"""


def substrings_sql() -> str:
    """Every string of every text, in hexadecimal digits."""
    n = substrings.LENGTH
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, p, substr(x, 2 * p + 1, {2 * n}) AS g
  FROM (SELECT *, unnest(range(length(x) // 2 - {n - 1})) AS p FROM d WHERE length(x) >= {2 * n})),
hits AS (SELECT rid, p FROM w JOIN (SELECT g, min(doc_id) AS low FROM w GROUP BY g) USING (g) WHERE low < doc_id),
marked AS (SELECT rid, p, coalesce(p - lag(p) OVER o > {n}, true) AS new FROM hits WINDOW o AS (PARTITION BY rid ORDER BY p)),
numbered AS (SELECT rid, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY rid ORDER BY p) AS k FROM marked),
spans AS (SELECT rid, k, min(p) AS s, max(p) + {n} AS e FROM numbered GROUP BY ALL),
gaps AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY k), 0) AS after FROM spans),
told AS (SELECT rid, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, max(e) AS last_end,
  string_agg(substr(x, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS head FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN told USING (rid)"""


SQL = {
    "op1_pii": pii_sql(),
    "op3_url_filters": url_sql(),
    "op7_quality_rules": f"""WITH {quality_ctes()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
CAST(n_removed AS BIGINT) AS n_removed, kept FROM q_judged""",
    "op4_ngram_jaccard": jaccard_sql(),
    "op9_warc": warc_sql(),
    "op11_hard_negatives": negatives_sql(),
    "op12_merkle_manifest": merkle_sql(),
    "op13_substring_dedup": substrings_sql(),
    "op8_mixing": f"""WITH {mixing_ctes()}
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, repeats FROM m_mixed""",
}
