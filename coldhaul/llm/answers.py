"""Answers in SQL for the queries that SQL can express, over the same tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_QUALITY = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] AS w,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
counts AS (SELECT w.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_symbols // word_chars END AS symbols,
    CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END AS dups,
    CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END AS repeats,
    CASE WHEN n_words = 0 THEN 0 ELSE 100 * word_chars // n_words END AS centi FROM counts),
long AS (SELECT lang, source, m, v, greatest(0, length(bin(v)) - 6) AS e
  FROM (UNPIVOT (SELECT lang, source, symbols, dups, repeats, centi, word_chars, n_lines, n_words FROM judged WHERE NOT base_failed)
    ON symbols, dups, repeats, centi, word_chars, n_lines, n_words INTO NAME m VALUE v)),
cells AS (SELECT lang, source, m, (v >> e) << e AS b, count(*) AS n FROM long GROUP BY ALL),
levels AS (SELECT 0 AS lv, lang, source, m, b, n FROM cells
  UNION ALL SELECT 1, lang, NULL, m, b, sum(n) FROM cells GROUP BY lang, m, b
  UNION ALL SELECT 2, NULL, NULL, m, b, sum(n) FROM cells GROUP BY m, b),
reached AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, m ORDER BY b) AS upto,
  sum(n) OVER (PARTITION BY lv, lang, source, m) AS docs FROM levels),
q AS (SELECT lv, lang, source, m, min(b) FILTER (WHERE upto * 100 >= docs * 25) AS q25,
    min(b) FILTER (WHERE upto * 100 >= docs * 50) AS q50, min(b) FILTER (WHERE upto * 100 >= docs * 75) AS q75
  FROM reached GROUP BY lv, lang, source, m HAVING max(docs) >= 50),
picked AS (SELECT g.lang, g.source, g.m, coalesce(a.q25, b.q25, c.q25) AS q25,
    coalesce(a.q50, b.q50, c.q50) AS q50, coalesce(a.q75, b.q75, c.q75) AS q75
  FROM (SELECT DISTINCT lang, source, m FROM cells) g
  LEFT JOIN q a ON a.lv = 0 AND a.m = g.m AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source
  LEFT JOIN q b ON b.lv = 1 AND b.m = g.m AND b.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN q c ON c.lv = 2 AND c.m = g.m),
sides AS (SELECT lang, source, m, q25, q50, q75, greatest(1, max(CASE WHEN m = 'word_chars' THEN q50 END) OVER g) AS chars,
    greatest(1, max(CASE WHEN m = 'n_lines' THEN q50 END) OVER g) AS lines,
    greatest(1, max(CASE WHEN m = 'n_words' THEN q50 END) OVER g) AS words
  FROM picked WINDOW g AS (PARTITION BY lang, source)),
bounds AS (SELECT lang, source,
    max(CASE WHEN m = 'symbols' THEN q50 + greatest(6 * (q50 - q25), 6 * q50 // 32, 20000 // chars) END) AS symbols_to,
    max(CASE WHEN m = 'dups' THEN q50 + greatest(6 * (q50 - q25), 6 * q50 // 32, 3000 // lines) END) AS dups_to,
    max(CASE WHEN m = 'repeats' THEN q50 + greatest(6 * (q50 - q25), 6 * q50 // 32, 36000 // words) END) AS repeats_to,
    max(CASE WHEN m = 'centi' THEN q50 + greatest(6 * (q50 - q25), 6 * q50 // 32) END) AS centi_to,
    max(CASE WHEN m = 'centi' THEN q50 - greatest(6 * (q75 - q50), 6 * q50 // 32) END) AS centi_from
  FROM sides GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= symbols_to, true) AND coalesce(dups <= dups_to, true)
    AND coalesce(repeats <= repeats_to, true) AND coalesce(centi <= centi_to, true)
    AND coalesce(centi >= centi_from, true) AS kept
FROM judged j LEFT JOIN bounds b ON j.lang IS NOT DISTINCT FROM b.lang AND j.source IS NOT DISTINCT FROM b.source
"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
grams AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
found AS (SELECT rid, item, grams.k AS k, i FROM grams JOIN phrases USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
    [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS draws FROM d),
cuts AS (SELECT *, len(units) AS n, least(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS a,
    greatest(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS b FROM u),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draws[3] % 100 >= 90 THEN 'plain'
      WHEN draws[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
terms AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM terms GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (coalesce(t.total, 0) + 2 * v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (in_lang + 2) // (langs.total + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""

_EARLIER = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS place,
    hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT rid, place, i, substr(x, 2 * i + 1, 100) AS g
  FROM (SELECT rid, place, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
firsts AS (SELECT g, min(place) AS first FROM windows GROUP BY g HAVING min(place) < max(place)),
hits AS (SELECT rid, i FROM windows JOIN firsts USING (g) WHERE first < place),
marked AS (SELECT rid, i, CASE WHEN i > lag(i, 1, -99) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM hits),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY rid, run),
kept AS (SELECT rid, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS a, a AS b FROM spans
  UNION ALL SELECT rid, coalesce(max(spans.b), 0), max(length(x) // 2) FROM d LEFT JOIN spans USING (rid) GROUP BY rid),
rest AS (SELECT rid, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS x
  FROM kept JOIN d USING (rid) GROUP BY rid),
removed AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans FROM spans GROUP BY rid)
SELECT doc_id, length(d.x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(rest.x)) AS kept_sha256
FROM d JOIN rest USING (rid) LEFT JOIN removed USING (rid)
"""

ANSWERS: dict[str, str] = {
    "op2_quality_rules": _QUALITY,
    "op5_decontamination": _DECONTAMINATION,
    "op11_source_divergence": _DIVERGENCE,
    "op12_suffix_array_dedup": _EARLIER,
    "op13_fill_in_middle": _MIDDLE,
}
