"""DuckDB SQL for the queries that SQL can express."""

_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS most FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER lower_ones, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER lower_ones, 0))::DOUBLE AS level
  FROM ranked
  WINDOW lower_ones AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= most THEN most::DOUBLE
              ELSE min(CASE WHEN level * weight < most THEN level END) OVER () * weight END AS target,
         level, weight, most FROM levels),
final AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= most THEN most::DOUBLE
              ELSE (SELECT arg_min(level, (most / weight)) FROM levels WHERE level * weight < most) * weight END AS target
  FROM shares),
offered AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, s.source,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
                           ROWS UNBOUNDED PRECEDING)::BIGINT AS offered
  FROM sized s JOIN final f ON s.source IS NOT DISTINCT FROM f.source),
queue AS (
  SELECT source, offered, size, (offered + c * source_size) / target AS finish
  FROM offered, unnest([0, 1]) AS t(c) WHERE size > 0 AND target > 0),
line AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, offered ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM queue),
budget AS (SELECT (coalesce(sum(source_size), 0)::BIGINT * 150) // 100 AS words FROM per),
served AS (
  SELECT source, offered, sum(least(size, greatest(0, budget.words - (upto - size))))::BIGINT AS taken
  FROM line, budget GROUP BY source, offered)
SELECT o.doc_id, o.size, o.source_size, o.target, o.source, coalesce(s.taken, 0)::BIGINT AS taken
FROM offered o LEFT JOIN served s ON o.source IS NOT DISTINCT FROM s.source AND o.offered = s.offered AND o.size > 0
"""

_WORDS9 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS9}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS9}, []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, lens, unnest(generate_series(1, greatest(len(w) - n + 1, 0))) AS t(i)),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS filled,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 7, 0))) AS t(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM twice, unnest(generate_series(i, i + 7)) AS t(p) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(filled) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM d LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_letter_words < 70 * n_words) AS kept
FROM f
"""

_OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN df USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
p AS (
  SELECT g.lang, g.source, df.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(own.total, 0) + 2 * v.v) AS p
  FROM groups g JOIN df ON g.lang = df.lang JOIN v ON g.lang = v.lang
  LEFT JOIN own ON g.lang = own.lang AND g.source = own.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND df.term = c.term),
pooled AS (SELECT c.lang, term, sum(n) AS n FROM c GROUP BY c.lang, term),
q AS (
  SELECT pooled.lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (t.total + 2 * v.v) AS q
  FROM pooled JOIN (SELECT lang, sum(total) AS total FROM own GROUP BY lang) t ON pooled.lang = t.lang JOIN v ON pooled.lang = v.lang),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:least(a, b)], '') AS pre,
         array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(w[greatest(a, b) + 1:n], '') AS suf FROM e)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

SQL = {"op12_source_divergence": _OP12, "op13_fill_in_middle": _OP13, "op6_mixing": _OP6, "op9_benchmark_decontamination": _OP9, "op10_quality_rules": _OP10}
