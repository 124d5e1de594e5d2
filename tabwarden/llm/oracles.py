"""SQL of the numbered queries for DuckDB, on the same tables."""

_TEXT = "coalesce(text, '')"

_OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '###', '\2') AS body,
    replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '###', '\2'), ': ', '\3') AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, coalesce(url, '')) AS place,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hexed, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN top END AS refers_to
FROM p
"""

_OP6 = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, (len(w) - least(13, len(w)) + 2)::BIGINT)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM words, lengths WHERE len(w) >= n),
found AS (
  SELECT r, p.i, p.n, x.item_id
  FROM (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places) p
  JOIN windows x ON x.n = p.n AND x.win = p.win),
hit AS (
  SELECT r, count(DISTINCT i + k) AS n_hit
  FROM (SELECT DISTINCT r, i, unnest(range(0, n::BIGINT)) AS k FROM found) GROUP BY r),
which AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN which USING (r)
"""

_OP1 = """
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, (len(w) - 1)::BIGINT)) AS i FROM base WHERE len(w) >= 3))),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM wins WHERE n > 1) GROUP BY r),
counted AS (
  SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')))::BIGINT AS n_upper,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN rep USING (r)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN least(100, 100 * n_symbols // word_chars) ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN least(100, 100 * n_dup_lines // n_lines) ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN least(100, 100 * n_repeat_words // n_words) ELSE 0 END AS repeat_words,
    CASE WHEN word_chars > 0 THEN least(100, 100 * n_upper // word_chars) ELSE 0 END AS upper
  FROM counted),
long AS (
  SELECT r, doc_id, stratum, base_failed, unnest(['symbols', 'dup_lines', 'repeat_words', 'upper']) AS rule,
    unnest([symbols, dup_lines, repeat_words, upper]) AS cutoff
  FROM rated),
marked AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
tally AS (
  SELECT stratum, rule, cutoff,
    count(*) FILTER (md5(doc_id::VARCHAR)[1] < '8' AND quality = 1) AS held_good,
    count(*) FILTER (NOT md5(doc_id::VARCHAR)[1] < '8' AND quality = 1) AS own_good,
    count(*) FILTER (NOT md5(doc_id::VARCHAR)[1] < '8' AND quality = 0) AS own_bad
  FROM long JOIN marked USING (doc_id) WHERE NOT base_failed GROUP BY stratum, rule, cutoff),
sums AS (
  SELECT stratum, rule, cutoff, sum(held_good) OVER (PARTITION BY stratum, rule) AS good,
    sum(held_good) OVER above AS lost, sum(own_bad - own_good) OVER above AS gain,
    (SELECT count(*) FROM (SELECT DISTINCT stratum FROM tally)) * 4 AS tests
  FROM tally WINDOW above AS (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING)),
tested AS (
  SELECT *, max(CASE WHEN lost > good * 0.0125 THEN 1 WHEN list_sum(list_transform(range(0, (lost + 1)::BIGINT), lambda j:
        exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln(0.0125) + (good - j) * ln(1 - 0.0125))))
        > 0.05 / tests THEN 1 ELSE 0 END)
      OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING) AS failed
  FROM sums WHERE cutoff >= 1),
chosen AS (
  SELECT stratum, rule, cutoff AS lowest FROM tested WHERE failed = 0 AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
hits AS (
  SELECT r, string_agg(long.rule, ',' ORDER BY list_position(['symbols', 'dup_lines', 'repeat_words', 'upper'], long.rule)) AS rules
  FROM long JOIN chosen ON long.rule = chosen.rule AND long.stratum IS NOT DISTINCT FROM chosen.stratum AND cutoff >= lowest
  GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by
FROM rated LEFT JOIN hits USING (r)
"""

_OP12 = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS p
  FROM docs LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, p, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM fails GROUP BY part, p),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.b | w.b | x.b | y.b | z.b = 31),
steps AS (
  SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
  FROM (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS k FROM orders)),
rows AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (p & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (p & own <> 0 AND p & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (p & own <> 0 AND p & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (p = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (p & own <> 0 AND p & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (p & own <> 0 AND p & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM rows
"""

_OP13 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES = {
    "op1_quality_rules": _OP1,
    "op2_chat_formatting": _OP2,
    "op3_warc_archive": _OP3,
    "op6_decontamination": _OP6,
    "op12_filter_audit": _OP12,
    "op13_exact_dedup": _OP13,
}
