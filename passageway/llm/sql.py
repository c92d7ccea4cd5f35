"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP4 = rf"""
WITH docs AS (SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
placed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS place,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed),
targets AS (
  SELECT source, source_size, round(least(cap, weight * max(level) OVER ()), 6)::DOUBLE AS target,
    coalesce(round(round(least(cap, weight * max(level) OVER ()), 6)::DOUBLE / nullif(source_size, 0) * 67108864), 0)::BIGINT AS expected,
    (('0x' || md5('mix|' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END)[1:8])::BIGINT % 1048576) * 64 AS shift
  FROM levels),
laid AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.expected, t.shift,
    sum(t.expected) OVER (PARTITION BY d.source ORDER BY
      length(bin(d.size)) * 64 + (d.size >> greatest(length(bin(d.size)) - 6, 0)),
      ('0x' || md5(coalesce(d.doc_id::VARCHAR, ''))[1:8])::BIGINT % 1024, d.size, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (((upto + shift) >> 26) - ((upto - expected + shift) >> 26)) * size AS taken FROM laid
"""

OP9 = r"""
WITH rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (SELECT row_number() OVER () AS row, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fits AS (SELECT u.row, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.action, length(r.host || r.path)) AS action
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.row)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN fits USING (row)
"""

# Base32 of a SHA-1: five hex digits are 20 bits, four base32 digits.
OP5 = r"""
WITH records AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::INT >> (15 - 5 * (i % 4))) & 31) + 1)::INT]), '') AS payload_digest FROM records),
originals AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM originals
"""

# Documents are counted by the set of filters they fail (one bit each); every order is then applied to those counts.
OP12 = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
failed AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS failed FROM split),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
filters AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS filters(f)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM filters a, filters b, filters c, filters d, filters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
report AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM report
"""

ORACLES = {"op12_audit_filters": OP12, "op5_resolve_revisits": OP5, "op4_mix_sources": OP4, "op9_judge_urls": OP9}
