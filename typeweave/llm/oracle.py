"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_shingle AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), item_size AS (
  SELECT item_id, count(*) AS n_item FROM item_shingle GROUP BY item_id
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), doc_shingle AS (
  SELECT DISTINCT r, doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
  FROM (SELECT r, doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM doc, (SELECT DISTINCT width FROM item_shingle) WHERE len(w) >= width)
), hit AS (
  SELECT r, doc_id, item_id, count(*) AS n_shared FROM doc_shingle JOIN item_shingle USING (width, s) GROUP BY r, doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM hit JOIN item_size USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""

MIXING = r"""
WITH counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sized AS (
  SELECT *, length(bin(size))::BIGINT AS favour FROM counted
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sized GROUP BY source
), filled AS (
  SELECT *, row_number() OVER w AS place,
    3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM totals WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), level AS (
  SELECT arg_min(left_size::DOUBLE / (2 * left_weight)::DOUBLE, place) AS level FROM filled WHERE left_size * weight <= 4 * source_size * left_weight
), share AS (
  SELECT source, source_size, target, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest
  FROM (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio
        FROM (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(level * weight, 0.0)) AS target FROM filled, level))
), ladder AS (
  SELECT c.source, c.favour, rest,
    coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY c.favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
    (sum(c.favour * words) OVER (PARTITION BY c.source ORDER BY c.favour DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weighed
  FROM (SELECT source, favour, sum(size)::BIGINT AS words FROM sized GROUP BY source, favour) c JOIN share ON c.source IS NOT DISTINCT FROM share.source
), open AS (
  SELECT source, max(favour) AS open_from, arg_max((rest - above) / weighed, favour) AS per_favour, arg_max(above, favour) AS certain
  FROM ladder WHERE weighed > 0 AND (rest - above) / weighed * favour <= 1 GROUP BY source
), keyed AS (
  SELECT sized.*, source_size, target, whole, rest - coalesce(certain, 0) AS rest,
    CASE WHEN favour > open_from THEN 1.0::DOUBLE ELSE coalesce(per_favour * favour, 0.0)::DOUBLE END AS chance
  FROM sized JOIN share ON sized.source IS NOT DISTINCT FROM share.source LEFT JOIN open ON sized.source IS NOT DISTINCT FROM open.source
), drawn AS (
  SELECT *, u / (1 - u) / (chance / (1 - chance)) AS q FROM keyed WHERE chance > 0 AND chance < 1
), ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id, size ROWS UNBOUNDED PRECEDING) AS after FROM drawn
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN 2 * after - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ordered
UNION ALL
SELECT doc_id, size, source_size, target, ((whole + floor(chance)) * size)::BIGINT AS taken FROM keyed WHERE chance <= 0 OR chance >= 1
"""


# SHA-1 in base32: four bits a hexadecimal digit, five bits a letter.
WARC = r"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), digest AS (
  SELECT *, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM page
), bit AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda k:
    substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', hex[k]) - 1) * 4 + 1, 4)), '') AS bits
  FROM digest
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + bits[g * 5 + 1]::INT * 16
    + bits[g * 5 + 2]::INT * 8 + bits[g * 5 + 3]::INT * 4 + bits[g * 5 + 4]::INT * 2 + bits[g * 5 + 5]::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bit
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION, "op6_mixing": MIXING, "op10_warc": WARC}
