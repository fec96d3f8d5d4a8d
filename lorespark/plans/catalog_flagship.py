"""Registered query: texts to ranked answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.plans import flagship, views as v
from lorespark.plans.catalog_chunks import _sql_classified
from lorespark.plans.registry import Tables, query

SQL_UNIQUE = rf"""
cl AS (SELECT doc_id, {v.sql_clean('text')} AS clean FROM documents),
un AS (SELECT min(doc_id) AS doc_id, clean FROM cl WHERE length(clean) >= 20 GROUP BY clean),
ca AS (SELECT *, length(clean) AS n, CASE WHEN length(clean) <= 1800 THEN 1 ELSE ceil((length(clean) - 1800) / 1050.0)::BIGINT + 1 END AS k FROM un),
cb AS (SELECT *, unnest(generate_series(0, k - 1)) AS ordinal FROM ca),
chunks AS (SELECT doc_id, ordinal, substr(clean, ordinal * 1050 + 1, CASE WHEN ordinal = k - 1 THEN n - ordinal * 1050 ELSE 1200 END) AS text FROM cb)"""


@query("flagship_ranked_answers", rf"""
WITH {SQL_UNIQUE},
tok AS (SELECT item_id, lower(u) AS token, count(*) AS weight FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_''-]+')) AS u FROM benchmark) WHERE length(u) >= 2 GROUP BY ALL),
lc AS (SELECT doc_id, ordinal, lower(text) AS t FROM chunks),
sc AS (SELECT item_id, doc_id, ordinal, sum(weight * (length(t) - length(replace(t, token, ''))) // length(token)) AS score
  FROM lc JOIN tok ON contains(t, token) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ordinal) AS position FROM sc),
cc AS ({_sql_classified('chunks', 'doc_id, ordinal, text')})
SELECT item_id, position::BIGINT AS position, score::BIGINT AS score, rk.doc_id, rk.ordinal::BIGINT AS ordinal, category,
  {v.sql_words('text')}::BIGINT AS word_count,
  sha256('{{"content_type":"paragraph","heading_context":[],"text":' || to_json(text)::VARCHAR || '}}') AS content_hash
FROM rk JOIN cc ON cc.doc_id = rk.doc_id AND cc.ordinal = rk.ordinal WHERE position <= 10""")
def ranked(t: Tables):
    out = flagship.answer(t.documents.select("doc_id", "text"), t.benchmark, 10, v.CORPUS_CLASSES)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("position", "score", "ordinal")})
