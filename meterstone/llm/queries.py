"""The registered queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from meterstone.llm.alignment import op13_alignment
from meterstone.llm.decontamination import op6_decontamination
from meterstone.llm.hard_negatives import op11_hard_negatives
from meterstone.llm.language import op7_language
from meterstone.llm.lines import op5_lines
from meterstone.llm.neighbours import op3_neighbours
from meterstone.llm.ngram_join import op1_ngram_join
from meterstone.llm.packing import op4_packing
from meterstone.llm.piece_codec import op12_sentencepiece
from meterstone.llm.pii import op9_pii
from meterstone.llm.quality import op10_quality
from meterstone.llm.sharding import op2_sharding
from meterstone.llm.substrings import op8_substrings

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_sharding, op3_neighbours, op4_packing, op5_lines, op6_decontamination, op7_language, op8_substrings, op9_pii, op10_quality, op11_hard_negatives, op12_sentencepiece, op13_alignment)}

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
[floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS u FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.u, v.u) AS BIGINT) AS score
FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same WHERE place <= 5 AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

NGRAM_JOIN = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS shingle FROM (
  SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
c AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.other = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM c GROUP BY doc_id) r ON d.doc_id = r.doc_id"""

DECONTAMINATION = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, k, size, md5(array_to_string(words[k:k + size - 1], ' ')) AS h FROM (
  SELECT item_id, words, least(13, len(words)) AS size, unnest(generate_series(1, greatest(1, len(words) - 12))) AS k FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, i, size, md5(array_to_string(words[i:i + size - 1], ' ')) AS h FROM (
  SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM iw) WHERE len(words) >= size)),
m AS (SELECT doc_id, item_id, i, k, dw.size FROM dw JOIN iw ON dw.h = iw.h AND dw.size = iw.size),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
runs AS (SELECT doc_id, size + count(*) - 1 AS longest FROM (
  SELECT doc_id, item_id, size, i - k AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, size, i - k ORDER BY i) AS island FROM m) GROUP BY doc_id, item_id, size, diagonal, island),
far AS (SELECT doc_id, max(longest) AS longest FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
coalesce(names, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest_match
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN far ON d.doc_id = far.doc_id"""

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM w JOIN f USING (k) WHERE first_id < doc_id),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
s AS (SELECT t.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""

#: For tables without repeated ids, as the supplied ones are.
ORACLES: dict[str, str] = {"op1_ngram_join": NGRAM_JOIN, "op6_decontamination": DECONTAMINATION, "op8_substrings": SUBSTRINGS, "op11_hard_negatives": HARD_NEGATIVES}
