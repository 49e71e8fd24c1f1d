"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * size / w, source) AS k FROM s),
p AS (SELECT *, coalesce(sum(3.0::DOUBLE * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(size) OVER () AS total FROM o),
r AS (SELECT (total - capped)::DOUBLE / free AS rate FROM p WHERE (total - capped)::DOUBLE / free <= 3.0::DOUBLE * size / w ORDER BY k LIMIT 1),
t AS (SELECT source, size AS source_size, least(3.0::DOUBLE * size, rate * w) AS target, least(3.0::DOUBLE * size, rate * w) / nullif(size, 0) AS per FROM s, r),
u AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.per, 0) AS per,
        ('0x' || substr(sha256('20:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (floor(per) + CASE WHEN draw < per - floor(per) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""

_CLOSURE = """
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
"""

_OP7 = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
{_CLOSURE}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
       least(e.vec_id, (SELECT min(b) FROM reach WHERE a = e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, (SELECT min(b) FROM reach WHERE a = e.vec_id)) AS kept
FROM embeddings e
"""

_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)),
{_CLOSURE}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.n, 0) AS n_links, least(d.doc_id, r.b) AS class_id, d.doc_id = least(d.doc_id, r.b) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"

_OP10 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(replace({_ESCAPED.format("role")}, chr(10), '&nl;')) + 1 + length({_ESCAPED.format("text")}) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# crc32 of the ASCII digits of doc_id, bit by bit
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))"""

_OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.replace("{n}", "n_chars")} AS leaf, {_LEAF.replace("{n}", "(n_chars::HUGEINT + 1)")} AS other,
    xor({_CRC}, 4294967295::UBIGINT) % 7 = 0 AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
up AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) FROM up WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM up WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) FROM top WHERE len(nodes) > 1),
-- the sibling of each row at each level, '' where its run has no other
sib AS (SELECT p.lang, p.i, up.level, ((p.i >> up.level) % 2) AS slot, coalesce(up.nodes[xor((p.i >> up.level), 1) + 1], '') AS s
    FROM p JOIN up ON up.lang IS NOT DISTINCT FROM p.lang WHERE len(up.nodes) > 1
  UNION ALL SELECT p.lang, p.i, sub.height + top.level, (g >> top.level) % 2, coalesce(top.nodes[xor((g >> top.level), 1) + 1], '')
    FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang CROSS JOIN top WHERE len(top.nodes) > 1),
path AS (SELECT lang, i, list({{'s': s, 'slot': slot}} ORDER BY level) AS path FROM sib GROUP BY lang, i),
fold AS (SELECT p.doc_id, p.lang, p.i, 0 AS k, CASE WHEN tampered THEN other ELSE leaf END AS node, coalesce(path, []) AS path FROM p LEFT JOIN path q ON q.lang IS NOT DISTINCT FROM p.lang AND q.i = p.i
  UNION ALL SELECT doc_id, lang, i, k + 1, CASE WHEN path[k + 1].slot = 0 THEN sha256(node || path[k + 1].s) ELSE sha256(path[k + 1].s || node) END, path FROM fold WHERE k < len(path))
SELECT p.doc_id, p.leaf, sub.subroot, r.nodes[1] AS root, sha256(list_aggregate(list_transform(f.path, lambda x: x.s), 'string_agg', '')) AS proof_sha256,
  f.node AS folded_root, f.node = r.nodes[1] AS verified
FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN fold f ON f.lang IS NOT DISTINCT FROM p.lang AND f.i = p.i AND f.k = len(f.path)
CROSS JOIN (SELECT nodes FROM top WHERE len(nodes) = 1) r
"""

# These pages mark their article, with headings, paragraphs, bold text and line breaks inside, and refer to two characters.
_OP11 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
b AS (SELECT *, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
    regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS w FROM p, range(1, 4) r(m)),
f AS (SELECT lang, m, array_to_string(w, ' ') AS phrase, w, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 10),
x AS (SELECT lang, max(f) AS longer, array_to_string(s, ' ') AS phrase FROM (SELECT lang, f, unnest([w[1:2], w[2:3]]) AS s FROM c WHERE m = 3) GROUP BY lang, s),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN x USING (lang, phrase) WHERE x.longer IS NULL OR 100 * x.longer < 50 * c.f),
s AS (SELECT k.lang, k.phrase, k.f AS a, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.f * k.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op1_mix_sources": _OP1, "op7_embedding_dedup": _OP7, "op8_jaccard_join": _OP8, "op10_chat_format": _OP10, "op11_html_extract": _OP11, "op12_merkle_manifest": _OP12, "op13_collocations": _OP13}
