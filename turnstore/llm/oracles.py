"""The same results in SQL, for the operators that SQL can express.

The others fit a model, choose cutoffs by incomplete beta functions or need a tokenizer,
and for personal data none was written; ``tests/llm`` holds those against brute force.
"""

from __future__ import annotations

from turnstore.llm import licences

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _names(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{licences.UPPER}', '{licences.LOWER}')"


_FITS = ",\n".join(
    f"CASE WHEN contains(joined, {_quoted(f' {" ".join(r.sequence)} ')}) THEN {_quoted(r.licence)} END"
    for r in licences.RULES)

ORACLES["op1_license_scans"] = f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace({_lowered('text')}, {_quoted(licences.BOUNDARY)}, chr(10), 'g'), chr(10)) AS raw
  FROM documents),
named AS (
  SELECT doc_id, list_filter(list_transform(raw, lambda s: {_names(licences.SENTENCES)}[list_position(
    {_names(licences.SENTENCES.values())},
    regexp_replace(regexp_replace(s, {_quoted(licences.NOISE)}, ' ', 'g'), {_quoted(licences.EDGES)}, '', 'g'))]),
    lambda name: name IS NOT NULL) AS ids
  FROM cut),
joined AS (SELECT doc_id, ids, ' ' || coalesce(array_to_string(ids, ' '), '') || ' ' AS joined FROM named),
fitting AS (
  SELECT doc_id, ids, list_filter([{_FITS}], lambda name: name IS NOT NULL) AS fits FROM joined)
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(fits, lambda name, i: list_position(fits, name) = i), ','), '') AS licences,
  fits[1] AS licence
FROM fitting
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES["op2_benchmark_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lowered('text')}, {_ALNUM}) AS words FROM documents),
i AS (
  SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all({_lowered('text')}, {_ALNUM}) AS words
  FROM benchmark),
iw AS (
  SELECT r, item, unnest(words) AS word, unnest(range(len(words))) AS place, least(len(words), 13) AS n FROM i),
windows AS (
  SELECT DISTINCT item, n, text FROM (
    SELECT item, n, string_agg(word, ' ') OVER f AS text, count(*) OVER f AS held FROM iw
    WINDOW f AS (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING))
  WHERE held = n),
dw AS (
  SELECT r, word, place, n
  FROM (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS place FROM d),
    (SELECT DISTINCT n FROM windows)),
found AS (
  SELECT t.r, t.place, t.n, w.item FROM (
    SELECT r, place, n, string_agg(word, ' ') OVER f AS text FROM dw
    WINDOW f AS (PARTITION BY r, n ORDER BY place ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)) t
  JOIN windows w ON w.n = t.n AND w.text = t.text),
hits AS (SELECT r, count(DISTINCT hit) AS n_hit FROM (SELECT r, unnest(range(place, place + n)) AS hit FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

# The checksum of a text goes through its bytes one by one.
ORACLES["op3_sharding"] = """
WITH RECURSIVE step(byte, value, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(value ORDER BY byte) AS of FROM step WHERE k = 8),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
    CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum
  FROM documents),
sums AS (
  SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda h: CAST(CAST('0x' || h AS INTEGER) AS BIGINT)),
    lambda c, b: xor(c >> 8, of[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT text FROM d), crc),
rows AS (
  SELECT doc_id, key, stratum, text_crc32, octet_length(encode(text)) + 16 AS size
  FROM d JOIN sums USING (text)),
ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY key, text_crc32, size) - 1) + 1)
    / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS share
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY share, stratum) - 1 AS place,
    count(*) OVER () // 40 AS least, count(*) OVER () % 40 AS larger
  FROM ranked),
cut AS (SELECT *, place < larger * (least + 1) AS first, place - larger * (least + 1) AS beyond FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(CASE WHEN first THEN place // (least + 1) ELSE larger + beyond // greatest(least, 1) END AS INTEGER) AS shard,
  CAST(CASE WHEN first THEN place % (least + 1) ELSE beyond % greatest(least, 1) END AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

ORACLES["op4_ngram_jaccard_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_lowered('text')}, '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place, least(len(words), 5) AS n FROM d),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, n, string_agg(word, ' ') OVER f AS shingle, count(*) OVER f AS held FROM w
    WINDOW f AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE held = n),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * both_have >= 80 * (a.n + b.n - both_have)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, v FROM reach JOIN links ON u = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

ORACLES["op12_conversation_prefix_trie"] = r"""
WITH RECURSIVE step(byte, value, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(value ORDER BY byte) AS of FROM step WHERE k = 8),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS leader FROM t GROUP BY conv_id),
sums AS (
  SELECT conv_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'),
      lambda h: CAST(CAST('0x' || h AS INTEGER) AS BIGINT)),
    lambda s, b: xor(s >> 8, of[xor(s & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM c, crc),
k AS (
  SELECT c.conv_id, c.leader, h, least(h, coalesce(held.n, 0)) AS given
  FROM c JOIN sums USING (conv_id) LEFT JOIN c AS held ON held.conv_id = c.leader),
r AS (
  SELECT k.conv_id, place, role, text FROM k JOIN t ON t.conv_id = k.leader AND place < given
  UNION ALL
  SELECT k.conv_id, place - h + given, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND place >= h),
p AS (
  SELECT conv_id, place + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(md5(concat(length(role), ':', role, text)), '') OVER (
      PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS key
  FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM k),
last AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM last GROUP BY key, depth),
children AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
above AS (
  SELECT left(key, 32 * d) AS key, CAST(n_children = 0 AS INTEGER) AS leaf, (n_convs - 1) * words AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM known)),
totals AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY key)
SELECT known.conv_id, known.depth, parent.conv_id AS parent_conv_id, known.n_convs, known.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(known.ids) AS ends_sha256
FROM known JOIN totals USING (key)
LEFT JOIN nodes AS parent ON known.depth > 0 AND parent.key = left(known.key, 32 * (known.depth - 1))
"""
