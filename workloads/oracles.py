"""The same results in SQL, written against the raw tables without the library."""

from __future__ import annotations

from turnstore.functions.text import WHITESPACE

_WS = WHITESPACE.replace("'", "''")
_QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
_CUTOFFS = (1, 5, 10, 20, 40, 100)
_SPACES = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

ORACLES: dict[str, str] = {}


def _strip(x: str) -> str:
    return f"trim({x}, '{_WS}')"


def _key(x: str) -> str:
    return f"substr(trim(regexp_replace(lower({x}), '{_SPACES}', ' ', 'g'), ' '), 1, 120)"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# --- conversations -------------------------------------------------------------------

MSGS = f"""msgs AS (
  SELECT conv_id, turn, role, {_strip('text')} AS content, text AS whole,
         'conv-' || conv_id AS session_id, 'u' || (conv_id % 20) AS user_id,
         'conv-' || conv_id || ':chunk-' || (turn // 4) AS request_id, turn % 4 AS position,
         1700000000000 + conv_id * 3600000 + turn * 60000 AS ts, conv_id * 100 + turn // 4 AS arrival
  FROM conversations),
stamped AS (
  SELECT *, substr(sha1(user_id || chr(0) || request_id), 1, 16) AS digest,
         strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
         strftime(make_timestamp(ts * 1000), '[%Y-%m-%d %H:%M] ') AS prefix,
         CASE role WHEN 'user' THEN 'I' ELSE upper(substr(role, 1, 1)) || lower(substr(role, 2)) END AS speaker
  FROM msgs)"""

RAWS = """raws AS (
  SELECT digest || '-r' || position AS id, user_id, session_id, request_id, 'raw' AS kind,
         prefix || speaker || ': ' || content AS content, created_at, position, arrival, digest
  FROM stamped WHERE content <> '')"""

CHUNKS = """chunks AS (
  SELECT request_id, user_id, session_id, digest, arrival, conv_id,
         string_agg(prefix || role || ': ' || content, chr(10) ORDER BY turn) AS transcript,
         arg_min(prefix, turn) AS prefix, arg_min(created_at, turn) AS created_at,
         string_agg(content, chr(10) ORDER BY turn) AS said
  FROM stamped GROUP BY ALL)"""

# The lines each reply lists, by the shape of the reply.
FACTS = f"""said_lines AS (
  SELECT * EXCLUDE (lines), unnest(lines) AS line, generate_subscripts(lines, 1) AS n
  FROM (SELECT *, list_filter(list_transform(string_split(said, chr(10)), lambda x: {_strip('x')}),
                              lambda x: x <> '') AS lines FROM chunks)),
fact_lines AS (
  SELECT *, CASE conv_id % 5 WHEN 0 THEN line ELSE trim(line, ' "') END AS fact FROM said_lines
  WHERE conv_id % 5 IN (0, 1, 2)),
facts AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n) - 1 AS number FROM fact_lines
  WHERE conv_id % 5 = 0 OR length(fact) > 3),
fact_rows AS (
  SELECT digest || '-f' || number AS id, user_id, session_id, request_id, 'fact' AS kind,
         CASE WHEN starts_with(fact, '[') THEN fact ELSE prefix || fact END AS content, created_at,
         number AS position, arrival, digest, fact
  FROM facts WHERE number < 24)"""

ITEMS = """items AS (
  SELECT id, user_id, session_id, request_id, kind, content, created_at, position, arrival, digest FROM raws
  UNION ALL
  SELECT id, user_id, session_id, request_id, kind, content, created_at, position, arrival, digest FROM fact_rows),
mem AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival, request_id, kind DESC, position) - 1 AS seq
  FROM items)"""

CHAT = ",\n".join([MSGS, RAWS, CHUNKS, FACTS, ITEMS])


def _vectors(name: str, source: str, key: str, text: str) -> str:
    """Sparse unit vectors of hashed words: {name}(key, dim, w)."""
    return f"""{name}_words AS (
  SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source}),
{name}_counts AS (
  SELECT key, ('0x' || substr(md5(word), 1, 4))::INT % 64 AS dim, count(*) AS c FROM {name}_words GROUP BY ALL),
{name}_norms AS (SELECT key, sqrt(sum(c * c)) AS norm FROM {name}_counts GROUP BY key),
{name} AS (
  SELECT key, dim, (c / norm)::FLOAT::DOUBLE AS w FROM {name}_counts JOIN {name}_norms USING (key))"""


def _text_scores(mem: str, asks: str) -> str:
    """scored(query_id, id, kind, position, digest, seq, score): all pairs of one user."""
    return ",\n".join([
        _vectors("mvec", mem, "id", "content"), _vectors("qvec", asks, "query_id", f"'{_QUERY_PREFIX}' || query"),
        f"""dots AS (
  SELECT q.key AS query_id, m.key AS id, sum(q.w * m.w) AS s
  FROM qvec q JOIN {asks} a ON a.query_id = q.key JOIN mvec m ON m.dim = q.dim
  JOIN {mem} x ON x.id = m.key AND x.user_id = a.user_id GROUP BY ALL),
scored AS (
  SELECT a.query_id, x.id, x.kind, x.position, x.digest, x.seq, round(coalesce(d.s, 0), 9) AS score
  FROM {asks} a JOIN {mem} x USING (user_id) LEFT JOIN dots d ON d.query_id = a.query_id AND d.id = x.id)"""])


CHAT_ASKS = """asks AS (
  SELECT request_id || '#' || position AS query_id, whole AS query, user_id, 20 AS top_k
  FROM msgs WHERE role = 'user')"""

DOCS = """mem AS (
  SELECT substr(sha1('d' || (doc_id // 20 % 20) || chr(0) || 'docs-' || (doc_id // 20)), 1, 16) AS digest,
         'd' || (doc_id // 20 % 20) AS user_id, doc_id % 20 AS position, doc_id AS seq, text AS content,
         CASE WHEN doc_id % 4 = 3 THEN 'fact' ELSE 'raw' END AS kind,
         digest || '-' || kind[1] || position AS id
  FROM documents),
asks AS (
  SELECT 'b' || item_id AS query_id, text AS query, 'd' || (item_id % 20) AS user_id, 20 AS top_k FROM benchmark)"""

VECTORS = """mem AS (
  SELECT vec_id, substr(sha1('u' || label || chr(0) || 'chunk-' || (vec_id // 20)), 1, 16) AS digest,
         'u' || label AS user_id, vec_id % 20 AS position, vec_id AS seq,
         CASE WHEN vec_id % 4 = 3 THEN 'fact' ELSE 'raw' END AS kind,
         digest || '-' || kind[1] || position AS id, embedding::DOUBLE[] AS vec
  FROM embeddings),
asks AS (
  SELECT 'q' || vec_id AS query_id, 'u' || label AS user_id, embedding::DOUBLE[] AS qvec, vec_id, label FROM embeddings),
scored AS (
  SELECT query_id, id, kind, position, digest, seq, round(list_dot_product(vec, qvec), 9) AS score
  FROM asks JOIN mem USING (user_id))"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS p FROM scored)"""


def _offers(mem: str, radius: int, hits: str = "ranked") -> str:
    """offered(query_id, down, hit_seq, slot, id, ...): hits, then their neighbours."""
    return f"""hit_slots AS (
  SELECT query_id, -score AS down, seq AS hit_seq, 0 AS slot, id FROM {hits}
  UNION ALL
  SELECT r.query_id, -r.score, r.seq, CASE WHEN o.off < 0 THEN o.off + {radius} + 1 ELSE o.off + {radius} END,
         r.digest || '-r' || (r.position + o.off)
  FROM {hits} r, (SELECT unnest(range(-{radius}, {radius} + 1)) AS off) o WHERE o.off <> 0 AND r.kind = 'raw'),
offered AS (
  SELECT h.*, m.kind, m.content, length(m.content) AS n_chars, {_key('m.content')} AS key
  FROM hit_slots h JOIN {mem} m USING (id))"""


def _selected(limit: str) -> str:
    """taken(query_id, take, ...): first offer per key, the first *limit* of them."""
    return f"""firsts AS (
  SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY down, hit_seq, slot) = 1),
taken AS (
  SELECT *, -down AS score, row_number() OVER (PARTITION BY query_id ORDER BY down, hit_seq, slot) AS take
  FROM firsts QUALIFY take <= {limit})"""


def _placed(order: str) -> str:
    return (f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS pos, id, kind, "
            "round(score, 6) AS score FROM taken")


ORACLES["ingest_messages"] = _with(MSGS, RAWS) + (
    "SELECT id, user_id, session_id, request_id, kind, content, created_at FROM raws")

ORACLES["item_ids"] = _with(MSGS) + (
    "SELECT request_id, user_id, position, digest || '-r' || position AS id, digest, 'raw' AS kind FROM stamped")

ORACLES["quarantine_requests"] = """
SELECT event_id::VARCHAR AS request_id, CASE event_type WHEN 'click' THEN 'user_id' ELSE 'messages' END AS problem
FROM events WHERE event_type IN ('click', 'view', 'error')"""

ORACLES["chunk_transcript"] = _with(MSGS, CHUNKS) + "SELECT request_id, user_id, digest, transcript FROM chunks"

ORACLES["facts_from_replies"] = _with(CHAT) + "SELECT request_id, user_id, position, fact FROM fact_rows"

ORACLES["fact_memories"] = _with(CHAT) + (
    "SELECT id, user_id, request_id, kind, content, created_at FROM fact_rows")

ORACLES["build_memories"] = _with(CHAT) + "SELECT id, user_id, session_id, kind, content, created_at FROM items"

ORACLES["extract_with_caller"] = _with(MSGS, CHUNKS) + """
SELECT request_id, user_id, CASE WHEN length(transcript) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN length(transcript) % 7 = 0 OR length(transcript) % 5 = 0 THEN ''
            ELSE length(transcript) || ' characters|' || len(string_split(transcript, chr(10))) || ' lines' END AS facts
FROM chunks"""

ORACLES["assign_seq"] = _with(CHAT) + "SELECT id, user_id, kind, seq + 3 AS seq FROM mem"

ORACLES["embed_memories"] = _with(CHAT, _vectors("v", "mem", "id", "content")) + (
    "SELECT key AS id, dim, round(w, 6) AS value FROM v")

ORACLES["upsert_memories"] = _with(CHAT) + """
SELECT id, user_id, kind, seq,
       CASE WHEN kind = 'raw' AND content LIKE '%I: %' THEN content || ' v2' ELSE content END AS content
FROM mem"""

ORACLES["ingest_exactly_once"] = (
    _with(MSGS, RAWS, """seqs AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival, request_id, position) - 1 AS seq FROM raws)""") + """
SELECT id, user_id, request_id, seq, content, 0 AS batch FROM seqs
UNION ALL
SELECT substr(sha1('other-' || user_id || chr(0) || request_id), 1, 16) || '-r' || position, 'other-' || user_id,
       request_id, seq, content, 1 FROM seqs""")

ORACLES["seq_across_batches"] = _with(MSGS, RAWS) + """
SELECT id, user_id, request_id, arrival % 3 AS batch,
       row_number() OVER (PARTITION BY user_id ORDER BY arrival % 3, arrival, request_id, position) - 1 AS seq
FROM raws"""

ORACLES["stream_ingest"] = """
SELECT substr(sha1('u' || user_id || chr(0) || event_id), 1, 16) || '-r0' AS id, 'u' || user_id AS user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
       strftime(ts, '[%Y-%m-%d %H:%M] ') || upper(event_type[1]) || event_type[2:] || ': ' || props AS content,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
         CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || '000' END
         || 'Z' AS created_at, 0 AS batch
FROM events"""

ORACLES["user_memories"] = _with(CHAT) + "SELECT user_id, seq, id, kind, content FROM mem"

ORACLES["id_isolation"] = _with(MSGS, RAWS) + (
    "SELECT 2 * count(*) AS stored, 2 * count(*) AS ids, 0 AS shared FROM raws")

ORACLES["store_stats"] = _with(CHAT) + "SELECT count(DISTINCT user_id) AS users, count(*) AS items FROM mem"

ORACLES["channel_health"] = (
    _with(CHAT, """calls AS (
  SELECT c.request_id, conv_id, count(f.id) AS n FROM chunks c LEFT JOIN fact_rows f USING (request_id) GROUP BY ALL)""") + """
SELECT count(*) AS calls, count(*) FILTER (conv_id % 5 = 4) AS failures,
       count(*) FILTER (conv_id % 5 < 3 AND n = 0) AS empty_extractions,
       CASE WHEN count(*) >= 5 AND count(*) FILTER (conv_id % 5 = 4) > 0.5 * count(*) THEN 'degraded' ELSE 'ok' END AS status
FROM calls""")

ORACLES["ingest_report"] = _with(MSGS) + """
SELECT user_id, count(*) AS chunks, sum(n)::BIGINT AS messages, max(n) AS largest_chunk
FROM (SELECT user_id, request_id, count(*) AS n FROM msgs GROUP BY ALL) GROUP BY user_id"""

# --- search -------------------------------------------------------------------------------

ORACLES["search_scores"] = _with(VECTORS, RANKED) + (
    "SELECT query_id, id, round(score, 6) AS score, p FROM ranked WHERE p <= 10")

ORACLES["rank_memories"] = _with(VECTORS, RANKED) + (
    "SELECT query_id, seq, round(score, 6) AS score, p FROM ranked WHERE p <= 100")

ORACLES["fused_scores"] = _with(VECTORS.replace("embedding::DOUBLE[] AS qvec, vec_id, label FROM embeddings", """
         CASE WHEN n.embedding IS NULL THEN e.embedding::DOUBLE[]
              ELSE list_transform(list_zip(e.embedding::DOUBLE[], n.embedding::DOUBLE[]),
                                  lambda z: 0.5 * z[1] + 0.5 * z[2]) END AS qvec
  FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1""").replace(
    "'q' || vec_id AS query_id, 'u' || label AS user_id, \n", "'q' || e.vec_id AS query_id, 'u' || e.label AS user_id,\n"),
    RANKED) + (
    "SELECT query_id, id, round(score, 6) AS score, p FROM ranked WHERE p <= 10")

ORACLES["embed_queries"] = _with(DOCS, _vectors("v", "asks", "query_id", f"'{_QUERY_PREFIX}' || query")) + (
    "SELECT key AS query_id, dim, round(w, 6) AS value FROM v")

ORACLES["recall_prompts"] = _with(MSGS) + """
SELECT DISTINCT whole AS query, 'Question: ' || whole || chr(10) || 'Answer options: ' ||
       array_to_string(string_split(whole, chr(10))[1:10], ' | ') AS prompt,
       trim(string_split(whole, chr(10))[1], ' "') AS recall
FROM msgs WHERE role = 'user'"""

ORACLES["neighbour_window"] = _with(VECTORS, RANKED, "hits AS (SELECT * FROM ranked WHERE p <= 5)",
                                    """hit_slots AS (
  SELECT query_id, seq AS hit_seq, 0 AS slot, id FROM hits
  UNION ALL
  SELECT query_id, seq, CASE WHEN off < 0 THEN off + 3 ELSE off + 2 END, digest || '-r' || (position + off)
  FROM hits, (SELECT unnest([-2, -1, 1, 2]) AS off) WHERE kind = 'raw')""") + (
    "SELECT query_id, hit_seq, slot, id FROM hit_slots SEMI JOIN mem USING (id)")

_CHAT_SEARCH = _with(CHAT, CHAT_ASKS, _text_scores("mem", "asks"), RANKED, _offers("mem", 1), _selected("20"))

ORACLES["search_memories"] = _CHAT_SEARCH + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY t.kind <> 'raw', take) - 1 AS pos, id, t.content,
       round(score, 6) AS score, mem.created_at
FROM taken t JOIN mem USING (id)"""

ORACLES["search_isolation"] = _CHAT_SEARCH + """
SELECT user_id, count(*) AS results, 0 AS "foreign" FROM taken JOIN asks USING (query_id) GROUP BY user_id"""

ORACLES["search_degraded"] = _with(
    CHAT, CHAT_ASKS, "only_raw AS (SELECT * FROM mem WHERE kind = 'raw')", _text_scores("only_raw", "asks"), RANKED,
    _offers("only_raw", 0), _selected("10")) + _placed("take")

ORACLES["search_edge_cases"] = _with(
    CHAT, CHAT_ASKS, _text_scores("mem", "asks"), RANKED, _offers("mem", 1),
    _selected("CASE string_split(query_id, '#')[2] WHEN '0' THEN 0 WHEN '1' THEN 7 WHEN '3' THEN 0 ELSE 30 END")) + (
    "SELECT query_id, count(*) AS items FROM taken GROUP BY query_id")

_DOC_SCORES = (DOCS, _text_scores("mem", "asks"), RANKED)
_DOC_SEARCH = _with(*_DOC_SCORES, _offers("mem", 1), _selected("20"))

ORACLES["dedupe_results"] = _with(
    *_DOC_SCORES, "best AS (SELECT * FROM ranked WHERE p <= 40)", _offers("mem", 0, "best"), _selected("40")) + (
    "SELECT query_id, id, n_chars, key FROM firsts")

ORACLES["order_raw_first"] = _DOC_SEARCH + _placed("kind <> 'raw', take")
ORACLES["order_fact_first"] = _DOC_SEARCH + _placed("kind = 'raw', take")
ORACLES["order_relevance"] = _DOC_SEARCH + _placed("take")
ORACLES["random_control"] = _DOC_SEARCH + _placed("md5('0|' || query_id || '|' || id), take")
ORACLES["order_sandwich"] = _DOC_SEARCH.replace("taken AS (", "chosen AS (") + """,
taken AS (
  SELECT *, CASE WHEN kind <> 'raw' THEN 1
                 WHEN row_number() OVER (PARTITION BY query_id, kind ORDER BY take)
                      <= ceil(count(*) OVER (PARTITION BY query_id, kind) / 2.0) THEN 0 ELSE 2 END AS part FROM chosen)
""" + _placed("part, take")

# The walk, one offer per step: the budget, the keys and the items taken so far.
ORACLES["budgeted_results"] = _with(*_DOC_SCORES, _offers("mem", 1), """
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY down, hit_seq, slot) AS n FROM offered),
walk AS (
  SELECT query_id, 0::BIGINT AS n, 6000::BIGINT AS budget, []::VARCHAR[] AS seen, FALSE AS took, NULL::VARCHAR AS id,
         NULL::VARCHAR AS kind, NULL::DOUBLE AS score FROM asks
  UNION ALL
  SELECT query_id, o.n, CASE WHEN ok THEN budget - n_chars ELSE budget END,
         CASE WHEN ok THEN list_append(seen, key) ELSE seen END, ok, o.id, o.kind, -down
  FROM (SELECT w.query_id, w.budget, w.seen, o.n, o.id, o.kind, o.down, o.key, o.n_chars,
               NOT list_contains(w.seen, o.key) AND (o.n_chars <= w.budget OR len(w.seen) = 0) AS ok
        FROM walk w JOIN numbered o ON o.query_id = w.query_id AND o.n = w.n + 1
        WHERE len(w.seen) < 20 AND (w.budget > 0 OR len(w.seen) = 0)) o)""") + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS pos, id, kind, round(score, 6) AS score
FROM walk WHERE took"""

ORACLES["single_kind_search"] = _with(*_DOC_SCORES) + """
SELECT kind AS arm, query_id, id, round(s.score, 6) AS score,
       row_number() OVER (PARTITION BY query_id, kind ORDER BY s.score DESC, seq) AS p
FROM scored s QUALIFY p <= 10"""

ORACLES["diversity_cap"] = _with(VECTORS, RANKED, """spread AS (
  SELECT * EXCLUDE (p) FROM ranked
  QUALIFY row_number() OVER (PARTITION BY query_id, digest ORDER BY score DESC, seq) <= 2)""") + """
SELECT query_id, id, round(s.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, seq) AS p
FROM spread s QUALIFY p <= 20"""

_PARENTS = _with(CHAT, CHAT_ASKS, _text_scores("mem", "asks"), RANKED, """parents AS (
  SELECT query_id, digest, min(p) AS first_p FROM ranked WHERE p <= 20 GROUP BY ALL),
listed AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_p) - 1 AS pos, digest, transcript AS content
  FROM parents JOIN chunks USING (digest))""")

ORACLES["parent_chunks"] = _PARENTS + "SELECT query_id, pos, digest, content FROM listed"
ORACLES["parent_chunks_budget"] = _PARENTS.rstrip() + """,
walk AS (
  SELECT DISTINCT query_id, -1::BIGINT AS pos, 3000::BIGINT AS budget, 0 AS kept, FALSE AS took, NULL::VARCHAR AS digest FROM listed
  UNION ALL
  SELECT query_id, pos, CASE WHEN ok THEN budget - size ELSE budget END, CASE WHEN ok THEN kept + 1 ELSE kept END, ok, digest
  FROM (SELECT l.query_id, l.pos, l.digest, length(l.content) AS size, w.budget, w.kept,
               w.kept = 0 OR (w.budget > 0 AND length(l.content) <= w.budget) AS ok
        FROM walk w JOIN listed l ON l.query_id = w.query_id AND l.pos = w.pos + 1))
SELECT query_id, pos, digest FROM walk WHERE took"""

_SIZES = _DOC_SEARCH.rstrip() + """,
sizes AS (
  SELECT query_id, count(*) AS items, sum(n_chars)::BIGINT AS chars, count(DISTINCT substr(id, 1, 16)) AS chunks,
         sum(n_chars) / 4000.0 AS kilotokens FROM taken GROUP BY query_id)"""

ORACLES["response_footprint"] = _SIZES + """
SELECT query_id, items, chars, chunks, round(kilotokens, 6) AS kilotokens FROM sizes"""

# --- lexical -----------------------------------------------------------------------------------


def _bm25(mem: str) -> str:
    """lex(query_id, id, kind, seq, score, p)."""
    return f"""terms AS (
  SELECT id, user_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {mem}),
tf AS (SELECT id, user_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lens AS (SELECT m.id, m.user_id, count(t.term) AS len FROM {mem} m LEFT JOIN terms t USING (id) GROUP BY ALL),
users AS (SELECT user_id, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY user_id),
idf AS (
  SELECT user_id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf
  FROM (SELECT user_id, term, count(*) AS df FROM tf GROUP BY ALL) JOIN users USING (user_id)),
ask_terms AS (
  SELECT DISTINCT query_id, user_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM asks),
lex AS (
  SELECT query_id, id, seq, round(s, 9) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, seq) AS p
  FROM (SELECT query_id, tf.id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s
        FROM ask_terms JOIN idf USING (user_id, term) JOIN tf USING (user_id, term) JOIN lens USING (id)
        JOIN users ON users.user_id = tf.user_id GROUP BY ALL) JOIN mem USING (id) WHERE round(s, 9) > 0)"""


ORACLES["bm25_scores"] = _with(DOCS, _bm25("mem")) + (
    "SELECT query_id, id, round(score, 6) AS score, p FROM lex WHERE p <= 20")
ORACLES["bm25_scan"] = ORACLES["bm25_scores"]


def _rrf(weight: float, mem: str = "mem") -> str:
    raw = "raw_mem AS (SELECT * FROM mem WHERE kind = 'raw')"
    return _with(*_DOC_SCORES, raw, _bm25(mem), f"""parts AS (
  SELECT query_id, id, seq, 1.0::DOUBLE / (60 + p) AS part FROM ranked WHERE p <= 200
  UNION ALL SELECT query_id, id, seq, {weight}::DOUBLE / (60 + p) FROM lex WHERE p <= 200),
fused AS (SELECT query_id, id, seq, round(sum(part), 9) AS total FROM parts GROUP BY ALL)""") + """
SELECT query_id, id, round(total, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, seq) AS p
FROM fused QUALIFY p <= 20"""


ORACLES["rrf_fusion"] = _rrf(1.0)
ORACLES["rrf_fusion_weighted"] = _rrf(2.0)
ORACLES["rrf_fusion_raw_only"] = _rrf(0.5, "raw_mem")

ORACLES["merge_rounds"] = _with(*_DOC_SCORES, _bm25("mem"), f"""both_rounds AS (
  SELECT query_id, 0 AS turn, p, id, score FROM ranked WHERE p <= 15
  UNION ALL SELECT query_id, 1, p, id, score / 100 FROM lex WHERE p <= 15),
keyed AS (SELECT b.*, content, {_key('content')} AS key FROM both_rounds b JOIN mem USING (id)),
merged AS (
  SELECT query_id, key, id, score, content, first_value(turn * 1000 + p) OVER (PARTITION BY query_id, key ORDER BY turn, p) AS seen
  FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, turn, p) = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS pos,
         coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY score DESC, seen
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM merged)""") + """
SELECT query_id, pos, id, round(score, 6) AS score FROM placed WHERE pos < 15 AND used < 20000"""

ORACLES["second_round"] = _with(*_DOC_SCORES, """open AS (
  SELECT query_id FROM asks WHERE length(string_split('Original question: ' || query, chr(10))[1]) % 2 = 1)""",
    "again AS (SELECT 'r' AS query_id, 'what did I say before' AS query)",
    _vectors("rvec", "again", "query_id", f"'{_QUERY_PREFIX}' || query"), f"""rdots AS (
  SELECT m.key AS id, sum(r.w * m.w) AS s FROM rvec r JOIN mvec m USING (dim) GROUP BY ALL),
both_rounds AS (
  SELECT query_id, 0 AS turn, id, seq, score FROM scored
  UNION ALL
  SELECT a.query_id, 1, x.id, x.seq, round(0.5 * coalesce(d.s, 0) + 0.5 * coalesce(r.s, 0), 9)
  FROM asks a SEMI JOIN open USING (query_id) JOIN mem x USING (user_id)
  LEFT JOIN dots d ON d.query_id = a.query_id AND d.id = x.id LEFT JOIN rdots r ON r.id = x.id),
keyed AS (SELECT b.*, kind, content, {_key('content')} AS key FROM both_rounds b JOIN mem USING (id)),
firsts AS (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, turn, key ORDER BY score DESC, b.seq) = 1),
taken AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, turn ORDER BY score DESC, seq) AS p FROM firsts QUALIFY p <= 10),
merged AS (
  SELECT query_id, key, id, kind, score, content, first_value(turn * 1000 + p) OVER (PARTITION BY query_id, key ORDER BY turn, p) AS seen
  FROM taken QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, turn, p) = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS pos,
         coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY score DESC, seen
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM merged)""".replace("b.seq)", "seq)")) + """
SELECT query_id, pos, id, kind, round(score, 6) AS score FROM placed WHERE pos < 10 AND used < 400000"""

# --- evaluation ------------------------------------------------------------------------------------

EVAL = """ret AS (SELECT query_id AS question_id, p - 1 AS pos, id, kind, digest, position, seq FROM ranked WHERE p <= 100),
quest AS (
  SELECT 'q' || vec_id AS question_id, label AS category, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN [] ELSE ['v' || (vec_id + 1), 'v' || (vec_id + 10)] END AS evidence FROM embeddings),
cmap AS (SELECT digest, position, 'v' || vec_id AS dia_id FROM mem),
prov AS (
  SELECT DISTINCT r.id, c.dia_id FROM (SELECT DISTINCT id, kind, digest, position FROM ret) r
  JOIN cmap c ON c.digest = r.digest AND (r.kind = 'fact' OR c.position = r.position)),
hits AS (
  SELECT DISTINCT r.question_id, r.pos, r.kind FROM ret r JOIN prov USING (id) JOIN quest q USING (question_id)
  WHERE list_contains(q.evidence, prov.dia_id)),
found AS (
  SELECT q.question_id, q.category, min(h.pos) AS first_pos FROM quest q LEFT JOIN hits h USING (question_id)
  WHERE len(q.evidence) > 0 GROUP BY ALL),
judged AS (
  SELECT prefix, question_id, category, CASE WHEN quality IS NULL THEN NULL
         WHEN quality = 1 AND prefix >= vec_id % 60 THEN 'CORRECT' ELSE 'WRONG' END AS label
  FROM (SELECT *, unnest([1, 5, 10, 20, 40, 100]) AS prefix FROM quest LEFT JOIN labels ON doc_id = vec_id))"""

SWEEP = """swept AS (
  SELECT prefix, count(*) AS n, avg((label = 'CORRECT')::INT) AS accuracy,
         count(*) FILTER (hit) / greatest(count(hit), 1) AS coverage,
         count(*) FILTER (hit AND label = 'CORRECT') / greatest(count(*) FILTER (hit), 1) AS accuracy_given_retrieved,
         count(*) FILTER (NOT hit AND label = 'CORRECT') / greatest(count(*) FILTER (NOT hit), 1) AS accuracy_given_missed
  FROM (SELECT j.*, CASE WHEN f.question_id IS NOT NULL THEN coalesce(f.first_pos < j.prefix, FALSE) END AS hit
        FROM judged j LEFT JOIN found f USING (question_id) WHERE label IS NOT NULL) GROUP BY prefix)"""

_EVAL = _with(VECTORS, RANKED, EVAL)
_SWEEP = _with(VECTORS, RANKED, EVAL, SWEEP)

ORACLES["judge_with_caller"] = """
SELECT 'q' || vec_id AS question_id,
       CASE WHEN vec_id % 11 = 0 OR vec_id % 13 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 'CORRECT' ELSE 'WRONG' END AS label,
       CASE WHEN vec_id % 11 = 0 THEN 'JUDGE_ERROR' WHEN vec_id % 13 = 0 THEN 'I cannot tell.'
            WHEN vec_id % 3 = 0 THEN 'Verdict: CORRECT' ELSE 'Verdict: WRONG' END AS judge_raw
FROM embeddings"""
ORACLES["judged_prefixes"] = _EVAL + "SELECT prefix, count(*) AS rows FROM judged GROUP BY prefix"
ORACLES["store_tag_recall"] = _with(VECTORS, RANKED, EVAL.replace(
    "p - 1 AS pos", "p - 3 AS pos").replace("WHERE p <= 100)", "WHERE p BETWEEN 3 AND 100)")) + f"""
SELECT k, count(*) FILTER (first_pos < k) AS hits, count(*) AS n,
       round(count(*) FILTER (first_pos < k) / count(*), 6) AS recall
FROM found, (SELECT unnest({list(_CUTOFFS)}) AS k) GROUP BY k"""
ORACLES["result_provenance"] = _EVAL + "SELECT id, dia_id FROM prov"
ORACLES["join_guard"] = _EVAL + "SELECT count(DISTINCT digest) AS matching FROM ret"
ORACLES["recall_at_k"] = _EVAL + f"""
SELECT k, count(*) FILTER (first_pos < k) AS hits, count(*) AS n,
       round(count(*) FILTER (first_pos < k) / count(*), 6) AS recall
FROM found, (SELECT unnest({list(_CUTOFFS)}) AS k) GROUP BY k"""
ORACLES["recall_by_kind"] = _EVAL + """,
alone AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY question_id, kind ORDER BY pos) AS nth FROM ret QUALIFY nth <= 20),
found_by AS (
  SELECT DISTINCT a.kind, a.question_id FROM alone a JOIN prov USING (id) JOIN quest q USING (question_id)
  WHERE list_contains(q.evidence, prov.dia_id))
SELECT kind, count(f.question_id) AS hits, count(*) AS n, round(count(f.question_id) / count(*), 6) AS recall
FROM (SELECT question_id, unnest(['raw', 'fact']) AS kind FROM quest WHERE len(evidence) > 0) q
LEFT JOIN found_by f USING (kind, question_id) GROUP BY kind"""
ORACLES["recall_by_category"] = _EVAL + """
SELECT category, grouping(category)::INT AS is_total, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS recall
FROM (SELECT category, coalesce(first_pos < 20, FALSE)::INT AS hit FROM found) GROUP BY ROLLUP (category)"""
ORACLES["answer_sweep"] = _SWEEP + """
SELECT prefix, n, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage,
       round(accuracy_given_retrieved, 6) AS accuracy_given_retrieved, round(accuracy_given_missed, 6) AS accuracy_given_missed
FROM swept"""
ORACLES["best_prefix"] = _SWEEP + """
SELECT prefix, round(accuracy, 3) AS accuracy FROM swept ORDER BY round(accuracy, 3) DESC, prefix LIMIT 1"""
ORACLES["paired_flips"] = _SWEEP + """,
best AS (SELECT prefix FROM swept ORDER BY round(accuracy, 3) DESC, prefix LIMIT 1),
valid AS (SELECT prefix, question_id, label = 'CORRECT' AS ok FROM judged WHERE label IS NOT NULL)
SELECT o.prefix, b.prefix AS best, count(*) FILTER (o.ok AND NOT b.ok) AS only_other,
       count(*) FILTER (b.ok AND NOT o.ok) AS only_best, count(*) AS shared,
       count(*) FILTER (b.ok AND NOT o.ok) - count(*) FILTER (o.ok AND NOT b.ok) AS net
FROM valid o JOIN valid b USING (question_id)
WHERE b.prefix = (SELECT prefix FROM best) AND o.prefix <> b.prefix GROUP BY ALL"""
ORACLES["judge_summary"] = _EVAL + """
SELECT prefix, count(label) AS valid, count(*) FILTER (label = 'CORRECT') AS correct,
       count(*) FILTER (label IS NULL) AS excluded,
       round(count(*) FILTER (label = 'CORRECT') / greatest(count(label), 1), 6) AS accuracy,
       max(least(length(question_id || ' is ') * 100, 400)) AS longest_raw
FROM judged GROUP BY prefix"""
ORACLES["answer_inputs"] = _EVAL + """
SELECT question_id, 'Which one is ' || q.vec_id || '?' AS question,
       string_agg('memory ' || r.seq, chr(10) ORDER BY r.pos) AS context
FROM quest q JOIN ret r USING (question_id) WHERE r.pos < 5 GROUP BY question_id, q.vec_id"""
ORACLES["resume_answers"] = """
SELECT 'q' || vec_id AS question_id, CASE WHEN gap THEN '' ELSE 'answer ' || vec_id END AS generated_answer, gap, gap AS todo
FROM (SELECT vec_id, vec_id % 3 = 0 OR vec_id % 5 = 0 AS gap FROM embeddings)"""
ORACLES["reflection_inputs"] = _EVAL + """
SELECT 'q' || q.vec_id AS query_id,
       'Original question: Which one is ' || q.vec_id || '?' || chr(10) ||
       CASE WHEN q.vec_id % 2 = 0 THEN 'Answer options: yes | no' || chr(10) ELSE '' END ||
       chr(10) || 'Retrieved evidence:' || chr(10) ||
       string_agg('- memory ' || r.seq, chr(10) ORDER BY r.pos) AS prompt,
       CASE WHEN q.vec_id % 3 = 1 THEN 'Did I say ' || q.vec_id || '?' END AS follow_up
FROM quest q JOIN ret r USING (question_id) WHERE r.pos < 15 GROUP BY q.vec_id"""

ORACLES["footprint_summary"] = _SIZES + """,
acc AS (
  SELECT avg((quality = 1 AND 100 >= vec_id % 60)::INT) AS accuracy FROM embeddings JOIN labels ON doc_id = vec_id)
SELECT round(avg(items), 6) AS items, round(avg(chars), 6) AS chars, round(avg(kilotokens), 6) AS kilotokens,
       round(avg(chunks), 6) AS chunks, round(any_value(accuracy), 6) AS accuracy,
       round(any_value(accuracy) / avg(kilotokens), 6) AS accuracy_per_kilotoken
FROM sizes, acc"""

# --- corpus -----------------------------------------------------------------------------------------

CORPUS = f"""turns AS (
  SELECT conv_id::INT AS conv, (turn // 4 + 1)::INT AS session, (turn % 4)::INT AS pos,
         'D' || (turn // 4 + 1) || ':' || (turn % 4) AS dia_id, role AS speaker, text, turn FROM conversations),
based AS (
  SELECT *, CASE session WHEN 1 THEN epoch_ms(TIMESTAMP '2023-05-08 13:56:00')
                         WHEN 2 THEN epoch_ms(TIMESTAMP '2023-09-21 10:05:00') ELSE 1672531200000 END AS base,
         'local:t:locomo:conv-' || conv AS user_id,
         'local:t:locomo:conv-' || conv || ':s' || session || ':chunk-' || (pos // 3) AS request_id
  FROM turns)"""

ORACLES["corpus_turns"] = _with(CORPUS) + "SELECT conv, session, pos, dia_id, speaker, text FROM turns"
ORACLES["corpus_requests"] = _with(CORPUS) + f"""
SELECT request_id, user_id, 'local:t:conv-' || conv || ':s' || session AS session_id,
       row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS position,
       CASE speaker WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, {_strip('text')} AS content,
       base + pos * 60000 AS timestamp
FROM based"""
ORACLES["chunk_map"] = _with(CORPUS) + """
SELECT substr(sha1(user_id || chr(0) || request_id), 1, 16) AS digest, conv, dia_id,
       row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS position FROM based"""
ORACLES["eval_questions"] = _with(CORPUS) + """
SELECT 'conv' || conv || '-q' || turn AS question_id, conv, text AS question, 'a' || turn AS gold_answer,
       (turn % 5 + 1)::INT AS category, dia_id AS evidence
FROM turns WHERE turn % 5 <> 4 AND turn % 6 <> 5"""

# --- replicates --------------------------------------------------------------------------------------

REPLICATES = """runs AS (
  SELECT arm, run, 'q' || doc_id AS question_id, doc_id % 4 + 1 AS category,
         (quality = 1) <> ((doc_id * 7 + run * 3 + CASE arm WHEN 'hybrid' THEN 5 ELSE 0 END) % 11 = 0) AS ok
  FROM labels, (SELECT unnest(['control', 'hybrid']) AS arm), (SELECT unnest([1, 2, 3]) AS run)),
votes AS (
  SELECT arm, question_id, category, sum(ok::INT) * 2 > count(*) AS ok, bool_and(ok) OR NOT bool_or(ok) AS stable
  FROM runs GROUP BY ALL)"""

# P(X <= k) for X ~ Bin(n, 1/2), with factorials through lgamma.
_P_VALUE = """CASE WHEN fixes + breaks = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(
         range(0, least(fixes, breaks) + 1), lambda i: exp(lgamma(fixes + breaks + 1) - lgamma(i + 1)
         - lgamma(fixes + breaks - i + 1) - (fixes + breaks) * ln(2))))) END"""

ORACLES["run_spread"] = _with(REPLICATES) + """
SELECT arm, count(*) AS runs, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS sd, round(min(a), 6) AS worst,
       round(max(a), 6) AS best
FROM (SELECT arm, run, avg(ok::INT) AS a FROM runs GROUP BY ALL) GROUP BY arm"""

_FLIPS = """count(*) FILTER (NOT a.ok AND b.ok) AS fixes, count(*) FILTER (a.ok AND NOT b.ok) AS breaks, count(*) AS n"""

ORACLES["paired_sign_test"] = _with(REPLICATES, f"""flips AS (
  SELECT coalesce(a.category, 0) AS category, {_FLIPS}
  FROM runs a JOIN runs b USING (question_id) WHERE a.arm = 'control' AND b.arm = 'hybrid' AND a.run = 1 AND b.run = 1
  GROUP BY GROUPING SETS ((a.category), ()))""") + f"""
SELECT category, fixes, breaks, n, fixes - breaks AS net, round({_P_VALUE}, 6) AS p_value FROM flips"""

ORACLES["replicate_majority"] = _with(REPLICATES, f"""pairs AS (
  SELECT a.ok AS a_ok, b.ok AS b_ok, a.category, a.stable AND b.stable AS stable
  FROM votes a JOIN votes b USING (question_id) WHERE a.arm = 'control' AND b.arm = 'hybrid'),
flips AS (
  SELECT subset, count(*) FILTER (NOT a_ok AND b_ok) AS fixes, count(*) FILTER (a_ok AND NOT b_ok) AS breaks, count(*) AS n
  FROM (SELECT *, unnest(['all', 'stable', 'no category 2']) AS subset FROM pairs)
  WHERE subset = 'all' OR (subset = 'stable' AND stable) OR (subset = 'no category 2' AND category <> 2)
  GROUP BY subset)""") + f"""
SELECT subset, fixes, breaks, n, fixes - breaks AS net, round({_P_VALUE}, 6) AS p_value FROM flips"""
