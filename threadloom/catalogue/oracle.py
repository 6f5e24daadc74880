"""The catalogue's queries as DuckDB SQL, written from their meaning."""

from __future__ import annotations

from threadloom.functions import fixed
from threadloom.functions.text import WHITESPACE

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    """An SQL string literal, control characters spelled with chr()."""
    parts, plain = [], ""
    for c in text:
        if ord(c) < 32 or 127 <= ord(c) < 161:
            parts += ["'" + plain.replace("'", "''") + "'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c
    parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(p for p in parts if p != "''") + ")" if len(parts) > 1 else parts[0]


_WS = _q(WHITESPACE)
_STAMP = (
    "make_timestamp(2024 + (conv_id + turn // 3) % 3, 1, 1, 0, 0, 0.0)"
    " + to_hours(conv_id) + to_minutes(turn // 2)"
)
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"

_MSG = f"""msg AS (
  SELECT CASE WHEN conv_id % 2 = 1 THEN 'instagram' END AS source,
    CASE WHEN conv_id % 2 = 0 THEN 'g' END AS guild_name,
    CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id END AS channel_name,
    CASE WHEN conv_id % 2 = 1 THEN 'c' || conv_id END AS conversation_name,
    CASE WHEN conv_id % 2 = 1 THEN 'instagram_c' || conv_id ELSE 'discord_g_c' || conv_id END AS conv_key,
    'm' || conv_id || '-' || turn AS message_id, role AS author_id, role AS author_name,
    text AS content, {_STAMP} AS ts, role = 'system' AS is_bot,
    'f' || conv_id AS file_name, turn AS ordinal
  FROM conversations)"""
_ORDER = "PARTITION BY conv_key ORDER BY ts, file_name, ordinal"

# --- messages

ORACLE["source_counts"] = f"""WITH {_MSG}
SELECT coalesce(source, 'discord') AS source, count(*) AS n_messages FROM msg GROUP BY 1"""
ORACLE["year_counts"] = f"""WITH {_MSG}, y AS (SELECT *, year(ts) = 2025 AS hit FROM msg)
SELECT count(*) AS total, count(*) FILTER (hit) AS in_year,
  count(*) FILTER (hit AND source IS NULL) AS discord_in_year,
  count(*) FILTER (hit AND source = 'instagram') AS instagram_in_year,
  count(*) FILTER (hit) * 100 // count(*) AS percent FROM y"""
ORACLE["author_count"] = f"""WITH {_MSG}
SELECT count(*) AS author_messages FROM msg WHERE author_name = 'assistant' AND NOT is_bot"""
ORACLE["corpus_totals"] = f"""WITH {_MSG}
SELECT count(*) AS total_messages, count(DISTINCT file_name) AS processed_files FROM msg"""
ORACLE["channel_summary"] = f"""WITH {_MSG}
SELECT file_name, guild_name, channel_name, count(*) AS message_count FROM msg GROUP BY ALL"""

# --- pairs and datasets


def _pairs(where: str = "TRUE") -> str:
    return f"""{_MSG}, counted AS (
  SELECT *, count(*) OVER (PARTITION BY conv_key) AS n FROM msg), framed AS (
  SELECT *, string_agg(author_name || ': ' || trim(content, {_WS}), chr(10)) OVER (
    {_ORDER} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS instruction
  FROM counted WHERE {where}), pairs AS (
  SELECT conv_key, message_id, file_name, ordinal, instruction, trim(content, {_WS}) AS response
  FROM framed WHERE n > 1 AND author_name = 'assistant' AND NOT is_bot
    AND instruction IS NOT NULL), ex AS (
  SELECT md5(concat_ws('|', conv_key, message_id, file_name, ordinal)) AS example_id,
    instruction, response,
    '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) ||
    '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10) AS text
  FROM pairs)"""


_EXACT = """ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('0:' || example_id), example_id) AS place,
    count(*) OVER () AS n FROM ex), split AS (
  SELECT *, CASE WHEN place <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM ranked)"""
_DRAW = """CASE WHEN ('0x' || substr(md5('0:' || example_id), 1, 8))::BIGINT < 3865470566
  THEN 'train' ELSE 'val' END AS split"""

_PAIR_COLUMNS = "SELECT conv_key, message_id, instruction, response FROM pairs"
ORACLE["training_pairs"] = f"WITH {_pairs()} {_PAIR_COLUMNS}"
ORACLE["training_pairs_year"] = f"WITH {_pairs('year(ts) = 2025')} {_PAIR_COLUMNS}"
ORACLE["training_pairs_stored"] = ORACLE["training_pairs_year"]
ORACLE["chat_examples"] = f"""WITH {_pairs()}
SELECT example_id, 'user' AS first_role, instruction AS first_content,
  'assistant' AS second_role, response AS second_content, 2::INTEGER AS n_turns FROM ex"""
ORACLE["chat_render"] = f"WITH {_pairs()} SELECT example_id, text FROM ex"
ORACLE["hash_split"] = f"WITH {_pairs()} SELECT example_id, {_DRAW} FROM ex"
ORACLE["exact_split"] = f"WITH {_pairs()}, {_EXACT} SELECT example_id, split FROM split"
ORACLE["split_counts"] = f"""WITH {_pairs()}, {_EXACT}
SELECT split, count(*) AS n_examples FROM split GROUP BY split"""
ORACLE["chat_datasets"] = f"WITH {_pairs()} SELECT example_id, {_DRAW}, text FROM ex"

# --- sources and sinks

_HTML = f"""turns AS (SELECT *, conv_id // 25 AS block, {_STAMP} AS ts FROM conversations), html AS (
  SELECT 'discord' AS source, 'discord_Guild_block-' || block AS conv_key,
    'Guild' AS guild_name, 'block-' || block AS channel_name,
    conv_id || '-' || turn AS message_id, 'u-' || role AS author_id, role AS author_name,
    trim(text, {_WS}) || chr(10) || 'end' AS content, {_ISO.format('ts')} AS ts_raw,
    role = 'system' AS is_bot, turn // 1000 AS part, block
  FROM turns WHERE turn < 6)"""
_HTML_COLUMNS = """source, conv_key, guild_name, channel_name, message_id, author_id,
  author_name, content, ts_raw, is_bot"""
ORACLE["html_export_files"] = f"WITH {_HTML} SELECT {_HTML_COLUMNS} FROM html"
ORACLE["html_export_records"] = ORACLE["html_export_files"]
ORACLE["html_continuations"] = f"""WITH turns AS (
  SELECT *, conv_id // 25 AS block, turn // 1000 AS part, {_STAMP} AS ts,
    CASE WHEN turn < 6 THEN role END AS head FROM conversations),
carried AS (SELECT *, last_value(head IGNORE NULLS) OVER w AS author,
    last_value(CASE WHEN turn < 6 THEN ts END IGNORE NULLS) OVER w AS said
  FROM turns WINDOW w AS (PARTITION BY block, part ORDER BY conv_id, turn)),
html AS (SELECT 'discord' AS source, 'discord_Guild_block-' || block AS conv_key,
    'Guild' AS guild_name, 'block-' || block AS channel_name,
    conv_id || '-' || turn AS message_id, 'u-' || author AS author_id, author AS author_name,
    trim(text, {_WS}) || chr(10) || 'end' AS content, {_ISO.format('said')} AS ts_raw,
    author = 'system' AS is_bot
  FROM carried WHERE author IS NOT NULL)
SELECT {_HTML_COLUMNS} FROM html"""
ORACLE["html_export_channels"] = f"""WITH {_HTML}
SELECT 'Guild - Talk - block-' || block || ' [' || part || '].html' AS file_name,
  guild_name, channel_name, count(*) AS message_count FROM html
GROUP BY ALL"""

_INBOX = f"""turns AS (SELECT *, conv_id // 25 AS block, {_STAMP} AS ts,
    1 + (conv_id % 25) // 9 + 3 * (turn // 1000) AS number FROM conversations), inbox AS (
  SELECT 'instagram' AS source, 'd' || block AS dir,
    CASE WHEN number > 1 THEN 'block ' || block || ', Unknown' ELSE '' END AS conversation_name,
    CASE WHEN turn = 5 THEN 'ig_' || md5(trim(text, {_WS})) ELSE 'ig_' || epoch_ms(ts) END AS message_id,
    CASE WHEN role = 'system' THEN 'Unknown' ELSE role END AS author_name,
    trim(text, {_WS}) AS content,
    CASE WHEN turn <> 5 THEN {_ISO.format('ts')} END AS ts_raw, FALSE AS is_bot,
    'd' || block || '/message_' || number || '.json' AS file_name
  FROM turns WHERE turn NOT IN (2, 3, 4))"""
ORACLE["inbox_messages"] = f"""WITH {_INBOX}
SELECT source, 'instagram_' || conversation_name AS conv_key, conversation_name, message_id,
  author_name AS author_id, author_name, content, ts_raw, is_bot, file_name FROM inbox"""
ORACLE["inbox_conversations"] = f"""WITH {_INBOX}, big AS (
  SELECT DISTINCT 'd' || block AS dir FROM turns WHERE number > 1)
SELECT dir AS conversation_dir,
  CASE WHEN dir IN (SELECT dir FROM big) THEN replace(dir, 'd', 'block ') || '|-' END AS participants,
  CASE WHEN dir IN (SELECT dir FROM big) THEN replace(dir, 'd', 'block ') || ', Unknown' ELSE '' END AS conversation_name,
  count(*) AS message_count FROM inbox GROUP BY dir"""
_BOTH = f"{_HTML}, {_INBOX.replace('turns AS', 'turns2 AS', 1).replace('FROM turns ', 'FROM turns2 ')}"
ORACLE["merged_messages"] = f"""WITH {_BOTH}
SELECT source, conv_key, author_name, content FROM html
UNION ALL SELECT source, 'instagram_' || conversation_name, author_name, content FROM inbox"""
ORACLE["ingested_messages"] = f"""WITH {_BOTH}
SELECT source, conv_key, message_id, author_name, content, ts_raw FROM html
UNION ALL SELECT source, 'instagram_' || conversation_name, message_id, author_name, content, ts_raw FROM inbox"""
ORACLE["ingest_errors"] = f"""WITH {_BOTH}
SELECT DISTINCT 'Broken Guild - Talk - block-' || conv_id // 25 || ' [' || turn // 1000 || '].html' AS file_name,
  'not valid UTF-8' AS error FROM conversations WHERE conv_id // 25 % 3 = 2
UNION ALL SELECT DISTINCT 'd' || conv_id // 25 || '/message_99.json', 'not valid JSON'
FROM conversations WHERE conv_id // 25 % 3 = 1
UNION ALL SELECT 'html', (SELECT count(DISTINCT (block, part)) FROM html) || '/' || (SELECT count(*) FROM html)
UNION ALL SELECT 'inbox', (SELECT count(DISTINCT dir) FROM inbox) || '/' || (SELECT count(*) FROM inbox)"""
ORACLE["stream_log"] = f"""
SELECT 'live' AS source, 'discord_Guild_c' || conv_id AS conv_key, conv_id || '-' || turn AS message_id,
  role AS author_name, text AS content, strftime({_STAMP}, '%Y-%m-%dT%H:%M:%S') AS ts_raw,
  role = 'system' AS is_bot FROM conversations"""
ORACLE["union_messages"] = f"""WITH {_BOTH}
SELECT source, guild_name, NULL AS conversation_name, author_name, content FROM html
UNION ALL SELECT source, NULL, conversation_name, author_name, content FROM inbox"""
ORACLE["conversation_files"] = f"""WITH {_MSG}
SELECT coalesce(source, 'discord') AS source, conv_key, count(*) AS n_messages,
  sum(length(content))::BIGINT AS n_chars FROM msg GROUP BY 1, 2"""
ORACLE["message_json"] = f"""WITH {_MSG}
SELECT conv_key, message_id, content, year(ts) = 2025 AS in_year FROM msg"""
ORACLE["export_times"] = f"""
SELECT event_id, CASE
  WHEN event_type IN ('view', 'signup') THEN {_ISO.format("date_trunc('minute', ts)")}
  WHEN event_type IN ('click', 'purchase') THEN {_ISO.format("date_trunc('second', ts)")}
  ELSE 'soon ' || event_id END AS ts_raw FROM events"""

# --- documents and sections


def _message_documents(doc_id: str) -> str:
    return f"""WITH {_MSG}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, file_name, ordinal) - 1 AS i FROM msg)
SELECT {doc_id} AS id, author_name || ': ' || trim(content, {_WS}) AS document, message_id,
  author_id, author_name, coalesce(channel_name, 'Unknown') AS channel_name,
  coalesce(guild_name, 'Unknown') AS guild_name, {_ISO.format('ts')} AS timestamp,
  'discord_message' AS type
FROM numbered WHERE NOT is_bot AND trim(content, {_WS}) <> ''"""


ORACLE["message_documents"] = _message_documents(
    "sha256(coalesce(source, '') || '|' || conv_key || '|' || message_id || '|' || file_name"
    " || '|' || ordinal)"
)
ORACLE["message_documents_numbered"] = _message_documents("'discord_msg_' || i")

_SECTIONS = f"""md AS (
  SELECT '/docs/source/a/b/d' || doc_id || '.md' AS source_path, 'a/b/d' || doc_id || '.md' AS path,
    'd' || doc_id AS stem,
    string_split(regexp_replace(text, '(?m)^([^\\n]{{1,40}}\\.)$', '## \\1', 'g'), chr(10)) AS lines
  FROM documents), line AS (
  SELECT source_path, path, stem, unnest(lines) AS t, generate_subscripts(lines, 1) AS line_no FROM md), marked AS (
  SELECT *, regexp_matches(t, '^#{{1,6}}\\s+.') AS heading FROM line), placed AS (
  SELECT *, sum(heading::INT) OVER (PARTITION BY source_path ORDER BY line_no) AS section_no FROM marked), cut AS (
  SELECT source_path, path, section_no::INTEGER AS section_no,
    coalesce(max(CASE WHEN heading THEN length(regexp_extract(t, '^(#{{1,6}})\\s', 1)) END), 0)::INTEGER AS level,
    coalesce(max(CASE WHEN heading THEN trim(regexp_extract(t, '^#{{1,6}}\\s+(.+)$', 1), {_WS}) END), min(stem)) AS title,
    string_agg(CASE WHEN NOT heading THEN t || chr(10) END, '' ORDER BY line_no) AS content
  FROM placed GROUP BY ALL), sections AS (
  SELECT * FROM cut WHERE trim(content, {_WS}) <> ''), docs AS (
  SELECT *, '# ' || title || chr(10) || chr(10) || trim(content, {_WS}) AS document FROM sections)"""
ORACLE["doc_sections"] = (
    f"WITH {_SECTIONS} SELECT path, section_no, level, title, content FROM sections"
)
ORACLE["section_documents"] = f"""WITH {_SECTIONS}
SELECT sha256('doc|' || source_path || '|' || section_no) AS id, document, title,
  path AS file_path, 'wpilib_documentation' AS type, 'WPILib FRC Documentation' AS source
FROM docs WHERE length(document) >= 50"""
ORACLE["section_documents_numbered"] = f"""WITH {_SECTIONS}
SELECT 'wpilib_doc_' || (row_number() OVER (ORDER BY source_path, section_no) - 1) AS id,
  document, title, path AS file_path FROM docs WHERE length(document) >= 50"""

_MARKDOWN = "regexp_replace(text, '(?m)^([^\\n]{1,40}\\.)$', '## \\1', 'g')"
ORACLE["doc_tree"] = f"""WITH guide AS (
  SELECT doc_id // 50 AS guide, string_split(string_agg({_MARKDOWN}, chr(10) ORDER BY doc_id), chr(10)) AS lines
  FROM documents GROUP BY 1), line AS (
  SELECT guide, unnest(lines) AS t, generate_subscripts(lines, 1) AS n FROM guide), placed AS (
  SELECT *, sum(regexp_matches(t, '^#{{1,6}}\\s+.')::INT) OVER (PARTITION BY guide ORDER BY n) AS s FROM line), cut AS (
  SELECT guide, s::INTEGER AS section_no, CASE WHEN s > 0 THEN length(regexp_extract(min_by(t, n), '^#+')) ELSE 0 END::INTEGER AS level,
    CASE WHEN s > 0 THEN trim(regexp_extract(min_by(t, n), '^#+\\s+(.+)$', 1), {_WS}) END AS title,
    string_agg(t || chr(10), '' ORDER BY n) FILTER (NOT regexp_matches(t, '^#{{1,6}}\\s+.')) AS content
  FROM placed GROUP BY guide, s)
SELECT guide, section_no, level, title, trim(content, {_WS}) AS content FROM cut
WHERE trim(content, {_WS}) <> ''"""

# --- vectors

_COLLECTION = """col AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, coalesce(text, '') AS document,
    CASE WHEN label < 5 THEN 'discord_message' ELSE 'wpilib_documentation' END AS type,
    CASE WHEN label < 5 THEN 'ch' || label END AS channel_name,
    CASE WHEN label >= 5 THEN 'T' || label END AS title
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
_VECTOR_QUERIES = """q AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, '' AS qtext FROM embeddings)"""
_QUESTIONS = """q AS (
  SELECT item_id AS query_id, embedding::DOUBLE[] AS qv, replace(text, 'hein', 'Motor') AS qtext
  FROM benchmark JOIN embeddings ON vec_id = item_id)"""


def _hits(where: str = "TRUE", per: str = "query_id") -> str:
    return f"""sims AS (
  SELECT query_id, id, type, round(list_cosine_similarity(qv, v), 9) AS s
  FROM q, col WHERE {where}), hits AS (
  SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY s DESC, id)::INTEGER AS rank FROM sims)"""


ORACLE["search_exact"] = f"""WITH {_COLLECTION}, {_VECTOR_QUERIES}, {_hits()}
SELECT query_id, id, round(s, 4) AS similarity, rank FROM hits WHERE rank <= 5"""
ORACLE["search_tiles"] = ORACLE["search_exact"]
ORACLE["search_all_cells"] = ORACLE["search_exact"]
ORACLE["search_cells"] = ORACLE["search_exact"]
ORACLE["search_cell_tiles"] = ORACLE["search_cells"]
ORACLE["search_filtered"] = f"""WITH {_COLLECTION}, {_VECTOR_QUERIES},
{_hits("type = 'discord_message' AND channel_name = 'ch3'")}
SELECT query_id, id, round(s, 4) AS similarity, rank FROM hits WHERE rank <= 3 AND s >= 0.05"""
ORACLE["search_by_type"] = f"""WITH {_COLLECTION}, {_VECTOR_QUERIES}, {_hits(per='query_id, type')}
SELECT query_id, type, id, round(s, 4) AS similarity, rank FROM hits
WHERE rank <= CASE WHEN type = 'discord_message' THEN 3 ELSE 2 END"""
ORACLE["embed_hashed"] = f"""
SELECT doc_id, 256::INTEGER AS dimensions, 1.0::DOUBLE AS squares,
  len(string_split_regex(rtrim(lower(text), {_WS}), '\\s')) AS n_words FROM documents"""
_LETTERS = "[" + ", ".join(
    f"len(coalesce(text, '')) - len(replace(replace(coalesce(text, ''), '{c}', ''), '{c.upper()}', ''))"
    for c in "abcdefghijklmnopqrstuvwxyz") + "]"
ORACLE["embed_model"] = f"SELECT doc_id, array_to_string({_LETTERS}, ',') AS vector FROM documents"
ORACLE["search_embedded"] = f"""WITH
col AS (SELECT doc_id AS id, {_LETTERS}::DOUBLE[] AS v FROM documents),
q AS (SELECT item_id AS query_id, {_LETTERS}::DOUBLE[] AS qv FROM benchmark),
sims AS (SELECT query_id, id, CASE WHEN list_sum(v) = 0 OR list_sum(qv) = 0 THEN 0
    ELSE round(list_cosine_similarity(qv, v), 9) END AS s FROM q, col),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank FROM sims)
SELECT query_id, id, round(s, 4) AS similarity, rank FROM hits WHERE rank <= 3"""
_BITS = 4294967296


def _number(hex_bytes: str) -> str:
    """Eight hex digits as a number, lowest byte first."""
    return "('0x' || " + " || ".join(f"substr({hex_bytes}, {i}, 2)" for i in (7, 5, 3, 1)) + ")::HUGEINT"


def _turned(number: str, bits: int) -> str:
    return f"(({number}) * {1 << bits} % {_BITS} + ({number}) // {1 << (32 - bits)})"


def _mixed(number: str) -> str:
    return f"({_turned(f'({number}) * 3432918353 % {_BITS}', 15)} * 461845907 % {_BITS})"


# The 32-bit hash of a word, from its UTF-8 bytes in hex (x), by whole blocks of four and a rest.
_HASHED = f"""hexed AS (SELECT DISTINCT w, hex(encode(w)) AS x, len(hex(encode(w))) // 2 AS n FROM words),
blocks AS (SELECT w, x, n, list_reduce(list_transform(range(0, n // 4), lambda i: {_mixed(_number('substr(x, (8 * i + 1)::BIGINT, 8)'))}),
    lambda h, m: ({_turned('xor(h, m)', 13)} * 5 + 3864292196) % {_BITS}, 42::HUGEINT) AS h FROM hexed),
rest AS (SELECT w, xor(CASE WHEN n % 4 = 0 THEN h ELSE xor(h, {_mixed(_number("rpad(substr(x, 8 * (n // 4) + 1), 8, '0')"))}) END,
    n::HUGEINT) AS h FROM blocks),
once AS (SELECT w, xor(h, h // 65536) * 2246822507 % {_BITS} AS h FROM rest),
twice AS (SELECT w, xor(h, h // 8192) * 3266489909 % {_BITS} AS h FROM once),
buckets AS (SELECT w, xor(h, h // 65536) % 256 AS bucket FROM twice)"""
ORACLE["search_weighted"] = f"""WITH
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(string_split_regex(rtrim(lower(coalesce(text, '')), {_WS}), '\s')) AS w FROM texts),
{_HASHED},
counts AS (SELECT side, id, bucket, count(*) AS c FROM words JOIN buckets USING (w) GROUP BY ALL),
spread AS (SELECT bucket, count(*) AS d FROM counts WHERE side = 'd' GROUP BY bucket),
weighted AS (SELECT side, id, bucket, c * ln(((SELECT count(*) FROM documents) + 1) / (coalesce(d, 0) + 1)::DOUBLE) AS v
  FROM counts LEFT JOIN spread USING (bucket)),
units AS (SELECT side, id, bucket, (v / sqrt(sum(v * v) OVER (PARTITION BY side, id)))::FLOAT::DOUBLE AS u FROM weighted
  QUALIFY sum(v * v) OVER (PARTITION BY side, id) > 0),
norms AS (SELECT side, id, sqrt(sum(u * u)) AS norm FROM units GROUP BY ALL),
dots AS (SELECT q.id AS query_id, d.id, sum(q.u * d.u) AS dot FROM units q JOIN units d USING (bucket)
  WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL),
sims AS (SELECT query_id, dots.id, round(dot / (a.norm * b.norm), 9) AS s FROM dots
  JOIN norms a ON a.side = 'q' AND a.id = query_id JOIN norms b ON b.side = 'd' AND b.id = dots.id),
every AS (SELECT item_id AS query_id, doc_id AS id, coalesce(s, 0) AS s FROM benchmark CROSS JOIN documents
  LEFT JOIN sims ON sims.query_id = item_id AND sims.id = doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank FROM every)
SELECT query_id, id, round(s, 4) AS similarity, rank FROM hits WHERE rank <= 3"""
ORACLE["rebuilt_collection"] = f"""WITH {_MSG}
SELECT count(*) AS n_documents FROM msg WHERE NOT is_bot AND trim(content, {_WS}) <> ''"""
ORACLE["incremental_add"] = f"WITH {_COLLECTION} SELECT id, type, document FROM col"

# --- retrieval

_FILTERED_LINE = """CASE WHEN type = 'discord_message' THEN '[' || channel_name || '] ' || document
  ELSE '[WPILib] ' || title || ': ' || left(document, 150) || '...' END"""
_WANTS_DOCS = "(" + " OR ".join(
    f"contains(lower(qtext), '{k}')" for k in fixed.DOCS_KEYWORDS) + ")"
ORACLE["retrieve_default"] = f"""WITH {_COLLECTION}, {_QUESTIONS}, {_hits()}
SELECT query_id, rank, id,
  CASE WHEN type = 'discord_message' THEN '[' || channel_name || '] ' || document
  ELSE '[WPILib Docs: ' || title || '] ' || left(document, 200) || '...' END AS context
FROM hits JOIN col USING (id, type) WHERE rank <= 2"""
ORACLE["retrieve_filtered"] = f"""WITH {_COLLECTION}, {_QUESTIONS},
{_hits("type = 'discord_message' AND channel_name = 'ch2'")}
SELECT query_id, rank, id, {_FILTERED_LINE} AS context
FROM hits JOIN col USING (id, type) WHERE rank <= 4"""


def _mixed(glue: str, header: str = "''") -> str:
    return f"""{_hits(f"(type = 'discord_message' OR {_WANTS_DOCS})", 'query_id, type')}, mixed AS (
  SELECT query_id, string_agg({header} || {_FILTERED_LINE}, {glue} ORDER BY type, rank) AS contexts
  FROM hits JOIN col USING (id, type)
  WHERE rank <= CASE WHEN type = 'discord_message' THEN 3 ELSE 2 END GROUP BY query_id)"""


ORACLE["mixed_context"] = f"""WITH {_COLLECTION}, {_QUESTIONS},
{_mixed("chr(10) || '---' || chr(10)")} SELECT query_id, contexts FROM mixed"""

ORACLE["mixed_context_cells"] = ORACLE["mixed_context"]

# --- history, memory and prompts

ORACLE["channel_history"] = """WITH seen AS (
  SELECT event_id, user_id AS channel, event_type, string_agg(
    CASE WHEN event_type <> 'error' THEN event_type || ': ' || props END, chr(10)) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h
  FROM events)
SELECT event_id, channel, coalesce(h, '') AS history FROM seen WHERE event_type = 'purchase'"""
ORACLE["stream_history"] = ORACLE["channel_history"]

_MEMORY = f"""memory AS (
  SELECT *, string_agg(CASE WHEN author_name = 'user' THEN 'You: ' ELSE 'Bot: ' END || content,
    chr(10)) OVER ({_ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS memory FROM msg)"""
ORACLE["rolling_memory"] = f"""WITH {_MSG}, {_MEMORY}
SELECT message_id, coalesce(memory, '') AS memory FROM memory WHERE author_name = 'user'"""

_SERVICE = _q(fixed.SERVICE_SYSTEM_TEXT.format(name="Botty"))


def _prompt(system: str, history: str, contexts: str, user: str) -> str:
    return f"""'<|im_start|>system' || chr(10) || {system}
  || coalesce(chr(10) || chr(10) || 'Recent conversation:' || chr(10) || {history} || chr(10), '')
  || coalesce(chr(10) || chr(10) || 'Relevant context:' || chr(10) || {contexts} || chr(10), '')
  || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {user}
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"""


ORACLE["prompt_tester"] = f"""WITH {_MSG}, {_MEMORY}
SELECT message_id, {_prompt(_q(fixed.TESTER_SYSTEM_TEXT), 'memory', 'NULL', 'content')} AS prompt
FROM memory WHERE author_name = 'user'"""
ORACLE["prompt_assembly"] = f"""WITH {_MSG}, {_COLLECTION}, seen AS (
  SELECT *, string_agg(CASE WHEN NOT is_bot THEN author_name || ': ' || content END, chr(10)) OVER (
    {_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history,
    replace(content, 'oua', 'robot') AS user_text FROM msg), q AS (
  SELECT message_id AS query_id, user_text AS qtext, embedding::DOUBLE[] AS qv
  FROM seen JOIN embeddings ON vec_id = regexp_extract(message_id, 'm(\\d+)-', 1)::BIGINT
  WHERE author_name = 'user'),
{_mixed('chr(10)', "'- '")}
SELECT message_id AS request_id, {_prompt(_SERVICE, 'history', 'contexts', 'user_text')} AS prompt
FROM seen LEFT JOIN mixed ON query_id = message_id WHERE author_name = 'user'"""

# --- replies


def _cut(raw: str) -> str:
    for marker in ("<|im_end|>", "<|im_start|>", "> EOF by user"):
        raw = f"trim(split_part({raw}, '{marker}', 1), {_WS})"
    return raw


def _repair(raw: str) -> str:
    for bad, good in fixed.MOJIBAKE:
        raw = f"replace({raw}, {_q(bad)}, {_q(good)})"
    return raw


def _echo(raw: str) -> str:
    phrases = [p.format(name="botty") for p in fixed.ECHO_PHRASES]
    return "(" + " OR ".join(f"starts_with(lower({raw}), '{p}')" for p in phrases) + ")"


_BAD = _q("â\u0080\u0099")
_QUOTE = _q("â\u0080\u009c")
_RAW = f"""raws AS (SELECT conv_id, turn, CASE turn
  WHEN 0 THEN text || '<|im_end|>' || text
  WHEN 1 THEN chr(10) || text || '<|im_start|>user'
  WHEN 2 THEN ' You Are Botty ' || text
  WHEN 3 THEN 'donât itâs ' || text || {_BAD}
  WHEN 4 THEN text || '> EOF by user' || text
  ELSE replace(text, 'e', {_QUOTE}) END AS raw FROM conversations)"""
ORACLE["reply_cleanup"] = f"""WITH {_RAW}, cut AS (SELECT *, {_cut('raw')} AS c FROM raws)
SELECT conv_id, turn, CASE WHEN {_echo('c')} THEN 'what' ELSE {_repair('c')} END AS reply FROM cut"""
ORACLE["reply_steps"] = f"""WITH {_RAW}
SELECT conv_id, turn, {_cut('raw')} AS cut, {_echo(f'trim(raw, {_WS})')} AS echo,
  {_repair('raw')} AS repaired FROM raws"""
ORACLE["reply_cap"] = """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END AS reply
FROM documents"""
ORACLE["assistant_turn"] = f"""
SELECT conv_id, turn, trim(text, {_WS}) AS reply FROM conversations"""
_IMAGES = """raws AS (SELECT conv_id, turn, CASE turn
  WHEN 0 THEN text || chr(10) || '@meta  AI /Imagine ' || text
  WHEN 1 THEN '/imagine ' || text
  WHEN 3 THEN 'x /IMAGINE' || text
  WHEN 4 THEN 'a /imagine  @Meta AI /imagine b ' || text ELSE text END AS raw FROM conversations)"""


def _jobs(raw: str) -> str:
    found = f"""trim(coalesce(
    nullif(regexp_extract({raw}, '(?i)@Meta\\s+AI\\s+/imagine\\s+(.+)', 1), ''),
    nullif(regexp_extract({raw}, '(?i)/imagine\\s+(.+)', 1), '')), {_WS})"""
    cleaned = f"""left(trim(regexp_replace(regexp_replace({found}, '(?i)@Meta AI', '', 'g'),
    '(?i)/imagine', '', 'g'), {_WS}), 200)"""
    slug = f"""regexp_replace(left(regexp_replace({cleaned}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), 50),
    '[-\\s]+', '-', 'g') || '.png'"""
    return f"{found} AS image_prompt, {cleaned} AS prompt, {slug} AS file_name"


ORACLE["image_commands"] = f"""WITH {_IMAGES}
SELECT conv_id, turn, {_jobs('raw')} FROM raws"""

_LIVE = f"""live AS (SELECT conv_id, turn, 'm' || conv_id || '-' || turn AS message_id,
  'c' || conv_id AS channel, {_STAMP} AS ts, CASE WHEN turn < 2 THEN 0 WHEN turn < 4 THEN 1 ELSE 2 END AS batch,
  CASE WHEN role = 'system' THEN '42' ELSE role END AS author, role = 'system' AS is_bot,
  CASE turn WHEN 0 THEN '<@42>' WHEN 1 THEN 'hi <@!42> ' || text WHEN 2 THEN '!ask ' || text
    WHEN 3 THEN '!ask' WHEN 4 THEN '!asking ' || text WHEN 5 THEN '!ask <@42> now'
    ELSE text END AS content, text FROM conversations), pulled AS (
  SELECT *, 'mention' AS trigger, CASE turn WHEN 0 THEN 'Hey, what''s up?'
    WHEN 1 THEN 'hi  ' || trim(text, {_WS}) ELSE '!ask  now' END AS user_text
  FROM live WHERE turn IN (0, 1, 5) AND author <> '42'
  UNION ALL SELECT *, 'command', CASE turn WHEN 2 THEN trim(text, {_WS}) ELSE '<@42> now' END
  FROM live WHERE turn IN (2, 5) AND author <> '42')"""
ORACLE["triggers"] = f"WITH {_LIVE} SELECT message_id, trigger, user_text FROM pulled"
ORACLE["stream_replies"] = f"""WITH {_LIVE}, {_COLLECTION}, before AS (
  SELECT p.message_id, p.trigger, l.ts, l.turn, l.is_bot, l.author, l.content, row_number() OVER (
    PARTITION BY p.message_id, p.trigger ORDER BY l.ts DESC, l.turn DESC) AS back
  FROM pulled p JOIN live l ON l.conv_id = p.conv_id AND l.batch <= p.batch
    AND (l.ts, l.turn) < (p.ts, p.turn)), hist AS (
  SELECT message_id, trigger, string_agg(
    CASE WHEN NOT is_bot THEN author || ': ' || content END, chr(10) ORDER BY ts, turn) AS history
  FROM before WHERE back <= 5 GROUP BY 1, 2), q AS (
  SELECT message_id || '/' || trigger AS query_id, user_text AS qtext, embedding::DOUBLE[] AS qv
  FROM pulled JOIN embeddings ON vec_id = conv_id),
{_mixed('chr(10)', "'- '")}, asked AS (
  SELECT message_id || '/' || trigger AS request_id, trigger, user_text,
    {_prompt(_SERVICE, 'history', 'contexts', 'user_text')} AS prompt
  FROM pulled LEFT JOIN hist USING (message_id, trigger)
  LEFT JOIN mixed ON query_id = message_id || '/' || trigger), raws AS (
  SELECT request_id, CASE WHEN trigger = 'command' THEN '/imagine ' ELSE '' END
    || user_text || ' / ' || length(prompt) AS raw FROM asked), jobs AS (
  SELECT request_id, raw, {_jobs('raw')} FROM raws)
SELECT request_id, CASE WHEN length(raw) > 300 THEN left(raw, 297) || '...' ELSE raw END AS reply,
  prompt, CASE WHEN image_prompt IS NOT NULL THEN file_name END AS file_name FROM jobs"""
