"""The same queries in plain SQL."""

from __future__ import annotations

from lodestrata.functions.ids import PARENT_NAMESPACE

_EXT = "CASE WHEN source = 'src1' THEN 'pptx' WHEN lang = 'en' THEN 'md' WHEN lang = 'fr' THEN 'txt' WHEN lang = 'de' THEN 'docx' ELSE 'pdf' END"

_FILES = f"""
files AS (
  SELECT doc_id, source AS workspace_id, 'doc-' || doc_id || '.' || {_EXT} AS file_name, {_EXT} AS file_type, lang,
         coalesce(text, '') AS text, n_chars
  FROM documents WHERE doc_id IS NOT NULL
)"""

_CHANGES = (
    _FILES
    + """,
deleted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
disk AS (
  SELECT workspace_id, file_name, file_type,
         CASE WHEN file_type = 'pptx' THEN 'unsupported' WHEN workspace_id = 'src2' THEN 'unreadable' ELSE 'ok' END AS scan_state,
         sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size_bytes
  FROM files WHERE NOT (lang = 'fr' AND doc_id IN (SELECT doc_id FROM deleted))
),
toxic AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
registered AS (
  SELECT 'd' || f.doc_id AS id, workspace_id, file_name, file_type,
         CASE WHEN toxic = 1 THEN 'sha256:' || sha256(text || 'x') || ':' || strlen(text)
              WHEN lang = 'de' THEN 'sha256:' || sha256(text) || ':' || (strlen(text) + 1)
              WHEN lang = 'es' THEN 'sha256:garbage' ELSE 'sha256:' || sha256(text) || ':' || strlen(text) END AS content_hash,
         CAST(ceil(n_chars / 3000.0) AS INTEGER) AS page_count,
         CASE workspace_id WHEN 'src3' THEN 'removed' WHEN 'src4' THEN 'failed' WHEN 'src5' THEN 'skipped' ELSE 'active' END AS status
  FROM files f JOIN toxic USING (doc_id)
),
changes AS (
  SELECT d.workspace_id, d.file_name,
         CASE WHEN r.id IS NULL OR r.status = 'removed' THEN 'new'
              WHEN r.content_hash = 'sha256:' || d.digest || ':' || d.size_bytes THEN 'unchanged' ELSE 'changed' END AS change,
         d.file_type, d.digest, d.size_bytes, r.id AS document_id
  FROM disk d LEFT JOIN registered r ON r.workspace_id = d.workspace_id AND r.file_name = d.file_name WHERE d.scan_state = 'ok'
  UNION ALL
  SELECT r.workspace_id, r.file_name, 'removed', r.file_type, NULL, NULL, r.id
  FROM registered r WHERE r.status <> 'removed' AND NOT EXISTS (
    SELECT 1 FROM disk d WHERE d.workspace_id = r.workspace_id AND d.file_name = r.file_name AND d.scan_state <> 'unsupported')
),
items AS (
  SELECT c.workspace_id || '/' || c.file_name AS id, c.workspace_id AS sync_run_id, c.document_id, c.file_name,
         CASE WHEN change IN ('unchanged', 'removed') THEN change WHEN trim(f.text, ' ') = '' THEN 'skipped'
              WHEN f.file_type IN ('pdf', 'docx') AND length(f.text) < 200 THEN 'failed' WHEN change = 'new' THEN 'added' ELSE 'changed' END AS result,
         CASE WHEN change IN ('unchanged', 'removed') THEN NULL WHEN trim(f.text, ' ') = '' THEN 'was skipped'
              WHEN f.file_type IN ('pdf', 'docx') AND length(f.text) < 200 THEN 'was failed' END AS reason
  FROM changes c JOIN files f ON f.workspace_id = c.workspace_id AND f.file_name = c.file_name
)"""
)

_MARKDOWN = (
    _FILES
    + """,
parts AS (
  SELECT doc_id, file_name, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM files
),
markdown AS (
  SELECT doc_id, file_name AS source_file, '# doc ' || doc_id || chr(10) || chr(10)
         || string_agg(CASE WHEN i % 3 = 2 THEN '## s' || i || chr(10) || chr(10) || part ELSE part END, chr(10) || chr(10) ORDER BY i) AS markdown
  FROM parts GROUP BY doc_id, file_name
),
rows AS (
  SELECT doc_id, source_file, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM markdown
),
heads AS (
  SELECT *, CASE WHEN regexp_matches(line, '^#{1,3}[ \\t]+.*[^ \\t]') THEN regexp_extract(line, '^#{1,3}[ \\t]+(.*[^ \\t])[ \\t]*$', 1) END AS label FROM rows
),
numbered AS (SELECT *, count(label) OVER (PARTITION BY doc_id, source_file ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM heads),
bodies AS (
  SELECT doc_id, source_file, k, max(label) AS label, trim(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (label IS NULL), ''), ' ' || chr(9) || chr(10)) AS text
  FROM numbered GROUP BY doc_id, source_file, k
),
sections AS (
  SELECT doc_id, source_file, row_number() OVER (PARTITION BY doc_id, source_file ORDER BY k) AS section, label, text FROM bodies WHERE text <> ''
),
fold AS (
  SELECT doc_id, source_file, section, label, text, CAST(0 AS BIGINT) AS grp, CAST(length(text) AS BIGINT) AS held FROM sections WHERE section = 1
  UNION ALL
  SELECT s.doc_id, s.source_file, s.section, s.label, s.text, f.grp + CASE WHEN f.held >= 2000 THEN 1 ELSE 0 END,
         CASE WHEN f.held >= 2000 THEN 0 ELSE f.held END + length(s.text)
  FROM fold f JOIN sections s ON s.doc_id = f.doc_id AND s.source_file = f.source_file AND s.section = f.section + 1
),
sizes AS (SELECT doc_id, source_file, grp, sum(length(text)) AS n FROM fold GROUP BY ALL),
final AS (
  SELECT f.*, CASE WHEN z.n < 2000 AND f.grp > 0 THEN f.grp - 1 ELSE f.grp END AS g FROM fold f JOIN sizes z USING (doc_id, source_file, grp)
),
merged AS (
  SELECT doc_id, source_file, g AS parent,
         CASE WHEN arg_min(label, section) FILTER (label IS NOT NULL) = arg_max(label, section) FILTER (label IS NOT NULL) THEN arg_min(label, section) FILTER (label IS NOT NULL)
              ELSE arg_min(label, section) FILTER (label IS NOT NULL) || ' ... ' || arg_max(label, section) FILTER (label IS NOT NULL) END AS label,
         string_agg(text, chr(10) || chr(10) ORDER BY section) AS text
  FROM final GROUP BY doc_id, source_file, g
)"""
)


def _packed(source: str) -> str:
    """CTEs ``pieces`` (key, piece, text) from a CTE of rows (key, text) by a fold over paragraphs."""
    return f"""
paragraphs AS (
  SELECT key, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n
  FROM {source} WHERE length(text) > 4000
),
steps AS (
  SELECT key, CAST(0 AS BIGINT) AS n, '' AS held, CAST([] AS VARCHAR[]) AS out FROM paragraphs WHERE n = 1
  UNION ALL
  SELECT s.key, q.n,
         CASE WHEN length(CASE WHEN s.held = '' THEN q.p ELSE s.held || chr(10) || chr(10) || q.p END) <= 4000
              THEN CASE WHEN s.held = '' THEN q.p ELSE s.held || chr(10) || chr(10) || q.p END
              ELSE substring(q.p, CAST(greatest((length(q.p) - 1) // 4000, 0) * 4000 + 1 AS BIGINT)) END,
         CASE WHEN length(CASE WHEN s.held = '' THEN q.p ELSE s.held || chr(10) || chr(10) || q.p END) <= 4000 THEN CAST([] AS VARCHAR[])
              ELSE list_concat(CASE WHEN s.held = '' THEN CAST([] AS VARCHAR[]) ELSE [s.held] END,
                list_transform(range(greatest((length(q.p) - 1) // 4000, 0)), lambda i: substring(q.p, CAST(i * 4000 + 1 AS BIGINT), 4000))) END
  FROM steps s JOIN paragraphs q ON q.key = s.key AND q.n = s.n + 1
),
outs AS (
  SELECT key, n, 0 AS last, unnest(out) AS text, generate_subscripts(out, 1) AS j FROM steps
  UNION ALL SELECT key, n, 1, held, 0 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM steps) WHERE r = 1 AND held <> ''
),
pieces AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY n, last, j) - 1 AS piece, text FROM outs
  UNION ALL SELECT key, 0, text FROM {source} WHERE length(text) <= 4000
)"""


_UUID = """
lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', CAST(((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""
_SHA = f"sha1(from_hex('{PARENT_NAMESPACE.hex}') || encode(%s || chr(0) || %s))"
_WINDOWS = "list_transform(range(CAST(greatest(ceil((length(text) - 500) / 400.0), 0) AS BIGINT) + 1), lambda i: substring(text, CAST(i * 400 + 1 AS BIGINT), 500))"

_PARENTS = (
    _MARKDOWN
    + ",\nkeyed AS (SELECT {'doc_id': doc_id, 'source_file': source_file, 'parent': parent, 'label': label} AS key, text FROM merged),"
    + _packed("keyed")
    + f""",
ordered AS (
  SELECT key.doc_id AS doc_id, key.source_file AS source_file, CAST(row_number() OVER (PARTITION BY key.doc_id, key.source_file ORDER BY key.parent, piece) - 1 AS INTEGER) AS parent_index,
         key.label AS section_label, text FROM pieces
),
parents AS (
  SELECT doc_id, source_file, parent_index, {_UUID} AS parent_id, section_label, text
  FROM (SELECT *, {_SHA % ("source_file", "parent_index")} AS h FROM ordered)
)"""
)

_DENSE = """
vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS label, list_dot_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON c.label = q.label WHERE q.vec_id % 20 = 0
),
dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5
)"""


def _bm25(k: int) -> str:
    """CTE ``sparse`` from CTEs ``chunks`` (chunk_id, workspace_id, text) and ``questions`` (query_id, workspace_id, text)."""
    return f"""
tokens AS (SELECT chunk_id, workspace_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ts FROM chunks),
lengths AS (SELECT workspace_id, count(*) AS n, avg(len(ts)) AS mean FROM tokens GROUP BY workspace_id),
postings AS (
  SELECT chunk_id, workspace_id, term, length, count(*) AS tf
  FROM (SELECT chunk_id, workspace_id, len(ts) AS length, unnest(ts) AS term FROM tokens) GROUP BY ALL
),
asked AS (SELECT query_id, workspace_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM questions),
dfs AS (SELECT workspace_id, term, count(*) AS df FROM postings GROUP BY ALL),
sums AS (
  SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
  FROM asked JOIN postings USING (workspace_id, term) JOIN dfs USING (workspace_id, term) JOIN lengths USING (workspace_id) GROUP BY query_id, chunk_id
),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sums) WHERE rank <= {k})"""


_HYBRID = (
    """
chunks AS (
  SELECT doc_id AS chunk_id, lang AS workspace_id, source, coalesce(text, '') AS text, embedding::DOUBLE[] AS v
  FROM documents JOIN embeddings ON vec_id = doc_id
),
questions AS (SELECT chunk_id AS query_id, workspace_id, text, v FROM chunks WHERE chunk_id % 20 = 0),
near AS (
  SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q.v, c.v) DESC, chunk_id) AS rank
    FROM questions q JOIN chunks c USING (workspace_id)) WHERE rank <= 20
),"""
    + _bm25(20)
    + """,
fused AS (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score
  FROM (SELECT query_id, chunk_id, rank FROM near UNION ALL SELECT query_id, chunk_id, rank FROM sparse) GROUP BY ALL
),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM fused) WHERE rank <= 5)"""
)

_EVALUATIONS = """
questions AS (
  SELECT source AS eval_run_id, CAST(doc_id AS VARCHAR) AS question_id, toxic = 0 AS inside, CASE WHEN toxic = 0 THEN (n_chars % 101 + 899) / 1000.0 END AS groundedness,
         CASE WHEN toxic = 0 THEN (n_chars % 89) / 100.0 END AS relevancy, quality = 1 AS passed, n_chars > 300 AS sourced
  FROM labels JOIN documents USING (doc_id)
)"""

_COUNTS = ", ".join(f"CAST(count(*) FILTER (result = '{r}') AS INTEGER) AS {r}" for r in ("added", "changed", "unchanged", "failed", "removed", "skipped"))

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1).replace(r"\s", r"\t\n\v\f\r ")
_STRIPPED = "trim(%s, " + " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + ")"

_ROUGH = (
    _FILES
    + rf""",
pieces AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM files
),
rough AS (
  SELECT doc_id, string_agg(CASE i % 9 WHEN 1 THEN '##' || chr(160) || 'n' || i || chr(160) || ' ' WHEN 2 THEN '#### four ' || i WHEN 3 THEN '  ```sql' || chr(10) || x
           WHEN 4 THEN '# may be inside ' || i WHEN 5 THEN CASE WHEN doc_id % 2 = 0 THEN '~~~' || chr(10) || x ELSE '#tag' || i END
           WHEN 6 THEN chr(9) || '# tabbed' || chr(8195) || chr(10) || x WHEN 7 THEN '### level ' || i || chr(13) WHEN 8 THEN x || chr(8232) || '# after ' || i || chr(28) ELSE x END, chr(10) ORDER BY i) AS markdown
  FROM pieces GROUP BY doc_id
),
cut AS (SELECT doc_id, regexp_split_to_array(markdown, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS every FROM rough),
rows AS (SELECT doc_id, unnest(every) AS line, generate_subscripts(every, 1) AS n FROM cut),
fenced AS (
  SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '^{_SPACE}*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside
  FROM rows
),
heads AS (
  SELECT *, CASE WHEN NOT inside AND regexp_matches(line, '^#{{1,3}}{_SPACE}+.*{_NOT_SPACE}') THEN regexp_extract(line, '^#{{1,3}}{_SPACE}+(.*{_NOT_SPACE}){_SPACE}*$', 1) END AS label FROM fenced
),
numbered AS (SELECT *, count(label) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM heads),
bodies AS (
  SELECT doc_id, k, max(label) AS label, {_STRIPPED % "coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (label IS NULL), '')"} AS text FROM numbered GROUP BY doc_id, k
)"""
)

_TRIES = f"""
{_DENSE.strip()},
asked AS (
  SELECT q.vec_id AS query_id, q.label AS label, a.attempt, coalesce(o.v, q.v) AS v
  FROM vectors q, (SELECT unnest([0, 1, 2]) AS attempt) a LEFT JOIN vectors o ON o.vec_id = q.vec_id + a.attempt WHERE q.vec_id % 20 = 0
),
ranked AS (
  SELECT a.query_id, a.attempt, c.vec_id AS chunk_id, list_dot_product(a.v, c.v) AS score,
         row_number() OVER (PARTITION BY a.query_id, a.attempt ORDER BY list_dot_product(a.v, c.v) DESC, c.vec_id) AS rank
  FROM asked a JOIN vectors c ON c.label = a.label
),
good AS (SELECT query_id, attempt, 's' || CAST(floor(chunk_id / 100) AS BIGINT) AS source, min(rank) AS rank FROM ranked WHERE rank <= 5 AND score > 0.45 AND chunk_id <> query_id GROUP BY ALL),
firsts AS (SELECT query_id, min(attempt) AS attempt FROM good GROUP BY query_id),
named AS (SELECT query_id, string_agg(source, ';' ORDER BY rank, source) AS sources FROM good JOIN firsts USING (query_id, attempt) GROUP BY query_id)"""

_FEEDBACK = """said AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations),
  replies AS (SELECT conv_id || ':' || turn AS answer_id, 'w' || (conv_id % 4) AS workspace_id, question FROM said WHERE role = 'assistant'),
  marks AS (SELECT user_id || ':1' AS answer_id, 'u' || (event_id % 7) AS user_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'up' WHEN event_type = 'error' THEN 'down' WHEN event_type = 'view' THEN 'none' ELSE event_type END AS mark,
    CASE WHEN event_id % 3 > 0 THEN props ELSE ' ' END AS comment, ts FROM events),
  checked AS (SELECT *, CASE WHEN answer_id NOT IN (SELECT answer_id FROM replies) THEN 'no such answer' WHEN mark NOT IN ('up', 'down', 'none') THEN 'not a mark' END AS reason FROM marks),
  current_marks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, user_id ORDER BY ts DESC, mark DESC, comment DESC) AS k FROM checked WHERE reason IS NULL) WHERE k = 1 AND mark <> 'none')"""

ORACLE_SQL = {
    "child_windows": f"WITH {_FILES}, cut AS (SELECT doc_id, {_WINDOWS} AS w FROM files WHERE text <> '') SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS child_index, unnest(w) AS text FROM cut",
    "parent_ids": f"WITH {_FILES}, hashed AS (SELECT doc_id, i AS parent_index, {_SHA % ('file_name', 'i')} AS h FROM files, (SELECT unnest(range(12)) AS i)) SELECT doc_id, parent_index, {_UUID} AS parent_id FROM hashed",
    "sections": f"WITH RECURSIVE {_MARKDOWN} SELECT doc_id, section - 1 AS section, label, text FROM sections",
    "merged_sections": f"WITH RECURSIVE {_MARKDOWN} SELECT doc_id, parent, label, text FROM merged",
    "packed_pieces": f"WITH RECURSIVE {_FILES}, keyed AS (SELECT doc_id AS key, replace(text, chr(10), chr(10) || chr(10)) AS text FROM files), {_packed('keyed')} SELECT key AS doc_id, piece, text FROM pieces",
    "parents": f"WITH RECURSIVE {_PARENTS} SELECT * FROM parents",
    "children": f"WITH RECURSIVE {_PARENTS}, cut AS (SELECT * EXCLUDE (text), {_WINDOWS} AS w FROM parents) SELECT * EXCLUDE (w), CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS child_index, unnest(w) AS text FROM cut",
    "fingerprints": f"WITH {_FILES} SELECT doc_id, 'sha256:' || sha256(text) || ':' || strlen(text) AS packed, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size_bytes FROM files",
    "type_gate": f"WITH {_FILES} SELECT doc_id, lower(regexp_extract(file_name, '[.]([^.]+)$', 1)) AS file_type, file_type <> 'pptx' AS supported FROM files",
    "conversion_outcomes": rf"""WITH {_FILES}, seen AS (SELECT *, file_type IN ('txt', 'md') AS known, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM files)
      SELECT doc_id, CASE WHEN NOT known OR blank THEN 'skipped' ELSE 'converted' END AS outcome, CASE WHEN known AND NOT blank THEN regexp_replace(text, '\r\n?', chr(10), 'g') END AS markdown,
             CASE WHEN NOT known THEN 'files of this type are not read' WHEN blank THEN 'there is no text in this file' END AS reason FROM seen""",
    "change_report": f"WITH {_CHANGES} SELECT * FROM changes",
    "change_counts": f"WITH {_CHANGES} SELECT workspace_id, change, count(*) AS n FROM changes GROUP BY ALL",
    "removed_sweep": f"WITH {_CHANGES} SELECT workspace_id, file_name, document_id FROM changes WHERE change = 'removed'",
    "sync_items": f"WITH {_CHANGES} SELECT * FROM items",
    "run_rollup": f"WITH {_CHANGES} SELECT sync_run_id, {_COUNTS} FROM items GROUP BY sync_run_id",
    "run_history": """SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS finished_at,
      CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS state FROM orders ORDER BY started_at DESC, id""",
    "run_detail": f"""WITH {_CHANGES} SELECT w.id, coalesce(string_agg(i.file_name || '=' || i.result, ';' ORDER BY i.file_name), '') AS items
      FROM (SELECT DISTINCT source AS id FROM documents WHERE source IS NOT NULL) w LEFT JOIN items i ON i.sync_run_id = w.id GROUP BY w.id""",
    "cascade_delete": f"""WITH {_CHANGES}, spaces AS (SELECT DISTINCT source AS id FROM documents WHERE source IS NOT NULL AND source <> 'src7')
      SELECT 'workspace' AS table_name, count(*) AS n FROM spaces UNION ALL SELECT 'document', count(*) FROM registered WHERE workspace_id <> 'src7'
      UNION ALL SELECT 'sync_run', count(*) FROM spaces UNION ALL SELECT 'sync_item', count(*) FROM items WHERE sync_run_id <> 'src7'""",
    "set_null": f"WITH {_CHANGES} SELECT i.id, CASE WHEN r.status = 'failed' THEN NULL ELSE i.document_id END AS document_id, result FROM items i LEFT JOIN registered r ON r.id = i.document_id",
    "upsert": f"""WITH {_CHANGES}, fresh AS (SELECT coalesce(document_id, 'n' || file_name) AS id, workspace_id, file_name, 'sha256:' || digest || ':' || size_bytes AS content_hash, 'active' AS status
        FROM changes WHERE change IN ('new', 'changed'))
      SELECT * FROM fresh UNION ALL SELECT id, workspace_id, file_name, content_hash, status FROM registered r WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.workspace_id = r.workspace_id AND f.file_name = r.file_name)""",
    "workspace_names": "SELECT c_custkey, trim(c_name, ' ' || chr(9) || chr(10)) AS name, length(trim(c_name, ' ' || chr(9) || chr(10))) BETWEEN 1 AND 100 AS valid FROM customer",
    "prefixed": "SELECT item_id, 'passage: ' || text AS passage, 'query: ' || text AS query FROM benchmark WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense",
    "bm25_topk": f"""WITH {_FILES}, chunks AS (SELECT doc_id AS chunk_id, lang AS workspace_id, text FROM files), spaces AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang), questions AS (SELECT item_id || '/' || lang AS query_id, lang AS workspace_id, text FROM benchmark, spaces), {_bm25(5)}
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse""",
    "hybrid_topk": f"WITH {_HYBRID} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hybrid",
    "parent_fetch": f"""WITH {_HYBRID} SELECT query_id, workspace_id, workspace_id || '/' || source AS parent_id, min(rank) AS rank, upper(source) AS section_label
      FROM hybrid JOIN chunks USING (chunk_id) GROUP BY query_id, workspace_id, source""",
    "answers": f"""WITH {_DENSE}, good AS (SELECT query_id, 's' || CAST(floor(chunk_id / 100) AS BIGINT) AS source, min(rank) AS rank FROM dense WHERE score > 0.45 AND chunk_id <> query_id GROUP BY ALL),
      named AS (SELECT query_id, string_agg(source, ';' ORDER BY rank, source) AS sources FROM good GROUP BY query_id)
      SELECT v.vec_id AS query_id, CASE WHEN sources IS NULL THEN 'refusal' ELSE 'answer' END AS kind, sources IS NULL AS refusal, coalesce(sources, '') AS sources, CAST(v.vec_id AS VARCHAR) AS searched,
             v.label = 1 AS disclaimer, CAST(0 AS BIGINT) AS retries FROM vectors v LEFT JOIN named n ON n.query_id = v.vec_id WHERE v.vec_id % 20 = 0""",
    "evaluation_summary": f"""WITH {_EVALUATIONS} SELECT eval_run_id, round(avg(groundedness), 6) AS groundedness, round(avg(relevancy), 6) AS relevancy, count(*) FILTER (NOT inside AND passed) AS refusal_pass,
      count(*) FILTER (NOT inside) AS refusal_total FROM questions GROUP BY eval_run_id""",
    "release_gate": f"""WITH {_EVALUATIONS}, sums AS (SELECT eval_run_id, avg(groundedness) AS g, coalesce(bool_and(sourced) FILTER (inside), true) AS all_sourced, count(*) FILTER (NOT inside AND passed) AS p,
        count(*) FILTER (NOT inside) AS n, coalesce(string_agg(question_id, ',' ORDER BY question_id) FILTER (NOT passed OR (inside AND NOT sourced)), '') AS failing FROM questions GROUP BY eval_run_id)
      SELECT eval_run_id, round(g, 6) AS groundedness, all_sourced, coalesce(g >= 0.9, false) AND n >= 20 AND n = p AND all_sourced AS passed, failing FROM sums""",
    "latency": "SELECT quantile_cont(n_chars / 100.0::DOUBLE, 0.5) AS median, quantile_cont(n_chars / 100.0::DOUBLE, 0.95) AS p95 FROM documents",
    "workspace_cap": f"WITH {_CHANGES} SELECT workspace_id, count(*) AS files, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, count(*) > 50 OR coalesce(sum(page_count), 0) > 1500 AS warning FROM registered WHERE status <> 'removed' GROUP BY workspace_id",
    "rough_sections": f"WITH {_ROUGH} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS section, label, text FROM bodies WHERE text <> ''",
    "text_files": f"""WITH {_FILES}, seen AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'a' || chr(65279) || text ELSE text END AS text, doc_id % 5 = 3 AS bad FROM files)
      SELECT doc_id, CASE WHEN bad THEN 'failed' WHEN {_STRIPPED % "text"} = '' THEN 'skipped' ELSE 'converted' END AS outcome, CASE WHEN NOT bad AND {_STRIPPED % "text"} <> '' THEN text END AS markdown,
             CASE WHEN bad THEN 'this file is not UTF-8 text; save it with that encoding, and sync again' WHEN {_STRIPPED % "text"} = '' THEN 'there is no text in this file' END AS reason FROM seen""",
    "pdf_files": r"""WITH seen AS (SELECT item_id, trim(regexp_replace(text, '[^\x20-\x7E]', '?', 'g'), ' ') AS text, item_id % 3 = 2 AS broken, item_id % 5 = 1 AS locked FROM benchmark WHERE text IS NOT NULL)
      SELECT item_id, CASE WHEN broken OR locked THEN 'failed' ELSE 'converted' END AS outcome, CASE WHEN NOT broken AND NOT locked THEN '# Item ' || item_id || chr(10) || chr(10) || text END AS markdown,
             CASE WHEN NOT broken AND NOT locked THEN CAST(1 AS BIGINT) END AS page_count, CASE WHEN broken THEN 'this is not a PDF file, or a damaged one; check that it opens in a reader, and sync again'
             WHEN locked THEN 'this PDF needs a password; save a copy that doesn''t, and sync again' END AS reason FROM seen""",
    "change_list": f"WITH {_CHANGES} SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY file_name) - 1 AS ord, file_name, change FROM changes",
    "scan_list": f"WITH {_CHANGES} SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY file_name) - 1 AS ord, file_name, scan_state FROM disk",
    "retried_answers": f"""WITH {_TRIES} SELECT q.vec_id AS query_id, CASE WHEN f.attempt IS NULL THEN 'refusal' ELSE 'answer' END AS kind, coalesce(n.sources, '') AS sources,
      CASE coalesce(f.attempt, 2) WHEN 0 THEN q.vec_id::VARCHAR WHEN 1 THEN q.vec_id || ';' || q.vec_id || '+1' ELSE q.vec_id || ';' || q.vec_id || '+1;' || q.vec_id || '+2' END AS searched,
      CAST(coalesce(f.attempt, 2) AS BIGINT) AS retries FROM vectors q LEFT JOIN firsts f ON f.query_id = q.vec_id LEFT JOIN named n ON n.query_id = q.vec_id WHERE q.vec_id % 20 = 0""",
    "traces": f"""WITH {_TRIES}, files AS (SELECT query_id, string_agg(source, ';' ORDER BY rank, source) AS files FROM good WHERE attempt = 0 GROUP BY query_id)
      SELECT q.vec_id AS query_id, CAST(q.label AS VARCHAR) AS workspace_id, CAST(q.vec_id AS VARCHAR) AS searched, coalesce(f.files, '') AS files, CAST(0 AS BIGINT) AS retries
      FROM vectors q LEFT JOIN files f ON f.query_id = q.vec_id WHERE q.vec_id % 20 = 0""",
    "evaluation_reports": f"""WITH {_EVALUATIONS}, sums AS (SELECT eval_run_id, avg(groundedness) AS g, coalesce(bool_and(sourced) FILTER (inside), true) AS all_sourced, count(*) FILTER (NOT inside AND passed) AS p,
        count(*) FILTER (NOT inside) AS n, coalesce(list(question_id ORDER BY question_id) FILTER (NOT passed OR (inside AND NOT sourced)), CAST([] AS VARCHAR[])) AS failing FROM questions GROUP BY eval_run_id)
      SELECT eval_run_id, '/reports/run_date=2024-01-31/' || eval_run_id || '.json' AS report_path,
             CAST(to_json({{'eval_run_id': eval_run_id, 'refusal_pass': p, 'refusal_total': n, 'all_sourced': all_sourced, 'passed': coalesce(g >= 0.9, false) AND n >= 20 AND n = p AND all_sourced, 'failing': failing}}) AS VARCHAR) AS body FROM sums""",
    "registry_state": f"""WITH {_CHANGES}, spaces AS (SELECT source AS id, source = 'src7' AS legal, row_number() OVER (ORDER BY source) AS n, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
      SELECT id, CASE WHEN n = 1 THEN id || ' renamed' ELSE id END AS name, '/' || id AS folder_path, legal OR n = 2 AS legal_flag, (SELECT count(*) FROM registered r WHERE r.workspace_id = s.id) AS documents,
             CAST(1 AS BIGINT) AS sync_runs, (SELECT count(*) FROM items i WHERE i.sync_run_id = s.id) AS sync_items FROM spaces s WHERE n < m""",
    "stale_tail": f"""WITH RECURSIVE {_PARENTS} SELECT source_file, CAST(parent_index AS BIGINT) AS parent_index, section_label, text FROM parents WHERE doc_id % 3 = 2
      UNION ALL SELECT source_file, CAST(0 AS BIGINT), 'doc ' || doc_id, 'short ' || doc_id FROM markdown WHERE doc_id % 3 = 0""",
    "embedded_passages": "SELECT item_id, CAST(32 AS BIGINT) AS width, CAST(1.0 AS DOUBLE) AS norm FROM benchmark WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''",
    # a table function takes no path from a query: this one is for the folder that the gate runs on
    "folder_files": """SELECT parse_filename(filename) AS file_name, sha256(content) AS digest, size AS size_bytes, row_number() OVER (ORDER BY parse_filename(filename)) - 1 AS ord
      FROM read_blob('/root/testdata/sf0.01/*.parquet')""",
    "sync_progress": """WITH n AS (SELECT count(*) AS n FROM benchmark), waves AS (SELECT n, unnest(range(1, greatest(1, (n + 24) // 25) + 1)) AS k FROM n)
      SELECT 'whole' AS workspace, CAST(0 AS BIGINT) AS seq, 'scanned' AS state, CAST(0 AS BIGINT) AS done, n AS total, n AS documents FROM n
      UNION ALL SELECT 'whole', k, 'stored', least(25 * k, n), n, n FROM waves
      UNION ALL SELECT 'whole', (n + 24) // 25 + 1, 'finished', n, n, n FROM n
      UNION ALL SELECT 'cut', 0, 'scanned', 0, n, least(25, n) FROM n
      UNION ALL SELECT 'cut', 1, 'stored', least(25, n), n, least(25, n) FROM n
      UNION ALL SELECT 'cut', 2, CASE WHEN n > 25 THEN 'cancelled' ELSE 'finished' END, least(25, n), n, least(25, n) FROM n""",
    "block_topk": f"""WITH {_FILES}, chunks AS (SELECT doc_id AS chunk_id, lang AS workspace_id, text FROM files), spaces AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang), questions AS (SELECT item_id || '/' || lang AS query_id, lang AS workspace_id, text FROM benchmark, spaces), {_bm25(5)}
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse""",
    "block_work": f"""WITH {_FILES}, held AS (SELECT DISTINCT workspace_id, block, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term
        FROM (SELECT lang AS workspace_id, text, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS block FROM files)),
      asked AS (SELECT DISTINCT item_id || '/' || lang AS query_id, lang AS workspace_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark, (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang))
      SELECT query_id, count(DISTINCT block) AS blocks, least(2, count(DISTINCT block)) AS probed, true AS accounted FROM asked JOIN held USING (workspace_id, term) GROUP BY query_id""",
    "index_upkeep": f"""WITH {_FILES}, versions AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' again' WHEN doc_id % 3 = 0 THEN left(text, length(text) // 2) WHEN doc_id % 3 = 2 THEN text END AS text FROM files),
      chunks AS (SELECT doc_id AS chunk_id, 'w' AS workspace_id, text FROM versions WHERE text IS NOT NULL), questions AS (SELECT item_id AS query_id, 'w' AS workspace_id, text FROM benchmark), {_bm25(5)}
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse""",
    "session_memory": """WITH starts AS (SELECT *, count(*) FILTER ((conv_id + turn) % 5 = 3) OVER (PARTITION BY conv_id ORDER BY turn) AS epoch FROM conversations),
      seen AS (SELECT conv_id, turn, list(concat_ws(':', role, text)) OVER (PARTITION BY conv_id, epoch ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS memory FROM starts)
      SELECT conv_id AS session_id, turn, CAST(coalesce(len(memory), 0) AS BIGINT) AS remembered, coalesce(array_to_string(memory, chr(10)), '') AS memory FROM seen""",
    "clarified": f"""WITH {_DENSE}, hits AS (SELECT *, 's' || CAST(floor(chunk_id / 100) AS BIGINT) AS source FROM dense WHERE chunk_id <> query_id), vectors_of AS (SELECT vec_id, CAST(label AS VARCHAR) AS w FROM vectors),
      named AS (SELECT h.*, v.w || '/' || h.source AS parent_id FROM hits h JOIN vectors_of v ON v.vec_id = h.chunk_id),
      parents AS (SELECT query_id, parent_id, max(score) AS score FROM named GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, parent_id) AS n FROM parents),
      two AS (SELECT query_id, max(score) FILTER (n = 1) AS a, max(score) FILTER (n = 2) AS b, max(parent_id) FILTER (n = 2) AS reply, string_agg(parent_id, ';' ORDER BY n) FILTER (n <= 2) AS options FROM ranked GROUP BY query_id),
      unclear AS (SELECT * FROM two WHERE (a - b) / a < 0.05)
      SELECT h.query_id, coalesce(u.options, '') AS options, h.chunk_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS rank
      FROM named h LEFT JOIN unclear u ON u.query_id = h.query_id WHERE u.query_id IS NULL OR h.parent_id = u.reply""",
    "routed": """WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS workspace_id, embedding FROM embeddings), scores AS (SELECT q.vec_id AS query_id, c.workspace_id, c.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
        FROM v q, v c WHERE q.vec_id % 20 = 0), best AS (SELECT *, row_number() OVER (PARTITION BY query_id, workspace_id ORDER BY score DESC, chunk_id) AS n FROM scores),
      sums AS (SELECT query_id, workspace_id, sum(score) AS score FROM best WHERE n <= 5 GROUP BY ALL)
      SELECT query_id, workspace_id, round(score, 6) AS score FROM sums QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, workspace_id) = 1""",
    "latency_sketch": "SELECT count(*) AS n, true AS median_right, true AS p95_right FROM documents",
    "file_pages": f"""WITH {_CHANGES}, rows_ AS (SELECT file_name, file_type, scan_state, CASE WHEN scan_state = 'ok' THEN coalesce(size_bytes, -1) ELSE -1 END AS size_bytes FROM disk), placed AS (
        SELECT 'name' AS sort, row_number() OVER (ORDER BY file_name) - 1 AS ord, file_name FROM rows_ UNION ALL SELECT 'type', row_number() OVER (ORDER BY file_type, file_name) - 1, file_name FROM rows_
        UNION ALL SELECT 'size', row_number() OVER (ORDER BY size_bytes, file_name) - 1, file_name FROM rows_ UNION ALL SELECT 'state', row_number() OVER (ORDER BY scan_state, file_name) - 1, file_name FROM rows_)
      SELECT sort, ord // 50 AS page, ord % 50 AS place, file_name FROM placed""",
    "feedback_refused": f"WITH {_FEEDBACK} SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason",
    "feedback_review": f"""WITH {_FEEDBACK} SELECT workspace_id, answer_id, question, user_id, comment FROM current_marks JOIN replies USING (answer_id) WHERE mark = 'down' AND trim(comment, ' ') <> ''""",
    "feedback_rates": f"""WITH {_FEEDBACK}, counts AS (SELECT answer_id, count(*) FILTER (mark = 'up') AS up, count(*) FILTER (mark = 'down') AS down FROM current_marks GROUP BY answer_id),
      sums AS (SELECT workspace_id, count(*) AS answers, count(up) AS marked, CAST(coalesce(sum(up), 0) AS BIGINT) AS up, CAST(coalesce(sum(down), 0) AS BIGINT) AS down FROM replies LEFT JOIN counts USING (answer_id) GROUP BY workspace_id),
      shares AS (SELECT *, up + down AS n, down / nullif(up + down, 0) AS p FROM sums), spreads AS (SELECT *, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))::DOUBLE AS s FROM shares)
      SELECT workspace_id, answers, marked, up, down, round(p, 6) AS share_down, round((p + 1.96::DOUBLE * 1.96 / (2 * n) - s) / (1 + 1.96::DOUBLE * 1.96 / n), 6) AS low,
             round((p + 1.96::DOUBLE * 1.96 / (2 * n) + s) / (1 + 1.96::DOUBLE * 1.96 / n), 6) AS high FROM spreads""",
    "written_answers": f"""WITH {_DENSE}, good AS (SELECT query_id, 's' || CAST(floor(chunk_id / 100) AS BIGINT) AS source, vectors.label AS label, min(rank) AS rank FROM dense JOIN vectors ON vectors.vec_id = dense.query_id WHERE score > 0.45 AND chunk_id <> query_id GROUP BY ALL),
      named AS (SELECT query_id, string_agg(upper(source) || ': ' || label || '/' || source, chr(10) ORDER BY rank) AS text FROM good GROUP BY query_id)
      SELECT v.vec_id AS query_id, CASE WHEN text IS NULL THEN 'refusal' ELSE 'answer' END AS kind,
             coalesce(text, 'Nothing in this workspace answers the question. Searched for: ' || v.vec_id || '. Ask with words that the documents use, or in another workspace.') AS text
      FROM vectors v LEFT JOIN named n ON n.query_id = v.vec_id WHERE v.vec_id % 20 = 0""",
}
