"""The SQL twins of the core's queries, for DuckDB. Keys are the queries' names."""

from __future__ import annotations

#: Fixed values, written here anew so that a wrong one in the engine shows: white space, ends of sentences, odd characters,
#: signs, ideographs and their like, and phrases of leaked instructions.
SPACE = "\\x{9}-\\x{d} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
SENTENCE_ENDS = ".!?。！？\\n"
ODD = "\ufffd〓▯□■●▪▫\\x{0}-\\x{8}\\x{e}-\\x{1f}\\x{7f}-\\x{84}\\x{86}-\\x{9f}"
SIGNS = "!-/:-@\\x{5b}-`\\x{7b}-~。，、；：？！“”‘’（）《》—…"
CJK = "\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ff00}-\\x{ffef}\\x{3000}-\\x{303f}"
LEAKED = (
    "epub output should", "preserve heading hierarchy", "generate a table of contents", "ocr confidence is low", "verification backend",
    "review low-confidence", "extract all text from the image", "return only a valid json", "top-level 'blocks' array", "each block must have",
    "you are a strict ocr engine", "you are an ocr engine", "your job is to extract", "output format:", "rules:", "example of valid output",
    "sample document", "testing pdf ocr", "rendered as page images", "vision - language model", "vision-language model", "layout analysis",
    "reading order", "chapter segmentation", "test document", "## chapter", "chapter 2: structure", "sample heading",
)

TRIM = "regexp_replace(@, '^[" + SPACE + "]+|[" + SPACE + "]+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.replace("@", x)


def squeeze(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")


def ltrim(x: str) -> str:
    return f"ltrim({x}, ' ')"


DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([{SENTENCE_ENDS}])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"
ONE = {
    "chapters": "(SELECT DISTINCT ON (book_id, idx) * FROM chapters ORDER BY book_id, idx, loaded_at DESC)",
    "stored": "(SELECT DISTINCT ON (job_id, idx) * FROM checkpoints ORDER BY job_id, idx, saved_at DESC)",
    "pages": "(SELECT DISTINCT ON (book_id, page_number, block_ix) * FROM verified_texts WHERE text IS NOT NULL ORDER BY book_id, page_number, block_ix, loaded_at DESC)",
    "jobs": "(SELECT DISTINCT ON (job_id) * FROM job_options ORDER BY job_id, created_at DESC)",
    "books": "(SELECT DISTINCT ON (book_id) * FROM books ORDER BY book_id, loaded_at DESC)",
    "cues": "(SELECT DISTINCT ON (book_id, idx) * FROM srt_entries WHERE text IS NOT NULL ORDER BY book_id, idx, loaded_at DESC)",
}
ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
MODES = {
    "bilingual": "SELECT 0 AS part, 'translation' AS side UNION ALL SELECT 1, 'original'",
    "interleaved": "SELECT 0 AS part, 'original' AS side UNION ALL SELECT 1, 'translation'",
    "translation_only": "SELECT 0 AS part, 'translation' AS side",
}
SPLIT = f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM {DOCS})"

TOKENS = "CAST(ceil(length({}) / 4.0) AS BIGINT)"
ISLAND = "sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, page_number ORDER BY block_ix)"
LABEL_TEXT = trim("text")
HEADING = f"(starts_with({ltrim('{0}')}, '#') OR regexp_matches({ltrim('{0}')}, '^[0-9.]+(?:[ {CJK}])') OR regexp_matches({ltrim('{0}')}, '^第[0-9]'))"
CAPTION = f"regexp_matches({ltrim('{0}')}, '^(?:图|表|Fig|Table)')"
HEADING, CAPTION = HEADING.replace("{0}", "{t}"), CAPTION.replace("{0}", "{t}")


def heading(t: str) -> str:
    return HEADING.replace("{t}", t)


def caption(t: str) -> str:
    return CAPTION.replace("{t}", t)


IS_LABEL = (
    f"(block_type IN ('paragraph', 'other') AND {LABEL_TEXT} <> '' AND strlen({LABEL_TEXT}) <= 25 AND NOT regexp_matches({LABEL_TEXT}, '[。！？.!?]$') "
    f"AND NOT {heading(LABEL_TEXT)} AND NOT {caption(LABEL_TEXT)} AND (regexp_matches({LABEL_TEXT}, '[^{CJK}]') OR length({LABEL_TEXT}) <= 6))"
)
IS_PAGE = f"(regexp_matches({trim('text')}, '^[0-9]{{1,4}}$') OR (strlen({trim('text')}) <= 15 AND regexp_matches({trim('text')}, '^\\s*[0-9]*\\.*\\s*(?:-\\s*[0-9]*\\.*\\s*)+$')))"
IS_LEAKED = "(" + " OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in LEAKED) + f" OR regexp_matches({trim('lower(text)')}, '^chapter [0-9]'))"
TOP = f"(CASE WHEN {trim('text')} = '' THEN false WHEN starts_with({trim('text')}, '第') THEN regexp_matches({trim('text')}, '^第[0-9]') WHEN NOT regexp_matches({trim('text')}, '^[0-9]') THEN true ELSE NOT regexp_matches({trim('text')}, '^[0-9]+\\.') END)"
ANOMALY = f"CASE WHEN length(text) = 0 THEN 0.0 ELSE least((length(text) - length(regexp_replace(text, '[{ODD}]', '', 'g'))) * 1.5 / length(text) + runs * 0.8 / length(text) + least((length(text) - length(regexp_replace(text, '[{SIGNS}]', '', 'g'))) * 1.0 / length(text), 0.5), 1.0) END"


def with_runs(source: str, keys: str) -> str:
    """A source with the lengths of runs of four or more equal characters: islands of exploded characters."""
    chars = f"SELECT {keys}, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM {source} WHERE length(text) > 0"
    islands = f"SELECT {keys}, c, i - row_number() OVER (PARTITION BY {keys}, c ORDER BY i) AS g FROM ({chars})"
    sums = f"SELECT {keys}, sum(n) AS runs FROM (SELECT {keys}, count(*) AS n FROM ({islands}) GROUP BY {keys}, c, g HAVING count(*) >= 4) GROUP BY {keys}"
    return f"(SELECT s.*, coalesce(r.runs, 0) AS runs FROM {source} s LEFT JOIN ({sums}) r USING ({keys}))"


PAGE_KEYS = "book_id, page_number, block_ix"
CELLS = f"SELECT book_id, page_number, min(block_ix) AS table_ix, count(*) AS cells FROM (SELECT *, {ISLAND} AS island FROM (SELECT *, block_type = 'table_cell' AS flag FROM {ONE['pages']})) WHERE flag GROUP BY book_id, page_number, island"
WANTED = f"(SELECT j.job_id, c.idx, c.content FROM {ONE['chapters']} c JOIN {ONE['jobs']} j USING (book_id) WHERE j.job_id IN (SELECT job_id FROM checkpoints))"
PACK = f"""
WITH RECURSIVE s AS (SELECT doc_id, pos + 1 AS i, {TOKENS.format('sentence')} AS n, length(sentence) AS len FROM ({SPLIT})),
ends AS (SELECT doc_id, max(i) AS last FROM s GROUP BY doc_id),
walk(doc_id, i, used, open, closed) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ends
  UNION ALL
  SELECT w.doc_id, s.i,
    CASE WHEN s.n > 64 THEN 0 WHEN w.open = 1 AND w.used + s.n > 64 THEN s.n ELSE w.used + s.n END,
    CASE WHEN s.n > 64 THEN 0 ELSE 1 END,
    w.closed + CASE WHEN s.n > 64 THEN w.open + CAST(ceil(s.len / 256.0) AS BIGINT) WHEN w.open = 1 AND w.used + s.n > 64 THEN 1 ELSE 0 END
  FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
SELECT d.doc_id, coalesce(w.closed + w.open, 0) AS chunks FROM {DOCS} d LEFT JOIN (SELECT walk.* FROM walk JOIN ends ON ends.doc_id = walk.doc_id AND walk.i = ends.last) w USING (doc_id)
"""
KINDS = "['Started', 'ChapterStarted', 'ChunkFinished', 'ChapterFinished', 'ChunkFinished', 'ChapterFinished', 'ChunkStarted', 'ChapterFinished'][event_id % 8 + 1]"
FOLD = f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, {KINDS} AS event, event_id % 13 + 3 AS total, event_id % 4 AS chunk FROM events),
s AS (SELECT task_id, max(seq) AS since, arg_max(total, seq) AS t FROM e WHERE event = 'Started' GROUP BY task_id),
l AS (SELECT e.*, s.t FROM e LEFT JOIN s USING (task_id) WHERE s.since IS NULL OR e.seq >= s.since),
a AS (SELECT task_id, any_value(t) AS t, count(*) FILTER (WHERE event = 'ChapterFinished') AS done,
  arg_max(event, seq) FILTER (WHERE event IN ('Started', 'ChapterFinished', 'ChunkFinished')) AS last, arg_max(chunk, seq) FILTER (WHERE event = 'ChunkFinished') AS chunk FROM l GROUP BY task_id)
SELECT task_id, CAST(t AS BIGINT) AS total, CAST(done AS BIGINT) AS completed,
  CAST(CASE WHEN t IS NULL THEN 0 ELSE floor(least((done + CASE WHEN last = 'ChunkFinished' THEN (chunk + 1) / 5.0 ELSE 0 END) * 100.0 / t, 100.0)) END AS INTEGER) AS progress FROM a
"""


FOLDED = """
WITH RECURSIVE b AS (SELECT book_id, idx, base, row_number() OVER (PARTITION BY book_id ORDER BY idx, base) AS i FROM ({rows})),
f(book_id, i, idx, id, used) AS (
  SELECT book_id, CAST(0 AS BIGINT), CAST(NULL AS {kind}), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM b GROUP BY book_id
  UNION ALL
  SELECT book_id, i, idx, id, list_append(used, id) FROM (
    SELECT f.book_id, b.i, b.idx, f.used,
      CASE WHEN NOT list_contains(f.used, b.base) THEN b.base
           ELSE list_filter(list_transform(range(2, len(f.used) + 3), lambda n: b.base || '{by}' || n), lambda x: NOT list_contains(f.used, x))[1] END AS id
    FROM f JOIN b ON b.book_id = f.book_id AND b.i = f.i + 1))
SELECT book_id, idx, id FROM f WHERE i > 0
"""
TITLE_IDS = f"SELECT book_id, idx, CASE WHEN r = '' OR regexp_matches(r, '^[0-9]') THEN 'i' || r ELSE r END AS base FROM (SELECT book_id, idx, regexp_replace(title, '[^\\p{{L}}\\p{{N}}\\-._]', '_', 'g') AS r FROM {ONE['chapters']} WHERE title IS NOT NULL)"
MANIFEST = FOLDED.replace("{rows}", TITLE_IDS).replace("{kind}", "INTEGER").replace("{by}", "_")
NAMES = FOLDED.replace("{rows}", f"SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY job_id) AS INTEGER) AS idx, provider AS base FROM {ONE['jobs']}").replace("{kind}", "INTEGER").replace("{by}", " ")
N = "(length(job_id) + ascii(job_id))"


def pick(*values: str) -> str:
    """One of some SQL values by the job's id."""
    return f"[{', '.join(values)}][{N} % {len(values)} + 1]"


SETTINGS = f"""(SELECT job_id, source_lang, target_lang, provider, max_input_tokens, max_output_tokens, temperature, {pick("'m'", "''", "'m2'")} AS model,
  {pick("'https://a.example/v1'", "'ftp://a.example'", "'no url'", "NULL", "'http://b'")} AS base_url, {pick("'k'", "''", "NULL")} AS api_key,
  {pick("'pre,code'", "'p q'", "'a,,b'", "'.x'")} AS selectors, {pick("'alt,title'", "'data_x'")} AS attributes, {pick("'p,h1'", "'P'", "'td'")} AS tags,
  {pick("'Serif'", "'a;b'", "NULL")} AS font, {N} % 2 = 0 AS dry_run FROM {ONE['jobs']})"""
KNOWN_LANG = "('auto', 'de', 'en', 'es', 'fr', 'it', 'ja', 'ru', 'zh-CN')"
URL_BAD = "CASE WHEN base_url IN ('https://a.example/v1', 'http://b') THEN NULL WHEN base_url = 'ftp://a.example' THEN 'scheme' WHEN base_url IS NOT NULL THEN 'no url' END"
PROBLEMS = f"""
SELECT job_id, field, problem FROM (
  SELECT job_id, 'provider' AS field, CASE WHEN lower(provider) IN ('fake', 'local', 'remote_a', 'openai-compatible') THEN NULL ELSE 'unknown' END AS problem FROM {SETTINGS}
  UNION ALL SELECT job_id, 'model', CASE WHEN trim(model) = '' THEN 'empty' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'base_url', {URL_BAD} FROM {SETTINGS}
  UNION ALL SELECT job_id, 'api_key', CASE WHEN NOT dry_run AND coalesce(api_key, '') = '' THEN 'required' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'max_input_tokens', CASE WHEN max_input_tokens <= 0 THEN 'not positive' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'max_output_tokens', CASE WHEN max_output_tokens <= 0 THEN 'not positive' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'temperature', CASE WHEN temperature < 0 OR temperature > 2 THEN 'out of range' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'source_lang', CASE WHEN trim(coalesce(source_lang, '')) = '' THEN 'empty' WHEN source_lang NOT IN {KNOWN_LANG} THEN 'unsupported' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'target_lang', CASE WHEN trim(coalesce(target_lang, '')) = '' THEN 'empty' WHEN target_lang NOT IN {KNOWN_LANG} THEN 'unsupported' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'exclude_selectors', CASE selectors WHEN 'a,,b' THEN 'empty entry' WHEN 'p q' THEN 'invalid entry' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'translate_attributes', CASE WHEN attributes = 'data_x' THEN 'invalid entry' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'translate_tags', CASE WHEN tags = 'P' THEN 'invalid entry' END FROM {SETTINGS}
  UNION ALL SELECT job_id, 'output_font', CASE WHEN contains(font, ';') THEN 'invalid' END FROM {SETTINGS}) WHERE problem IS NOT NULL
"""
RESOLUTION = f"""
SELECT job_id, coalesce(CASE WHEN dry_run THEN base_url END, CASE WHEN starts_with(base_url, 'http') THEN base_url END, 'https://usual.example') AS base_url, key AS api_key,
  CASE WHEN coalesce(m, '') IN ('', 'unknown') THEN 'all' ELSE m END AS model, CAST(CASE WHEN t = 0 THEN 900 ELSE t END AS BIGINT) AS max_tokens,
  CASE WHEN key IS NULL THEN 'no key: ' || upper(provider) || '_API_KEY' END AS error
FROM (SELECT *, CASE WHEN font IS NULL THEN 'usual' WHEN model = 'm' THEN 'unknown' ELSE model END AS m, CASE WHEN font IS NULL THEN 2000 WHEN model = 'm2' THEN 0 ELSE 700 END AS t,
  CASE WHEN dry_run THEN '' ELSE coalesce(nullif(coalesce(CASE WHEN model = '' THEN '' END, api_key), ''), CASE WHEN provider = 'remote_a' THEN 'ra' END) END AS key FROM {SETTINGS})
"""
GLOSSARY = "(SELECT job_id, chr(10) || 'Use the following glossary:' || chr(10) || string_agg('- ' || term || ' => ' || translation, chr(10) ORDER BY entry_id) || chr(10) AS lines FROM glossary WHERE translation IS NOT NULL GROUP BY job_id)"
SOURCE_NAME = "CASE WHEN coalesce(source_lang, 'auto') = 'auto' THEN 'the original language' ELSE source_lang END"
EVENT_FORM = "event_id % 8"
PAYLOADS = f"""
SELECT event_id, CASE {EVENT_FORM} WHEN 0 THEN 'Completed' WHEN 1 THEN 'Started' WHEN 2 THEN 'ChapterStarted' WHEN 3 THEN 'ChunkFinished' WHEN 4 THEN 'Failed' END AS event,
  CASE WHEN {EVENT_FORM} = 1 THEN event_id % 13 END AS total, CASE WHEN {EVENT_FORM} IN (2, 3, 4) THEN event_id % 13 END AS index,
  CASE WHEN {EVENT_FORM} IN (2, 3, 4) THEN 'ch' || event_id % 9 || '.xhtml' END AS href, CASE WHEN {EVENT_FORM} = 3 THEN event_id % 4 END AS chunk_index,
  CASE WHEN {EVENT_FORM} = 3 THEN CAST(5 AS BIGINT) END AS chunk_total, CASE WHEN {EVENT_FORM} = 4 THEN event_type END AS error FROM events
"""
LOG = f"""
SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, CASE WHEN k = 'Started' THEN 'info' ELSE 'chapter' END AS level,
  CASE WHEN k = 'Started' THEN 'Started ' || (event_id % 13 + 3) WHEN starts_with(k, 'Chunk') THEN k || ' ' || (event_id % 4 + 1) || '/5 c.xhtml' ELSE k || ' c.xhtml' END AS message
FROM (SELECT *, {KINDS} AS k FROM events)
"""
#: Chunks of documents: sentences packed up to 64 tokens, a chunk's number by the fold of PACK, windows of longer sentences.
def walked(split: str, x: str = "") -> str:
    """Common tables s, walk, told and chunked (doc_id, chunk, text) of sentences (doc_id, pos, sentence); x tells several apart."""
    return f"""s{x} AS (SELECT doc_id, pos + 1 AS i, sentence, {TOKENS.format('sentence')} AS n FROM ({split})),
walk{x}(doc_id, i, used, chunk, open) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false FROM (SELECT DISTINCT doc_id FROM s{x})
  UNION ALL
  SELECT w.doc_id, s.i, CASE WHEN s.n > 64 THEN 0 WHEN w.open AND w.used + s.n <= 64 THEN w.used + s.n ELSE s.n END,
    CASE WHEN w.open AND s.n <= 64 AND w.used + s.n <= 64 THEN w.chunk WHEN s.n > 64 THEN w.chunk + CAST(ceil(length(s.sentence) / 256.0) AS BIGINT) ELSE w.chunk + 1 END, s.n <= 64
  FROM walk{x} w JOIN s{x} s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
told{x} AS (SELECT w.doc_id, w.i, w.chunk, s.sentence, s.n FROM walk{x} w JOIN s{x} s USING (doc_id, i)),
chunked{x} AS (
  SELECT doc_id, chunk, string_agg(sentence, ' ' ORDER BY i) AS text FROM told{x} WHERE n <= 64 GROUP BY doc_id, chunk
  UNION ALL
  SELECT doc_id, chunk - k + k2, substring(sentence, 256 * k2 + 1, 256) FROM (SELECT *, CAST(ceil(length(sentence) / 256.0) AS BIGINT) - 1 AS k, unnest(range(CAST(ceil(length(sentence) / 256.0) AS BIGINT))) AS k2 FROM told{x} WHERE n > 64))
"""


WALK = "WITH RECURSIVE " + walked(SPLIT)
CHUNKED = WALK + "SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_ix, text AS chunk FROM chunked"
#: Answers of the stand-in: of every third text as a whole, of the others chunk by chunk.
ANSWERED = f"""{WALK}, known AS (SELECT DISTINCT text FROM {DOCS} WHERE doc_id % 3 = 0),
parts AS (SELECT doc_id, {trim("replace(string_agg('[ZH] ' || text, ' ' ORDER BY chunk), chr(10), ' ')")} AS answer FROM chunked GROUP BY doc_id),
done AS (SELECT d.doc_id, d.text, CASE WHEN d.text IN (SELECT text FROM known) THEN '[ZH] ' || {trim('d.text')} ELSE coalesce(p.answer, '') END AS translation FROM {DOCS} d LEFT JOIN parts p USING (doc_id))
"""
LF_ONLY = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
REFINED = ANSWERED + ", " + walked(SPLIT.replace(DOCS, "(SELECT doc_id, translation AS text FROM done)"), "2") + f"""
SELECT d.doc_id, coalesce(p.answer, '') AS translation FROM done d LEFT JOIN (SELECT doc_id, {trim("replace(string_agg('[ZH] ' || text, ' ' ORDER BY chunk), chr(10), ' ')")} AS answer FROM chunked2 GROUP BY doc_id) p USING (doc_id)
"""
#: The best attempt of each page: a fold over its blocks in order.
BEST = f"""
WITH RECURSIVE a AS (SELECT book_id, page_number, row_number() OVER (PARTITION BY book_id, page_number ORDER BY block_ix) AS i, text, coalesce(CAST(confidence AS DOUBLE), 0.0) AS c, round({ANOMALY}, 6) AS an FROM {with_runs(ONE['pages'], PAGE_KEYS)}),
f(book_id, page_number, i, text, c, an, done) AS (
  SELECT DISTINCT book_id, page_number, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE), false FROM a
  UNION ALL
  SELECT book_id, page_number, i, CASE WHEN better THEN t ELSE text END, CASE WHEN better THEN c2 ELSE c END, CASE WHEN better THEN an2 ELSE an END, CASE WHEN better THEN c2 >= 0.7 AND an2 <= 0.2 ELSE done END FROM (
    SELECT f.book_id, f.page_number, a.i, f.text, f.c, f.an, f.done, a.text AS t, a.c AS c2, CAST(a.an AS DOUBLE) AS an2, NOT f.done AND (f.text IS NULL OR a.c > f.c OR (a.c = f.c AND a.an < f.an)) AS better
    FROM f JOIN a ON a.book_id = f.book_id AND a.page_number = f.page_number AND a.i = f.i + 1))
SELECT book_id, page_number, text, round(greatest(c, 0.5), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_number ORDER BY i DESC) AS k FROM f) WHERE k = 1
"""
PAGE_ROWS = f"(SELECT *, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') AS safe FROM {ONE['pages']})"
PARAS = "list_filter(list_transform(string_split({t}, chr(10) || chr(10)), lambda p: " + squeeze("p") + "), lambda p: p <> '')"
FIGURES = f"""(WITH p AS (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY page_number) - 1 AS page FROM {ONE['pages']})
SELECT book_id, page_number, block_ix, printf('figure-%03d-%03d.png', page, row_number() OVER (PARTITION BY book_id ORDER BY page_number, block_ix)) AS href FROM p WHERE block_type = 'other' AND bbox.w >= 20 AND bbox.h >= 20)"""

SQL: dict[str, str] = {
    "sentence_split": SPLIT,
    "chunk_counts": PACK,
    "token_estimate": f"SELECT book_id, CAST(sum({TOKENS.format('decode(content)')}) AS BIGINT) AS tokens, count(*) AS chapters FROM {ONE['chapters']} GROUP BY book_id",
    "cache_keys": f"SELECT doc_id, sha256('fake:' || text) AS cache_key FROM {DOCS}",
    "job_ids": f"SELECT job_id, substring(sha256(b.source_path || '|' || substring(sha256(concat_ws('|', j.target_lang, j.output_mode, j.provider, 'default')), 1, 16)), 1, 16) AS made_id FROM {ONE['jobs']} j JOIN {ONE['books']} b USING (book_id)",
    "txt_lines": f"SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') END AS l FROM {DOCS})",
    "paragraphs_from_text": f"SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {squeeze('p')}), lambda p: p <> '') AS l FROM {DOCS})",
    "html_escape": f"SELECT doc_id, {ESCAPE.format('text')} AS escaped FROM {DOCS}",
    "match_texts": f"SELECT doc_id, replace(lower(replace(regexp_replace(text, '[{SPACE}]', '', 'g'), 'İ', chr(1))), chr(1), 'i' || chr(775)) AS folded, regexp_replace(text, '[{SPACE}]', '', 'g') AS header FROM {DOCS}",
    "first_lines": f"SELECT doc_id, {trim('string_split(text, chr(10))[1]')} AS first, CASE WHEN contains(text, chr(10)) THEN nullif({trim('substring(text, instr(text, chr(10)) + 1)')}, '') END AS rest FROM {DOCS}",
    "anomaly_score": f"SELECT doc_id, round({ANOMALY}, 6) AS anomaly FROM {with_runs(DOCS, 'doc_id')}",
    "book_formats": f"SELECT book_id, CASE lower(regexp_extract(source_path, '\\.([^./]+)$', 1)) WHEN 'epub' THEN 'epub' WHEN 'mobi' THEN 'mobi' WHEN 'azw' THEN 'mobi' WHEN 'azw3' THEN 'mobi' WHEN 'prc' THEN 'mobi' WHEN 'txt' THEN 'text' WHEN 'text' THEN 'text' WHEN 'srt' THEN 'srt' WHEN 'docx' THEN 'docx' END AS format, regexp_extract(source_path, '([^/]+)\\.[^./]*$', 1) AS stem FROM {ONE['books']}",
    "output_names": f"SELECT job_id, stem || '.' || target_lang || '.' || output_mode AS name, stem || '_' || target_lang AS plain_name FROM (SELECT j.*, regexp_extract(b.source_path, '([^/]+)\\.[^./]*$', 1) AS stem FROM {ONE['jobs']} j JOIN {ONE['books']} b USING (book_id))",
    "locales": f"SELECT job_id, target_lang AS locale FROM {ONE['jobs']}",
    "durations": "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60 % 60, s % 60) END AS duration FROM (SELECT event_id, event_id % 20000 AS s FROM events)",
    "glossary_prompts": f"SELECT j.job_id, 'Translate from ' || CASE WHEN coalesce(source_lang, 'auto') = 'auto' THEN 'the original language' ELSE source_lang END || ' to ' || target_lang || '.' || chr(10) || 'Use the following glossary:' || chr(10) || g.l || chr(10) AS prompt FROM {ONE['jobs']} j JOIN (SELECT job_id, string_agg('- ' || term || ' => ' || translation, chr(10) ORDER BY entry_id) AS l FROM glossary WHERE translation IS NOT NULL GROUP BY job_id) g USING (job_id)",
    "source_budgets": f"SELECT job_id, CAST(greatest(least(greatest(CASE WHEN max_input_tokens > 0 THEN max_input_tokens ELSE 4000 END - 170, 0), greatest(CASE WHEN max_output_tokens > 0 THEN max_output_tokens ELSE 2000 END - 200, 0)), 1) AS BIGINT) AS budget FROM {ONE['jobs']}",
    "skip_docs": f"SELECT book_id, idx, regexp_matches(lower(href), 'cover|titlepage|copyright|dedication|colophon|ch0[12]') AS skipped FROM {ONE['chapters']}",
    "toc_labels": f"SELECT book_id, path, label FROM (SELECT book_id, printf('part%03d.xhtml', idx // 3) AS path, title AS label, row_number() OVER (PARTITION BY book_id, idx // 3 ORDER BY idx % 2, CASE WHEN idx % 2 = 0 THEN -idx ELSE idx END) AS n FROM {ONE['chapters']} WHERE title IS NOT NULL) WHERE n = 1",
    "clean_hrefs": f"SELECT book_id, idx, href, CASE WHEN href = '' OR regexp_matches(href, '^[0-9]') THEN 'i' || id ELSE id END AS id FROM (SELECT *, regexp_replace(href, '[^\\p{{L}}\\p{{N}}\\-._]', '_', 'g') AS id FROM (SELECT book_id, idx, CASE WHEN h = '' THEN 'index.xhtml' ELSE h END AS href FROM (SELECT book_id, idx, regexp_replace(regexp_replace(href, '^/+', ''), '^(?:OEBPS|EPUB)/', '') AS h FROM {ONE['chapters']})))",
    "manifest_ids": MANIFEST,
    "cache_lookup": f"SELECT c.book_id, c.idx, k.k IS NOT NULL AS hit, CASE WHEN k.k IS NOT NULL THEN '[ZH] ' || c.text END AS translation FROM {ONE['cues']} c LEFT JOIN (SELECT DISTINCT sha256('fake:' || text) AS k FROM {ONE['cues']} WHERE idx % 3 = 0) k ON k.k = sha256('fake:' || c.text)",
    "cache_misses": "SELECT DISTINCT sha256('fake:' || text) AS cache_key, text AS chunk FROM srt_entries WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM srt_entries WHERE text IS NOT NULL AND idx % 3 = 0)",
    "cache_hit_rate": f"SELECT book_id, count(*) AS cues, CAST(count(*) FILTER (WHERE text IN (SELECT text FROM srt_entries WHERE text IS NOT NULL AND idx % 3 = 0)) AS BIGINT) AS hits FROM {ONE['cues']} GROUP BY book_id",
    "refine_pass": f"SELECT sha256('fake-refine:[ZH] ' || sentence) AS cache_key, '[ZH] [ZH] ' || sentence AS translation FROM (SELECT DISTINCT sentence FROM ({SPLIT}))",
    "checkpoint_summary": f"SELECT job_id, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS pending FROM {ONE['stored']} GROUP BY job_id",
    "checkpoint_pending": f"SELECT job_id, idx FROM {WANTED} w WHERE NOT EXISTS (SELECT 1 FROM checkpoints k WHERE k.job_id = w.job_id AND k.idx = w.idx AND k.status = 'completed')",
    "checkpoint_backfill": f"SELECT job_id, idx, status FROM {ONE['stored']} UNION ALL SELECT job_id, idx, 'pending' FROM {WANTED} w WHERE NOT EXISTS (SELECT 1 FROM checkpoints k WHERE k.job_id = w.job_id AND k.idx = w.idx)",
    "checkpoint_restore": f"SELECT w.job_id, w.idx, k.content IS NOT NULL AS restored, CAST(octet_length(coalesce(k.content, w.content)) AS BIGINT) AS bytes FROM {WANTED} w LEFT JOIN (SELECT * FROM {ONE['stored']} WHERE status = 'completed') k ON k.job_id = w.job_id AND k.idx = w.idx",
    "checkpoint_valid": f"SELECT k.job_id, k.idx FROM {ONE['stored']} k JOIN {ONE['jobs']} j USING (job_id) JOIN {ONE['books']} b USING (book_id) WHERE k.source_hash = '' OR k.source_hash = b.source_hash",
    "chapter_failures": f"SELECT job_id, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total, coalesce(string_agg(href, ', ' ORDER BY idx) FILTER (WHERE status = 'failed'), '') AS hrefs, count(*) FILTER (WHERE status = 'failed') = count(*) AS all_failed FROM {ONE['stored']} GROUP BY job_id",
    "html_headings": f"SELECT book_id, idx, len(regexp_extract_all(decode(content), '<h1[ >]')) AS headings FROM {ONE['chapters']} WHERE regexp_matches(decode(content), '<h1[ >]')",
    "page_numbers": f"SELECT {PAGE_KEYS}, text FROM {ONE['pages']} WHERE {IS_PAGE}",
    "prompt_leakage": f"SELECT id, {IS_LEAKED} AS leaked FROM (SELECT book_id || '#' || page_number || '#' || block_ix AS id, text FROM {ONE['pages']} UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM {DOCS})",
    "repeated_headers": f"SELECT h.book_id, h.header, h.n FROM (SELECT book_id, header, count(*) AS n FROM (SELECT DISTINCT book_id, page_number, regexp_replace(text, '[{SPACE}]', '', 'g') AS header FROM {ONE['pages']} WHERE {trim('text')} <> '' AND strlen({trim('text')}) <= 80) GROUP BY book_id, header) h JOIN (SELECT book_id, count(DISTINCT page_number) AS pages FROM {ONE['pages']} GROUP BY book_id) p USING (book_id) WHERE pages >= 3 AND n >= pages // 5",
    "diagram_groups": f"SELECT book_id, page_number, min(block_ix) AS block_ix, CASE WHEN flag THEN 'other' ELSE min(block_type) END AS block_type, string_agg(CASE WHEN flag THEN {trim('text')} ELSE text END, chr(10) ORDER BY block_ix) AS text, count(*) AS merged FROM (SELECT *, {ISLAND} AS island FROM (SELECT *, {IS_LABEL} AS flag FROM {ONE['pages']})) GROUP BY book_id, page_number, island, flag",
    "page_texts": f"SELECT book_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY block_ix) AS full_text FROM {ONE['pages']} GROUP BY book_id, page_number",
    "block_types": f"SELECT {PAGE_KEYS}, CASE WHEN {caption('t')} THEN 'caption' WHEN regexp_matches(t, '^##+ ') OR regexp_matches(t, '^[0-9]+\\.[0-9]') THEN 'subheading' WHEN {heading('t')} THEN 'heading' ELSE 'paragraph' END AS plain_type, {TOP} AS top FROM (SELECT *, {trim('text')} AS t FROM {ONE['pages']})",
    "chapter_split": f"SELECT {PAGE_KEYS}, CAST(greatest(sum(CASE WHEN block_type = 'heading' AND {TOP} THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_number, block_ix), 1) AS BIGINT) AS chapter FROM {ONE['pages']}",
    "caption_pairs": f"SELECT {PAGE_KEYS}, CASE WHEN nt = 'subheading' THEN nx END AS caption FROM (SELECT *, lead(block_type) OVER w AS nt, lead(text) OVER w AS nx FROM {ONE['pages']} WINDOW w AS (PARTITION BY book_id, page_number ORDER BY block_ix)) WHERE block_type = 'other'",
    "table_runs": CELLS,
    "box_unions": f"SELECT p.book_id, p.page_number, b.x, b.y, b.r - b.x AS w, b.b - b.y AS h FROM (SELECT DISTINCT book_id, page_number FROM {ONE['pages']}) p LEFT JOIN (SELECT book_id, page_number, CAST(min(bbox.x) AS BIGINT) AS x, CAST(min(bbox.y) AS BIGINT) AS y, max(CAST(bbox.x AS BIGINT) + bbox.w) AS r, max(CAST(bbox.y AS BIGINT) + bbox.h) AS b FROM {ONE['pages']} WHERE bbox IS NOT NULL GROUP BY book_id, page_number) b USING (book_id, page_number)",
    "verify_candidates": f"SELECT {PAGE_KEYS}, round(a, 6) AS anomaly FROM (SELECT *, {ANOMALY} AS a FROM {with_runs(ONE['pages'], PAGE_KEYS)}) WHERE CAST(confidence AS DOUBLE) < 0.7 OR a > 0.3",
    "box_parse": f"SELECT {PAGE_KEYS}, CAST(bbox.x AS BIGINT) AS x, CAST(bbox.y AS BIGINT) AS y, CAST(bbox.w AS BIGINT) AS w, CAST(bbox.h AS BIGINT) AS h FROM {ONE['pages']} WHERE bbox IS NOT NULL",
    "cleaned_blocks": f"WITH h AS (SELECT h.book_id, h.header FROM (SELECT book_id, header, count(*) AS n FROM (SELECT DISTINCT book_id, page_number, regexp_replace(text, '[{SPACE}]', '', 'g') AS header FROM {ONE['pages']} WHERE {trim('text')} <> '' AND strlen({trim('text')}) <= 80) GROUP BY book_id, header) h JOIN (SELECT book_id, count(DISTINCT page_number) AS pages FROM {ONE['pages']} GROUP BY book_id) p USING (book_id) WHERE pages >= 3 AND n >= greatest(2, pages // 5)) SELECT {PAGE_KEYS}, text FROM (SELECT *, regexp_replace(text, '[{SPACE}]', '', 'g') AS k FROM {ONE['pages']}) p WHERE NOT {IS_LEAKED} AND NOT {IS_PAGE} AND NOT EXISTS (SELECT 1 FROM h WHERE h.book_id = p.book_id AND starts_with(p.k, h.header) AND strlen(p.k) <= strlen(h.header) + 10)",
    "grid_columns": f"WITH c AS (SELECT *, row_number() OVER w - 1 AS cell_no, min(block_ix) OVER (PARTITION BY book_id, page_number, island) AS table_ix, count(*) OVER (PARTITION BY book_id, page_number, island) AS n, max(coalesce(bbox.y, 0)) OVER (PARTITION BY book_id, page_number, island) - min(coalesce(bbox.y, 0)) OVER (PARTITION BY book_id, page_number, island) AS spread, min(bbox.h // 2) OVER (PARTITION BY book_id, page_number, island) AS half FROM (SELECT *, {ISLAND} AS island FROM (SELECT *, block_type = 'table_cell' AS flag FROM {ONE['pages']})) WHERE flag WINDOW w AS (PARTITION BY book_id, page_number, island ORDER BY block_ix)), t AS (SELECT c.*, k.k FROM c, (SELECT unnest(range(2, 200)) AS k) k WHERE n >= 6 AND k <= n // 2 AND n % k = 0 AND spread <= greatest(coalesce(half, 10), 5)), m AS (SELECT *, coalesce(bbox.x, 0) AS x, floor(avg(coalesce(bbox.x, 0)) OVER (PARTITION BY book_id, page_number, table_ix, k, cell_no % k)) AS mean FROM t) SELECT book_id, page_number, table_ix, CAST(min(k) AS INTEGER) AS columns FROM (SELECT book_id, page_number, table_ix, k, bool_or(abs(x - mean) > floor(mean / 6) + 50) AS bad FROM m GROUP BY book_id, page_number, table_ix, k) WHERE NOT bad GROUP BY book_id, page_number, table_ix",
    "plain_answers": f"SELECT doc_id, pos, CASE WHEN {caption('t')} THEN 'caption' WHEN regexp_matches(t, '^##+ ') OR regexp_matches(t, '^[0-9]+\\.[0-9]') THEN 'subheading' WHEN {heading('t')} THEN 'heading' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, pos, {trim('line')} AS t FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') END AS l FROM {DOCS})))",
    "progress_fold": FOLD,
    "stream_progress": FOLD,
    "stream_dedup": "SELECT DISTINCT user_id || '/' || event_type AS cache_key FROM events",
    "stage_remap": f"SELECT task_id, CAST(round(progress * 0.5) AS INTEGER) AS first_stage, CAST(round(progress * 0.5 + 50) AS INTEGER) AS second_stage FROM ({FOLD})",
    "log_search": "SELECT event_id, line FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || props AS line FROM events) WHERE event_type = 'click' AND contains(lower(line), '1')",
    "html_node_counts": "SELECT book_id, idx, " + ", ".join(f"CAST(len(regexp_extract_all(decode(content), '<{t}[ />]')) AS BIGINT) AS {t}" for t in ("h1", "h2", "p", "li", "td", "em", "pre")) + f" FROM {ONE['chapters']}",
    "markdown_tables": f"SELECT book_id, page_number, min(block_ix) AS table_ix, '<table>' || chr(10) || '  <thead>' || chr(10) || '    <tr>' || string_agg('<th>' || c || '</th>', '' ORDER BY block_ix) || '</tr>' || chr(10) || '  </thead>' || chr(10) || '  <tbody>' || chr(10) || '    <tr>' || string_agg('<td>' || c || '</td>', '' ORDER BY block_ix) || '</tr>' || chr(10) || '  </tbody>' || chr(10) || '</table>' AS html FROM (SELECT *, {ESCAPE.format(trim("replace(replace(text, '|', '/'), chr(10), ' ')"))} AS c, {ISLAND} AS island FROM (SELECT *, block_type = 'table_cell' AS flag FROM {ONE['pages']})) WHERE flag GROUP BY book_id, page_number, island",
    "srt_roundtrip": f"SELECT book_id, idx, start_time AS start, end_time AS \"end\", t AS text FROM (SELECT *, {trim("string_split(" + LF_ONLY + ", chr(10) || chr(10))[1]")} AS t FROM {ONE['cues']}) WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND t <> ''",
    "subtitle_books": f"SELECT book_id, 'chapter.xhtml' AS href, count(*) FILTER (WHERE t <> '') AS cues FROM (SELECT *, {trim("string_split(" + LF_ONLY + ", chr(10) || chr(10))[1]")} AS t FROM {ONE['cues']}) WHERE start_time IS NOT NULL AND end_time IS NOT NULL GROUP BY book_id",
    "chunk_pack": CHUNKED,
    "translated": ANSWERED + "SELECT doc_id, translation FROM done",
    "translated_refined": REFINED,
    "verify_best": BEST,
    "translate_bilingual": ANSWERED + f"SELECT doc_id, part, side, CASE WHEN side = 'translation' THEN translation ELSE {trim('text')} END AS text FROM done, ({MODES['bilingual']}) WHERE translation <> ''",
    "new_cache_rows": ANSWERED + f"SELECT DISTINCT sha256('fake:' || c.text) AS cache_key, '[ZH] ' || c.text AS translation FROM chunked c JOIN {DOCS} d USING (doc_id) WHERE d.text NOT IN (SELECT text FROM known) AND c.text NOT IN (SELECT text FROM known)",
    "translated_titles": f"SELECT j.job_id, c.idx, 'toc:' || c.href AS prompt_key, {trim(chr(39) + '[ZH] ' + chr(39) + ' || array_to_string(' + SENTENCES.replace('text', 'c.title').replace('regexp_replace(c.title', 'regexp_replace(c.title') + ', ' + chr(39) + ' ' + chr(39) + ')')} AS translation FROM {ONE['chapters']} c JOIN {ONE['jobs']} j USING (book_id) WHERE c.title IS NOT NULL AND {trim('c.title')} <> '' AND j.job_id IN (SELECT job_id FROM checkpoints) AND NOT EXISTS (SELECT 1 FROM {ONE['stored']} k WHERE k.job_id = j.job_id AND k.idx = c.idx AND k.status = 'failed')",
    "translatable_chapters": f"SELECT book_id, idx FROM {ONE['chapters']} WHERE href IS NULL OR NOT regexp_matches(lower(href), 'cover|titlepage|copyright|dedication|colophon|ch0[12]')",
    "setting_problems": PROBLEMS,
    "connection_problems": f"SELECT job_id, CASE WHEN lower(provider) NOT IN ('fake', 'local', 'remote_a') THEN 'provider' WHEN coalesce(api_key, '') = '' THEN 'api_key' WHEN coalesce(base_url, '') <> '' AND {URL_BAD} IS NOT NULL THEN 'base_url' END AS problem FROM {SETTINGS}",
    "read_settings": f"SELECT job_id, CASE WHEN ok THEN provider END AS provider, CASE WHEN ok THEN CAST(coalesce(max_input_tokens, 4000) AS BIGINT) END AS max_input_tokens, CASE WHEN ok THEN CAST(3 AS BIGINT) END AS concurrency, CASE WHEN ok THEN false END AS refine FROM (SELECT *, coalesce(length(provider) % 7 <> 0, true) AS ok FROM (SELECT * REPLACE (coalesce(provider, 'fake') AS provider) FROM {ONE['jobs']}))",
    "provider_resolution": RESOLUTION,
    "merged_settings": f"SELECT job_id, CAST(CASE WHEN dry_run THEN 500 ELSE coalesce(max_input_tokens, 4000) END AS BIGINT) AS max_input_tokens FROM {SETTINGS}",
    "service_names": f"SELECT job_id, replace(upper(provider), '-', '_') || '_API_KEY' AS key_name, CASE k WHEN 0 THEN starts_with(m, 'gpt-4o') OR contains(m, 'vision') WHEN 1 THEN starts_with(m, 'claude-3') WHEN 2 THEN contains(m, 'llava') OR contains(m, 'vision') WHEN 3 THEN false ELSE true END AS reads_images FROM (SELECT job_id, provider, ascii(substring(job_id, 2, 1)) % 5 AS k, ['gpt-4o-mini', 'claude-3-x', 'llava:7b', 'deepseek-chat', 'gpt-3.5-vision'][ascii(job_id) % 5 + 1] AS m FROM {ONE['jobs']})",
    "interface_locales": f"SELECT book_id, coalesce(list_filter(['en', 'es', 'ja', 'ko', 'ru', 'zh-CN'], lambda x: lower(x) = l)[1], list_filter(['en', 'es', 'ja', 'ko', 'ru', 'zh-CN'], lambda x: starts_with(lower(x), string_split(l, '-')[1]))[1], 'en') AS locale FROM (SELECT book_id, lower(replace(language, '_', '-')) AS l FROM {ONE['books']})",
    "model_lists": "SELECT job_id, coalesce(string_agg(term, '|' ORDER BY entry_id) FILTER (WHERE entry_id % 5 <> 0), '') AS ids, CAST(0 AS BIGINT) AS others FROM (SELECT DISTINCT job_id, entry_id, term FROM glossary WHERE job_id IS NOT NULL AND term IS NOT NULL) GROUP BY job_id",
    "unique_names": f"SELECT book_id, idx, id AS name FROM ({NAMES})",
    "selector_lists": f"SELECT job_id, replace(selectors, ',', '|') || CASE WHEN dry_run THEN '' ELSE '|pre|code' END AS left_out, CASE WHEN selectors = 'pre,code' THEN selectors ELSE selectors || ', code' END AS added FROM {SETTINGS}",
    "system_prompts": f"SELECT j.job_id, CASE WHEN output_mode = 'interleaved' THEN 'Own {{target_lang}}.' ELSE CASE WHEN provider = 'fake' THEN 'Prose from ' ELSE 'From ' END || {SOURCE_NAME} || ' to ' || target_lang || '.' || coalesce(lines, '') END AS prompt, 'Improve ' || target_lang || '.' || coalesce(lines, '') AS refine FROM {ONE['jobs']} j LEFT JOIN {GLOSSARY} g USING (job_id)",
    "chapter_prompts": f"SELECT book_id, idx, CASE href WHEN 'ch001.xhtml' THEN 'first' WHEN 'OEBPS/ch002.xhtml' THEN 'second' ELSE 'general' END AS prompt FROM {ONE['chapters']}",
    "checkpoint_match": f"SELECT k.job_id, k.idx, coalesce(k.source_hash = b.source_hash, false) AS matches_current_source FROM {ONE['stored']} k LEFT JOIN ({ONE['jobs']} j JOIN {ONE['books']} b USING (book_id)) USING (job_id)",
    "checkpoint_files": f"SELECT job_id, idx, status, CASE WHEN content IS NOT NULL THEN md5(content) END AS digest FROM {ONE['stored']} WHERE job_id IN (SELECT job_id FROM {ONE['stored']} WHERE status <> 'failed') AND status <> 'failed' UNION ALL SELECT job_id, idx, status, CASE WHEN content IS NOT NULL THEN md5(content) END FROM {ONE['stored']} WHERE job_id NOT IN (SELECT job_id FROM {ONE['stored']} WHERE status <> 'failed')",
    "epub_chapters": f"SELECT c.book_id, row_number() OVER (PARTITION BY c.book_id ORDER BY c.idx) - 1 AS idx, 'OEBPS/' || h AS href, coalesce(nullif({trim('c.title')}, ''), 'Untitled') AS title, md5(c.content) AS digest, coalesce(nullif({trim('b.title')}, ''), 'Untitled') AS book_title, coalesce(nullif({trim('b.language')}, ''), 'en') AS language, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, CASE WHEN x = '' THEN 'index.xhtml' ELSE x END AS h FROM (SELECT *, regexp_replace(regexp_replace(href, '^/+', ''), '^(?:OEBPS|EPUB)/', '') AS x FROM {ONE['chapters']})) c LEFT JOIN {ONE['books']} b USING (book_id)",
    "epub_resources": f"SELECT book_id, 'OEBPS/css/style.css' AS href, 'text/css' AS mime, coalesce(title, '') AS text FROM {ONE['books']} WHERE book_id IN (SELECT book_id FROM chapters)",
    "text_books": f"SELECT 'd' || doc_id AS book_id, 'd' || doc_id AS title, CAST(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS BIGINT) AS paragraphs FROM {DOCS} WHERE NOT contains(text, chr(13)) AND NOT contains(text, chr(65279))",
    "figure_names": FIGURES,
    "figure_resources": f"SELECT book_id, href, 'image/png' AS mime FROM {FIGURES} UNION ALL SELECT book_id, 'style.css', 'text/css' FROM {ONE['books']}",
    "image_html": f"SELECT book_id, page_number, block_ix, '<figure><img src=\"' || href || '\" alt=\"figure\"/><figcaption>图</figcaption></figure>' AS html FROM {FIGURES}",
    "block_html": f"SELECT {PAGE_KEYS}, CASE block_type WHEN 'heading' THEN '<h1>' || safe || '</h1>' WHEN 'subheading' THEN '<h2>' || safe || '</h2>' WHEN 'table_cell' THEN '<td>' || safe || '</td>' WHEN 'other' THEN CASE WHEN contains(regexp_replace(safe, chr(10) || '$', ''), chr(10)) THEN '<figure><pre>' || safe || '</pre></figure>' ELSE '<p>' || safe || '</p>' END ELSE array_to_string(list_transform({PARAS.replace('{t}', 'safe')}, lambda p: '<p>' || p || '</p>'), chr(10)) END AS html FROM {PAGE_ROWS}",
    "json_types": f"SELECT {PAGE_KEYS}, CASE WHEN base <> 'paragraph' THEN base WHEN bbox IS NULL OR t = '' THEN 'paragraph' WHEN starts_with(t, '图') OR starts_with(t, '表') OR starts_with(t, 'Fig') THEN 'caption' WHEN NOT regexp_matches(t, '[。！？.!?\"”]$') AND (regexp_matches(t, '[μσδαβγθλπω∞∑∫%]') OR (len(l) >= 3 AND strlen(t) // len(l) <= 20)) THEN 'other' ELSE 'paragraph' END AS kind FROM (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS l, CASE WHEN {caption('t')} THEN 'caption' WHEN regexp_matches(t, '^##+ ') OR regexp_matches(t, '^[0-9]+\\.[0-9]') THEN 'subheading' WHEN {heading('t')} THEN 'heading' ELSE 'paragraph' END AS base FROM (SELECT *, {trim('text')} AS t FROM {ONE['pages']}))",
    "crop_boxes": f"SELECT {PAGE_KEYS}, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(greatest(0, least(gw, 1000 - x)) AS BIGINT) AS w, CAST(greatest(0, least(gh, 1400 - y)) AS BIGINT) AS h FROM (SELECT *, greatest(0, least(round_even(bbox.x - (gw - bbox.w) / 2, 0), 1000)) AS x, greatest(0, least(round_even(bbox.y - (gh - bbox.h) / 2, 0), 1400)) AS y FROM (SELECT *, round_even(bbox.w * 1.5, 0) AS gw, round_even(bbox.h * 1.5, 0) AS gh FROM {ONE['pages']} WHERE bbox IS NOT NULL))",
    "page_chapters": f"SELECT book_id, CAST(n - 1 AS INTEGER) AS idx, printf('chapter%03d.xhtml', n) AS href, coalesce(arg_min(first, page_number * 100000 + block_ix) FILTER (WHERE top), 'Chapter') AS title, count(*) FILTER (WHERE top) AS h1, count(*) FILTER (WHERE block_type = 'subheading' OR (block_type = 'heading' AND NOT top)) AS h2, count(*) FILTER (WHERE block_type = 'table_cell' AND NOT coalesce(before, false)) AS table, count(*) FILTER (WHERE block_type = 'table_cell') AS td FROM (SELECT *, greatest(sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_number, block_ix), 1) AS n, lag(block_type = 'table_cell') OVER (PARTITION BY book_id, page_number ORDER BY block_ix) AS before FROM (SELECT *, {trim('string_split(text, chr(10))[1]')} AS first, block_type = 'heading' AND {TOP.replace('text', 'string_split(text, chr(10))[1]')} AS top FROM {ONE['pages']})) GROUP BY book_id, n",
    "last_states": "SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(arg_max(event_id % 101, event_id) AS INTEGER) AS percent, arg_max(event_type, event_id) AS message FROM events GROUP BY user_id",
    "payloads": PAYLOADS,
    "log_entries": LOG,
    "chunk_numbers": f"SELECT doc_id, pos, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS BIGINT) AS first, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM (SELECT doc_id, pos, len({SENTENCES.replace('text', 'paragraph')}) AS n FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS paragraph FROM (SELECT doc_id, {PARAS.replace('{t}', 'text')} AS l FROM {DOCS})))",
    "elapsed": f"SELECT job_id, CAST(greatest(date_diff('second', date_trunc('second', created_at), date_trunc('second', saved)), 0) AS BIGINT) AS seconds FROM {ONE['jobs']} JOIN (SELECT job_id, min(saved_at) AS saved FROM checkpoints GROUP BY job_id) USING (job_id)",
    "refined_pages": f"SELECT book_id, page_number, CAST(row_number() OVER (PARTITION BY book_id, page_number ORDER BY block_ix) - 1 AS INTEGER) AS block_ix, t AS text, coalesce(block_type, 'paragraph') AS block_type, CASE WHEN bool_or(t <> text) OVER (PARTITION BY book_id, page_number) THEN 2 ELSE 1 END AS rounds FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM {ONE['pages']})",
    "srt_html": f"SELECT book_id, idx, '<div class=\"srt-entry\" data-start=\"' || {ESCAPE.format('start_time')} || '\" data-end=\"' || {ESCAPE.format('end_time')} || '\"><p>' || {ESCAPE.format('text')} || '</p></div>' AS html FROM {ONE['cues']} WHERE start_time IS NOT NULL AND end_time IS NOT NULL",
} | {
    f"sentences_{mode}": f"SELECT doc_id, pos, part, side, CASE WHEN side = 'translation' THEN '[ZH] ' || sentence ELSE sentence END AS text FROM ({SPLIT}), ({rows})"
    for mode, rows in MODES.items()
}
