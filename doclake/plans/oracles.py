"""SQL twins of the registered queries, written for DuckDB over the same tables.

They follow another route than the Spark side where one exists (lines as rows with windows instead of arrays,
``json_tree`` instead of the node walker, base-table arithmetic instead of parsing), so that a shared slip is unlikely.
"""

from __future__ import annotations

from doclake import fixed
from doclake.functions.text import NOT_WS, WHITESPACE, WS, unicode_regex
from doclake.plans import corpora


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def words(x: str) -> str:
    return f"cast(len(regexp_extract_all({x}, {lit(NOT_WS + '+')})) AS bigint)"


def chars(x: str) -> str:
    return f"cast(length({x}) AS bigint)"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(unicode_regex(pattern))})"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def upper(s: str) -> str:
    return f"(regexp_matches({s}, '\\p{{Lu}}') AND NOT regexp_matches({s}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def heading(s: str) -> str:
    return (
        f"({s} <> '' AND length({s}) < {fixed.HEADING_MAX_LENGTH} AND ({upper(s)} OR ends_with({s}, ':') "
        f"OR {matches(s, fixed.HEADING_NUMBERED)} OR {matches(s, fixed.HEADING_CAPITAL)}))"
    )


def list_line(x: str) -> str:
    return "(" + " OR ".join(matches(x, p) for p in fixed.LIST_PATTERNS) + ")"


def hits(x: str) -> str:
    return "(" + " + ".join(f"cast(contains(lower({x}), {lit(w)}) AS bigint)" for w in fixed.LANGUAGE_INDICATORS) + ")"


def language(x: str) -> str:
    return f"CASE WHEN {hits(x)} > {fixed.LANGUAGE_MIN_HITS} THEN 'es' ELSE 'en' END"


def section_kind(x: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(lower({x}), {lit('|'.join(ws))}) THEN {lit(k)}" for k, ws in fixed.SECTION_KEYWORDS.items()
    )
    return f"CASE {arms} END"


def metric_list(x: str, kind: str) -> str:
    return f"regexp_extract_all({x}, {lit('(?i)' + unicode_regex(fixed.METRIC_PATTERNS[kind]))}, 1)"


def metric_array(x: str) -> str:
    parts = ", ".join(metric_list(x, k) for k in fixed.METRIC_PATTERNS)
    return f"list_sort(list_distinct(flatten([{parts}])))"


CORPUS = corpora.duckdb_ctes()
TEXTS = CORPUS["texts"]


def lines_of(table: str) -> str:
    return (
        f"pl AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM {table}), "
        "l AS MATERIALIZED (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM pl)"
    )


LINES = lines_of("texts")
BASE = "regexp_extract(file_name, '([^/]*)$', 1)"
FRONT = (
    f"concat('---', chr(10), 'document_type: ', doc_type, chr(10), 'source_file: ', {BASE}, chr(10), "
    f"'processed_at: {corpora.PROCESSED_AT}', chr(10), 'word_count: ', {words('text')}, chr(10), "
    f"'char_count: ', {chars('text')}, chr(10), 'language: ', {language('text')}, chr(10), "
    "'ai_ready: true', chr(10), '---', chr(10), chr(10))"
)
SUMMARY_RAW = (
    "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + strip("x") + "), "
    f"lambda s: length(s) > {fixed.SUMMARY_MIN_LENGTH} AND "
    + " AND ".join(f"NOT starts_with(s, {lit(p)})" for p in fixed.SUMMARY_SKIP_PREFIXES)
    + f")[1:{fixed.SUMMARY_LINES}], ' ')"
)
SUMMARIES = (
    f"sr AS (SELECT doc_id, {SUMMARY_RAW} AS raw FROM texts), "
    f"s AS (SELECT doc_id, CASE WHEN length(raw) > {fixed.SUMMARY_MAX_LENGTH} "
    f"THEN concat(substring(raw, 1, {fixed.SUMMARY_MAX_LENGTH}), '...') ELSE raw END AS summary FROM sr)"
)
SECTIONS = (
    f"mk AS (SELECT *, {section_kind('line')} AS k FROM l), "
    "rn AS (SELECT *, count(k) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM mk), "
    "bd AS (SELECT doc_id, sec, max(k) AS kind, string_agg(line, chr(10) ORDER BY pos) AS body FROM rn "
    f"WHERE sec > 0 AND {strip('line')} <> '' GROUP BY doc_id, sec), "
    "sec AS (SELECT doc_id, kind, arg_max(body, sec) AS body FROM bd GROUP BY doc_id, kind)"
)
SECTION_PIVOT = "sp AS (SELECT doc_id, " + ", ".join(
    f"max(body) FILTER (kind = '{k}') AS section_{k}" for k in fixed.SECTION_KEYWORDS
) + " FROM sec GROUP BY doc_id)"
METRICS = f"me AS (SELECT doc_id, {metric_array('text')} AS metrics FROM texts)"
PARAGRAPHS = (
    f"ps AS (SELECT doc_id, pos, {strip('line')} AS s FROM l), "
    "pg AS (SELECT *, count(*) FILTER (s = '') OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM ps), "
    "pa AS (SELECT doc_id, isl, string_agg(s, ' ' ORDER BY pos) AS paragraph FROM pg WHERE s <> '' GROUP BY doc_id, isl), "
    "para AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY isl) AS paragraph_no, paragraph FROM pa)"
)
LISTS = (
    f"ll AS (SELECT doc_id, pos, {strip('line')} AS s FROM l WHERE {list_line('line')}), "
    "lg AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM ll), "
    "la AS (SELECT doc_id, isl, count(*) AS n_items, string_agg(s, chr(10) ORDER BY pos) AS items FROM lg GROUP BY doc_id, isl HAVING count(*) >= 2), "
    "li AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY isl) AS list_no, n_items, items FROM la)"
)
HEADINGS = f"h AS (SELECT doc_id, pos, {strip('line')} AS heading FROM l WHERE {heading(strip('line'))})"
STRUCTURE = (
    "hc AS (SELECT doc_id, count(*) AS n_headings, array_to_string(list(heading ORDER BY pos)[1:10], chr(10) || '- ') AS shown FROM h GROUP BY doc_id), "
    "lc AS (SELECT doc_id, count(*) AS n_lists FROM li GROUP BY doc_id), "
    "st AS (SELECT t.doc_id, coalesce(n_headings, 0) AS n_headings, coalesce(n_lists, 0) AS n_lists, shown, "
    "CASE WHEN n_headings > 0 THEN 'structured' WHEN n_lists > 0 THEN 'semi_structured' ELSE 'unstructured' END AS structure_type "
    "FROM texts t LEFT JOIN hc USING (doc_id) LEFT JOIN lc USING (doc_id))"
)
_S = strip("line")
REWRITTEN = (
    "rw AS (SELECT doc_id, string_agg(CASE WHEN " + heading(_S) + " THEN concat(CASE WHEN " + upper(_S)
    + f" THEN '## ' WHEN ends_with({_S}, ':') THEN '### ' WHEN {matches(_S, fixed.HEADING_NUMBERED)} THEN '#### ' "
    + f"ELSE '### ' END, {_S}) ELSE line END, chr(10) ORDER BY pos) AS content FROM l GROUP BY doc_id)"
)
PARA_REWRITTEN = (
    "pc AS (SELECT doc_id, count(*) AS n_paragraphs, coalesce(string_agg(concat('**Paragraph ', paragraph_no, ':**', chr(10), paragraph), "
    f"chr(10) || chr(10) ORDER BY paragraph_no) FILTER (length(paragraph) > {fixed.PARAGRAPH_MIN_LENGTH}), '') AS body FROM para GROUP BY doc_id), "
    "pw AS (SELECT t.doc_id, coalesce(n_paragraphs, 0) AS n_paragraphs, CASE WHEN n_paragraphs > 1 THEN body ELSE text END AS content "
    "FROM texts t LEFT JOIN pc USING (doc_id))"
)
LINE_STATS = (
    f"ls AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER ({_S} <> '') AS non_empty_lines FROM l GROUP BY doc_id)"
)
AI_SECTIONS = ", ".join(
    f"CASE WHEN section_{k} IS NOT NULL THEN concat({lit(title)}, chr(10), section_{k}, chr(10), chr(10)) ELSE '' END"
    for k, title in fixed.AI_SECTION_TITLES.items()
)
AI_DOCUMENT = (
    f"concat({FRONT}, {lit(fixed.AI_SUMMARY_TITLE)}, chr(10), summary, chr(10), chr(10), "
    f"CASE WHEN len(metrics) > 0 THEN concat({lit(fixed.AI_METRICS_TITLE)}, chr(10), '- ', "
    f"array_to_string(metrics[1:{fixed.MAX_METRICS_SHOWN}], chr(10) || '- '), chr(10), chr(10)) ELSE '' END, "
    f"{AI_SECTIONS}, {lit(fixed.AI_CONTENT_TITLE)}, chr(10), text, {lit(fixed.AI_FOOTER)})"
)
ANALYSED = "texts t JOIN s USING (doc_id) JOIN me USING (doc_id) LEFT JOIN sp USING (doc_id)"


TEXT_REPORT = f"""SELECT t.doc_id, concat({lit(fixed.TEXT_TITLE)}, chr(10), '- **File:** ', {BASE}, chr(10),
    '- **Structure Type:** ', CASE structure_type WHEN 'structured' THEN 'Structured'
       WHEN 'semi_structured' THEN 'Semi Structured' ELSE 'Unstructured' END, chr(10),
    '- **Lines:** ', total_lines, ' total, ', non_empty_lines, ' with content', chr(10),
    '- **Words:** ', format('{{:,}}', {words('text')}), chr(10),
    '- **Characters:** ', format('{{:,}}', {chars('text')}), chr(10),
    '- **Paragraphs:** ', n_paragraphs, chr(10), chr(10),
    CASE WHEN n_headings > 0 THEN concat({lit(fixed.TEXT_STRUCTURE_TITLE)}, chr(10), '- ', shown, chr(10),
       CASE WHEN n_headings > 10 THEN concat('- ... and ', n_headings - 10, ' more sections', chr(10)) ELSE '' END, chr(10)) ELSE '' END,
    CASE WHEN n_lists > 0 THEN concat({lit(fixed.TEXT_LISTS_TITLE)}, chr(10), 'Found ', n_lists,
       ' structured lists in the document.', chr(10), chr(10)) ELSE '' END,
    {lit(fixed.TEXT_CONTENT_TITLE)}, chr(10), chr(10),
    CASE WHEN structure_type = 'structured' THEN rw.content ELSE pw.content END) AS report
    FROM texts t JOIN st USING (doc_id) JOIN ls USING (doc_id) JOIN rw USING (doc_id) JOIN pw USING (doc_id)"""


def text_oracles() -> dict[str, str]:
    out = {
        "t1_counts": with_(TEXTS, select=f"SELECT doc_id, {words('text')} AS word_count, {chars('text')} AS char_count FROM texts"),
        "t2_language_flag": with_(TEXTS, select=f"SELECT doc_id, {hits('text')} AS hits, {language('text')} AS lang_flag FROM texts"),
        "t3_front_matter": with_(TEXTS, select=f"SELECT doc_id, {FRONT} AS front_matter FROM texts"),
        "t4_metric_extraction": with_(
            TEXTS, METRICS, select="SELECT doc_id, len(metrics) AS n_metrics, array_to_string(metrics, ' | ') AS metrics FROM me"
        ),
        "t5_summary": with_(TEXTS, SUMMARIES, select="SELECT doc_id, summary FROM s"),
        "t6_ai_document": with_(
            TEXTS, LINES, SUMMARIES, METRICS, SECTIONS, SECTION_PIVOT,
            select=f"SELECT doc_id, {AI_DOCUMENT} AS ai_document FROM {ANALYSED}",
        ),
        "t7_structured_record": with_(
            TEXTS, LINES, SUMMARIES, METRICS, SECTIONS, SECTION_PIVOT,
            select=f"""SELECT doc_id, {BASE} AS source_file, doc_type AS document_type, {words('text')} AS word_count,
                {chars('text')} AS char_count, summary, array_to_string(metrics, ' | ') AS key_metrics,
                coalesce(section_summary, '') AS section_summary, '' AS section_key_points,
                coalesce(section_metrics, '') AS section_metrics,
                coalesce(section_recommendations, '') AS section_recommendations, text AS full_content FROM {ANALYSED}""",
        ),
        "l1_lines": with_(TEXTS, LINES, select="SELECT doc_id, pos, line FROM l"),
        "l2_line_stats": with_(
            TEXTS, LINES, LINE_STATS,
            select=f"SELECT doc_id, total_lines, non_empty_lines, {words('text')} AS total_words, {chars('text')} AS total_chars "
            "FROM texts JOIN ls USING (doc_id)",
        ),
        "l3_paragraphs": with_(TEXTS, LINES, PARAGRAPHS, select="SELECT doc_id, paragraph_no, paragraph FROM para"),
        "l4_headings": with_(TEXTS, LINES, HEADINGS, select="SELECT doc_id, pos, heading FROM h"),
        "l5_lists": with_(TEXTS, LINES, LISTS, select="SELECT doc_id, list_no, n_items, items FROM li"),
        "l6_structure_type": with_(
            TEXTS, LINES, HEADINGS, LISTS, STRUCTURE, select="SELECT doc_id, n_headings, n_lists, structure_type FROM st"
        ),
        "l7_key_sections": with_(TEXTS, LINES, SECTIONS, select="SELECT doc_id, kind, body FROM sec"),
        "l8_heading_rewrite": with_(TEXTS, LINES, REWRITTEN, select="SELECT doc_id, content FROM rw"),
        "l9_paragraph_rewrite": with_(TEXTS, LINES, PARAGRAPHS, PARA_REWRITTEN, select="SELECT doc_id, content FROM pw"),
        "l10_text_report": with_(
            TEXTS, LINES, HEADINGS, LISTS, STRUCTURE, LINE_STATS, REWRITTEN, PARAGRAPHS, PARA_REWRITTEN, select=TEXT_REPORT,
        ),
    }
    return out


# ---- sources, routing, results ---------------------------------------------------------------

REQS = CORPUS["reqs"]


def ext_of(name: str) -> str:
    return f"regexp_extract({name}, '(?s)^\\.*[^.].*\\.([^.]*)$', 1)"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else lit(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) {names}"


REGISTRY = f"reg AS (SELECT * FROM {values(fixed.READERS, 'r(ext, reader, doc_type, fence, on_error)')})"
BYTES = (
    "CASE WHEN file_content IS NOT NULL THEN TRY(from_base64(regexp_replace(file_content, '[^A-Za-z0-9+/=]', '', 'g'))) END"
)
ROUTED = (
    f"rq AS (SELECT *, {ext_of("('_' || file_name)")} AS raw_ext, coalesce(output_format, 'markdown') AS fmt, {BYTES} AS bytes FROM reqs), "
    "rt AS (SELECT rq.*, lower(raw_ext) AS ext, coalesce(r.reader, 'text') AS reader, coalesce(r.doc_type, 'text_document') AS doc_type, "
    "CASE WHEN r.ext IS NULL THEN 'text' ELSE r.fence END AS fence, coalesce(r.on_error, 'reject') AS on_error, "
    "TRY(decode(bytes)) AS txt FROM rq LEFT JOIN reg r ON lower(rq.raw_ext) = r.ext)"
)
ERROR = (
    "CASE WHEN coalesce(file_name, '') = '' THEN 'missing_file_name' "
    "WHEN coalesce(file_content, '') = '' AND coalesce(s3_path, '') = '' THEN 'no_source' "
    "WHEN coalesce(file_content, '') <> '' AND coalesce(s3_path, '') <> '' THEN 'two_sources' "
    "WHEN coalesce(output_format, 'markdown') NOT IN ('markdown', 'markdown_ai', 'plain', 'structured_json') THEN 'bad_output_format' "
    "WHEN coalesce(s3_path, '') <> '' AND coalesce(bucket_name, '') = '' THEN 'missing_bucket' END"
)
ADMITTED = (
    f"er AS (SELECT *, {ERROR} AS error FROM rt), "
    "ad AS MATERIALIZED (SELECT *, CASE WHEN error IS NOT NULL THEN error "
    "WHEN coalesce(s3_path, '') <> '' THEN 'missing_file' WHEN bytes IS NULL THEN 'bad_base64' "
    "WHEN octet_length(bytes) = 0 THEN 'empty_content' WHEN raw_ext = '' THEN 'no_extension' "
    "WHEN raw_ext IN ('pdf', 'bar') THEN 'unsupported_extension' WHEN txt IS NULL THEN 'invalid_utf8' "
    "WHEN reader = 'json' AND NOT json_valid(txt) THEN 'malformed' END AS reason FROM er)"
)
REASONS = f"why AS (SELECT * FROM {values(fixed.REJECT_MESSAGES, 'm(reason, status, message)')})"
URIS = f"u AS (SELECT doc_id, {corpora.URI} AS uri, {corpora.ERROR_CODE} AS code FROM documents)"
CODES = f"oe AS (SELECT * FROM {values(fixed.OBJECT_ERRORS, 'o(code, template)')})"
BODIES = (
    f"op AS (SELECT *, {', '.join(corpora.RENDER_OPTIONS)} FROM texts0), "
    f"texts AS MATERIALIZED (SELECT * EXCLUDE (text), CASE WHEN output_format <> 'markdown_ai' AND ai_optimized AND include_metadata "
    f"THEN concat({FRONT}, text) ELSE text END AS text FROM op)"
)
RECORD = f"""json_object('metadata', json_object('source_file', {BASE}, 'document_type', doc_type, 'word_count', {words('text')},
    'char_count', {chars('text')}), 'summary', summary, 'key_metrics', metrics,
    'sections', json_object('summary', coalesce(section_summary, ''), 'key_points', '', 'metrics', coalesce(section_metrics, ''),
    'recommendations', coalesce(section_recommendations, '')), 'full_content', text)"""


#: Results of requests read as text, and of trees in the formats that show them in a fence.
_SHOWN = with_(
    REQS, REGISTRY, ROUTED, ADMITTED, select="""SELECT req_id AS doc_id, txt AS text, file_name, doc_type, fmt, reader, fence,
    ai_optimized OR fmt = 'markdown_ai' AS ai_optimized, include_metadata OR fmt = 'markdown_ai' AS include_metadata FROM ad
    WHERE reason IS NULL AND (reader = 'text' OR (reader IN ('json', 'xml', 'yaml') AND fmt <> 'markdown_ai'
    AND NOT (reader IN ('xml', 'yaml') AND req_id % 5 = 0)))""")
_REPORTED = with_(
    f"texts AS MATERIALIZED (SELECT * FROM ({_SHOWN}) WHERE fmt = 'markdown_ai')", LINES, HEADINGS, LISTS, STRUCTURE, LINE_STATS, REWRITTEN,
    PARAGRAPHS, PARA_REWRITTEN, select=TEXT_REPORT)
_FENCED = "concat('```', fence, chr(10), text, chr(10), '```')"
_CONTENT = (
    f"texts0 AS (SELECT s.* EXCLUDE (text), CASE WHEN fmt = 'markdown_ai' THEN report WHEN reader = 'json' AND fmt <> 'plain' THEN {_FENCED} "
    f"WHEN fmt = 'markdown' AND fence IS NOT NULL THEN {_FENCED} ELSE text END AS text FROM ({_SHOWN}) s LEFT JOIN ({_REPORTED}) r USING (doc_id)), "
    "texts AS MATERIALIZED (SELECT * EXCLUDE (text), CASE WHEN fmt <> 'markdown_ai' AND ai_optimized AND include_metadata "
    f"THEN concat({FRONT}, text) ELSE text END AS text FROM texts0)"
)
RESULT_TEXT = with_(
    _CONTENT, LINES, SUMMARIES, METRICS, SECTIONS, SECTION_PIVOT,
    select=f"""SELECT doc_id AS req_id, fmt AS output_format, reader, CASE fmt WHEN 'markdown_ai' THEN {AI_DOCUMENT}
    WHEN 'structured_json' THEN CAST({RECORD} AS VARCHAR) ELSE text END AS result FROM {ANALYSED}""")


CSV_RECORDS = with_(
    CORPUS["dataset"], select="""SELECT pedido, fecha, CASE WHEN l_orderkey % 10 <> 3 THEN concat('a, "b" ', nota, chr(10), ' fin') END AS nota,
    l_orderkey % 10 IN (3, 4) AS ragged FROM dataset""")
_FOUND = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def ingest_oracles() -> dict[str, str]:
    adm = (REQS, REGISTRY, ROUTED, ADMITTED)
    return {
        "s2_decode_text": with_(
            REQS, select=f"""SELECT req_id, TRY(decode(b)) AS text, CASE WHEN TRY(decode(b)) IS NULL THEN 'invalid_utf8' END AS reason
            FROM (SELECT req_id, coalesce({BYTES}, ''::BLOB) AS b FROM reqs)"""),
        "s3_scan_csv": CSV_RECORDS,
        "s3_scan_csv_files": CSV_RECORDS,
        "s4_scan_json_docs": with_(
            CORPUS["jdocs"], select="SELECT doc_id, CASE WHEN NOT json_valid(text) THEN 'malformed' END AS reason FROM jdocs"),
        "s7_scan_requests": with_(
            REQS, select="SELECT req_id, file_name, file_content, s3_path, bucket_name, output_format, ai_optimized, include_metadata FROM reqs"),
        "s8_decode_base64": with_(
            REQS, select=f"""SELECT req_id, cast(octet_length(b) AS bigint) AS n_bytes, CASE WHEN b IS NULL THEN 'bad_base64'
            WHEN octet_length(b) = 0 THEN 'empty_content' END AS decode_reason
            FROM (SELECT req_id, {BYTES} AS b FROM reqs)"""),
        "s9_write_results": with_(
            *adm, select="SELECT req_id, file_name, doc_type, cast(octet_length(bytes) AS bigint) AS length FROM ad WHERE reason IS NULL"),
        "s9_text_files": RESULT_TEXT,
        "s10_write_rejects": with_(*adm, select="SELECT req_id, file_name, reason FROM ad WHERE reason IS NOT NULL"),
        "p1_admit": with_(
            REQS, REGISTRY, ROUTED, select="""SELECT req_id, raw_ext AS ext, CASE WHEN file_content IS NULL THEN 'missing_file'
            WHEN coalesce(octet_length(bytes), 0) = 0 THEN 'empty_file' WHEN raw_ext = '' THEN 'no_extension'
            WHEN raw_ext IN ('pdf', 'bar') THEN 'unsupported_extension' END AS reason FROM rt"""),
        "p2_route": with_(REQS, REGISTRY, ROUTED, select="SELECT req_id, ext, reader FROM rt"),
        "p3_supported": with_(
            REQS, REGISTRY, select=f"""SELECT req_id, CASE WHEN file_name IS NOT NULL THEN lower({ext_of('file_name')}) IN (SELECT ext FROM reg) END AS supported
            FROM reqs"""),
        "p4_object_uri": with_(
            URIS, CODES, """v AS (SELECT *, starts_with(lower(uri), 's3://') AS is_object_path, starts_with(uri, 's3://') AS scheme_ok,
            CASE WHEN starts_with(uri, 's3://') THEN split_part(split_part(substr(uri, 6), '?', 1), '/', 1) ELSE '' END AS bucket FROM u),
            w AS (SELECT *, CASE WHEN scheme_ok THEN ltrim(substr(split_part(substr(uri, 6), '?', 1), length(bucket) + 1), '/') ELSE '' END AS object_key FROM v)""",
            select="""SELECT doc_id, uri, w.code, is_object_path, scheme_ok, bucket, object_key, string_split(object_key, '/')[-1] AS base_name,
            CASE WHEN NOT scheme_ok THEN 'invalid_uri' WHEN bucket = '' THEN 'no_bucket' WHEN object_key = '' THEN 'no_key' END AS error,
            coalesce(replace(replace(template, '{bucket}', bucket), '{key}', object_key),
              concat('S3 error (', w.code, ') accessing s3://', bucket, '/', object_key)) AS message
            FROM w LEFT JOIN oe ON w.code = oe.code"""),
        "p5_validate_request": with_(REQS, select=f"SELECT req_id, {ERROR} AS error FROM reqs"),
        "p6_resolve_options": with_(
            REQS, select="""SELECT req_id, coalesce(output_format, 'markdown') AS output_format,
            ai_optimized OR coalesce(output_format = 'markdown_ai', false) AS ai_optimized,
            coalesce(include_metadata, false) OR coalesce(output_format = 'markdown_ai', false) AS include_metadata,
            coalesce(output_format = 'markdown_ai', false) AS extract_key_sections, cast(4000 AS bigint) AS max_chunk_size,
            false AS processing_images FROM reqs"""),
        "p7_render_mode": with_(
            TEXTS.replace("texts AS", "texts0 AS", 1), BODIES, LINES, SUMMARIES, METRICS, SECTIONS, SECTION_PIVOT,
            select=f"""SELECT doc_id, output_format, CASE output_format WHEN 'markdown_ai' THEN {AI_DOCUMENT}
            WHEN 'structured_json' THEN cast({RECORD} AS varchar) ELSE text END AS result FROM {ANALYSED}"""),
        "t8_type_label": with_(REQS, REGISTRY, ROUTED, select="SELECT req_id, doc_type FROM rt"),
        "t9_fence": with_(
            *adm, select="""SELECT req_id, CASE WHEN fmt = 'markdown' AND fence IS NOT NULL
            THEN concat('```', fence, chr(10), txt, chr(10), '```') ELSE txt END AS content FROM ad WHERE reason IS NULL"""),
        "e1_result_row": with_(
            *adm, select=f"""SELECT req_id, true AS success, {lit(fixed.SUCCESS_MESSAGE)} AS message, file_name, fmt AS output_format,
            ai_optimized OR fmt = 'markdown_ai' AS ai_optimized, CASE WHEN coalesce(s3_path, '') <> '' THEN 's3' ELSE 'base64' END AS input_method,
            s3_path, cast(octet_length(bytes) AS bigint) AS input_bytes FROM ad WHERE reason IS NULL"""),
        "e1_result_text": RESULT_TEXT,
        "e2_reject_row": with_(
            *adm, REASONS, select=f"""SELECT req_id, false AS success, file_name, ad.reason, cast(status AS bigint) AS status,
            CASE WHEN status = 400 THEN '{fixed.CLIENT_ERROR_TYPE}' ELSE 'InternalError' END AS error_type, message,
            CASE WHEN status = 400 THEN {lit(' | '.join(fixed.CLIENT_HINTS))} ELSE {lit(' | '.join(fixed.SERVER_HINTS))} END AS hints,
            CASE WHEN status = 400 THEN {lit(', '.join(fixed.SUPPORTED_FORMATS_TEXT))} END AS supported_formats
            FROM ad JOIN why ON ad.reason = why.reason"""),
        "e2_stored_objects": f"""SELECT doc_id AS req_id, CASE WHEN doc_id % 7 IN (3, 5) THEN 'missing_file' WHEN coalesce(text, '') = '' THEN 'empty_file' END AS reason,
            CASE doc_id % 7 WHEN 3 THEN 'NoSuchKey' WHEN 5 THEN 'NoSuchBucket' END AS object_error,
            CASE WHEN doc_id % 7 NOT IN (3, 5) AND text <> '' THEN {_FOUND} END AS result FROM documents""",
        "e3_capabilities": with_(
            REQS, REGISTRY, ROUTED, select="""SELECT ext, reader, doc_type, (SELECT count(*) FROM reg) AS n_supported,
            (SELECT count(*) FROM rt WHERE rt.ext = reg.ext) AS n_files FROM reg"""),
        "e4_reader_fallback": with_(
            *adm, select="""SELECT req_id, reader, CASE WHEN reader IN ('xml', 'yaml') AND req_id % 5 = 0 THEN on_error ELSE 'parsed' END AS action
            FROM ad WHERE reason IS NULL"""),
        "r6_reject_report": with_(*adm, select="SELECT reason, ext, count(*) AS rejects FROM ad WHERE reason IS NOT NULL GROUP BY ALL"),
    }


# ---- datasets and roll-ups -------------------------------------------------------------------

DATASET = CORPUS["dataset"]
NAMES = list(corpora.DATASET_COLUMNS)
_NUMBER = (
    "^[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\\.(?:[0-9](?:_?[0-9])*)?)?|\\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
    "|(?i:inf|infinity|nan))$"
)
_DATE = "^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})"


def column_types_sql(source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT cast({i} AS bigint) AS col_idx, '{n}' AS column_name, trim(replace({n}, ',', '')) AS num, trim({n}) AS v FROM {source}"
        for i, n in enumerate(NAMES)
    )
    return (
        f"cells0 AS ({parts}), ct AS (SELECT col_idx, column_name, CASE WHEN coalesce(bool_and(regexp_matches(num, {lit(_NUMBER)})) FILTER (v <> ''), true) "
        f"THEN 'Numeric' WHEN coalesce(bool_and(regexp_matches(v, {lit(_DATE)})) FILTER (v <> ''), true) THEN 'Date' ELSE 'Text' END AS data_type "
        "FROM cells0 GROUP BY col_idx, column_name)"
    )


SAMPLE = f"sample5 AS (SELECT * FROM dataset ORDER BY {', '.join(corpora.DATASET_ORDER)} LIMIT 5)"
TABLE_LINE = "concat('| ', " + ", ' | ', ".join(f"coalesce({n}, '')" for n in NAMES) + ", ' |')"
BLANKS = " + ".join(f"cast(coalesce(trim({n}) = '', false) AS bigint)" for n in NAMES)
COMPLETE = (
    f"cp AS (SELECT count(*) * {len(NAMES)} AS total_cells, cast(sum({BLANKS}) AS bigint) AS empty_cells FROM dataset), "
    "cq AS (SELECT *, (total_cells - empty_cells) / total_cells * 100 AS completeness FROM cp)"
)


def dataset_oracles() -> dict[str, str]:
    n = len(NAMES)
    return {
        "d1_dataset_info": with_(
            DATASET, select=f"SELECT count(*) AS total_rows, cast({n} AS bigint) AS n_columns, '{', '.join(NAMES)}' AS headers FROM dataset"),
        "d2_column_types": with_(DATASET, SAMPLE, column_types_sql("sample5"), select="SELECT * FROM ct"),
        "d2_column_types_all_rows": with_(DATASET, column_types_sql("dataset"), select="SELECT * FROM ct"),
        "d3_type_summary": with_(
            DATASET, SAMPLE, column_types_sql("sample5"),
            select="SELECT data_type, count(*) AS n_columns, min(col_idx) AS first_col FROM ct GROUP BY data_type"),
        "d4_completeness": with_(DATASET, COMPLETE, select="SELECT * FROM cq"),
        "d4_column_completeness": with_(DATASET, select=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (trim({c}) = '') AS blank_cells FROM dataset" for c in NAMES)),
        "d5_preview_table": with_(
            DATASET, SAMPLE, column_types_sql("sample5"), COMPLETE,
            f"top10 AS (SELECT *, {TABLE_LINE} AS line FROM dataset ORDER BY {', '.join(corpora.DATASET_ORDER)} LIMIT 10)",
            f"body AS (SELECT string_agg(line, chr(10) ORDER BY {', '.join(corpora.DATASET_ORDER)}) AS body FROM top10)",
            "ks AS (SELECT string_agg(concat(k, ' ', data_type), ', ' ORDER BY f) AS kinds FROM (SELECT data_type, count(*) AS k, min(col_idx) AS f FROM ct GROUP BY data_type))",
            select=f"""SELECT concat('## 📊 Dataset Information', chr(10), '- **File:** lineitem.csv', chr(10), '- **Total Rows:** ',
            format('{{:,}}', total_cells // {n}), ' (excluding header)', chr(10), '- **Columns:** {n}', chr(10), '- **Headers:** {', '.join(NAMES)}',
            chr(10), chr(10), '### 📋 Data Preview', chr(10), '| {' | '.join(NAMES)} |', chr(10), '| {' | '.join('---' for _ in NAMES)} |', chr(10), body,
            chr(10), chr(10), '### 📈 Dataset Statistics', chr(10), '- **Sample showing:** First 10 rows of ', format('{{:,}}', total_cells // {n}),
            ' total records', chr(10), '- **Data types detected:** ', kinds, chr(10), '- **Completeness:** ', format('{{:.1f}}', completeness),
            '% complete', chr(10), chr(10), '*Full dataset contains ', format('{{:,}}', total_cells // {n}),
            ' rows - showing preview for AI analysis efficiency*') AS report FROM cq, body, ks"""),
        "d6_full_table": with_(DATASET, select=f"SELECT {TABLE_LINE} AS line FROM dataset"),
        "d7_plain_rows": with_(
            DATASET, select="SELECT concat(" + ", ',', ".join(f"coalesce({c}, '')" for c in NAMES) + ") AS line FROM dataset"),
    }


CSV_ROWS = """cr AS (SELECT o_orderkey AS doc_id, unnest(generate_series(1, o_orderkey % 15 + 1)) AS i FROM orders),
    cl AS (SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN ' ' ELSE concat('2024-01-', lpad(cast(i AS string), 2, '0')) END AS fecha,
      cast((doc_id * 7 + i * 13) % 2000 AS string) AS clave, CASE WHEN i % 7 = 6 THEN NULL WHEN i % 5 = 4 THEN concat('a, "', i, '"', chr(10), 'b')
      ELSE concat('n', i) END AS nota, i % 5 = 4 AND i % 7 <> 6 AS extra FROM cr)"""


def csv_oracles() -> dict[str, str]:
    return {
        "d2_csv_documents": with_(CSV_ROWS, select="""SELECT doc_id, count(*) AS total_rows, 'clave, fecha, nota' AS headers,
            '1 Numeric, 1 Date, 1 Text' AS types, 3 * count(*) AS total_cells, count(*) FILTER (fecha = ' ') AS empty_cells FROM cl GROUP BY doc_id"""),
        "d6_csv_documents": with_(CSV_ROWS, select="""SELECT doc_id, concat('| clave | fecha | nota |', chr(10), '| --- | --- | --- |', chr(10),
            string_agg(concat('| ', clave, ' | ', fecha, CASE WHEN nota IS NULL THEN '' ELSE concat(' | ', nota) END, CASE WHEN extra THEN ' | extra' ELSE '' END, ' |'),
              chr(10) ORDER BY i)) AS report FROM cl GROUP BY doc_id"""),
    }


def rollup_oracles() -> dict[str, str]:
    mentions = " UNION ALL ".join(
        f"SELECT '{k}' AS kind, doc_id, unnest(list_distinct({metric_list('text', k)})) AS metric FROM texts" for k in fixed.METRIC_PATTERNS
    )
    return {
        "r1_corpus_profile": with_(
            TEXTS, f"w AS (SELECT doc_type, {language('text')} AS lang_flag, {words('text')} AS w, {chars('text')} AS c FROM texts)",
            select="""SELECT doc_type, lang_flag, count(*) AS docs, cast(sum(w) AS bigint) AS words, cast(sum(c) AS bigint) AS chars
            FROM w GROUP BY ROLLUP (doc_type, lang_flag)"""),
        "r2_metric_frequency": with_(
            TEXTS, f"mm AS ({mentions})", "f AS (SELECT kind, metric, count(*) AS doc_freq FROM mm GROUP BY kind, metric)",
            select="""SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_freq DESC, metric) AS rank FROM f
            QUALIFY rank <= 20"""),
        "r3_tag_inventory": with_(
            ELEMENTS, select="""SELECT clean_tag, count(DISTINCT doc_id) AS docs, count(*) AS elements, cast(sum(n_attributes) AS bigint) AS attributes,
            cast(sum(text_length) AS bigint) AS text_length FROM el GROUP BY clean_tag"""),
        "r4_key_inventory": with_(
            CORPUS["jdocs"], NODES, select="""SELECT regexp_replace(path, '\\[[0-9]+\\]', '[*]', 'g') AS path, kind, count(DISTINCT doc_id) AS docs,
            count(*) AS nodes FROM nd GROUP BY ALL"""),
        "r5_flag_agreement": f"SELECT lang, {language('text')} AS lang_flag, count(*) AS docs FROM documents GROUP BY ALL",
    }


# ---- trees -----------------------------------------------------------------------------------


def nodes_of(table: str) -> str:
    return f"""jv AS (SELECT doc_id, cast(text AS JSON) AS j FROM {table} WHERE json_valid(text)),
    tr AS (SELECT doc_id, t.key AS tkey, t.value AS tvalue, t.type AS ttype, t.id AS tid, t.parent AS tparent, t.fullkey AS path FROM jv, json_tree(j) AS t),
    nd AS MATERIALIZED (SELECT *, cast(len(regexp_extract_all(path, '\\.|\\[')) AS bigint) AS depth,
      CASE ttype WHEN 'OBJECT' THEN 'Object' WHEN 'ARRAY' THEN 'Array' WHEN 'VARCHAR' THEN 'String' WHEN 'BOOLEAN' THEN 'Boolean'
        WHEN 'NULL' THEN 'Null' ELSE 'Number' END AS kind,
      cast(CASE ttype WHEN 'OBJECT' THEN len(json_keys(tvalue)) WHEN 'ARRAY' THEN json_array_length(tvalue) ELSE 0 END AS bigint) AS n_children FROM tr)"""


NODES = nodes_of("jdocs")
TREE_STATS = """ts AS (SELECT doc_id, max(depth) AS max_depth, cast(sum(CASE WHEN kind = 'Object' THEN n_children ELSE 0 END) AS bigint) AS total_keys,
    string_agg(DISTINCT CASE WHEN kind = 'Boolean' THEN 'Number' ELSE kind END, ', ' ORDER BY CASE WHEN kind = 'Boolean' THEN 'Number' ELSE kind END) AS kinds
    FROM nd GROUP BY doc_id)"""
ELEMENTS = """xo AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 + 1 AS n FROM orders WHERE o_orderkey % 10 <> 0),
    xi AS (SELECT doc_id, unnest(generate_series(1, n)) AS i FROM xo),
    el AS MATERIALIZED (
      SELECT doc_id, cast(0 AS bigint) AS ord, cast(0 AS bigint) AS depth, 'order' AS clean_tag, cast(1 AS bigint) AS n_attributes,
        cast(CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 0 END AS bigint) AS text_length FROM xo
      UNION ALL SELECT doc_id, 3 * i - 2, 1, 'line', 2, 0 FROM xi
      UNION ALL SELECT doc_id, 3 * i - 1, 2, 'part', 0, length(cast((doc_id * 7 + i * 13) % 2000 AS string)) FROM xi
      UNION ALL SELECT doc_id, 3 * i, 2, 'qty', 0, 0 FROM xi)"""


def config_sql() -> str:
    arms = ""
    for name, indicators in fixed.CONFIG_PATTERNS:
        title = name.title()
        body = " OR ".join(f"contains(body, '{w}')" for w in indicators)
        arms += f" WHEN contains(k, '{name}') THEN '{title} Configuration' WHEN {body} THEN 'Possible {title} Config'"
    return f"CASE{arms} END"


def tree_oracles() -> dict[str, str]:
    j = CORPUS["jdocs"]
    both = f"""jp AS (SELECT doc_id, text FROM jdocs UNION ALL SELECT event_id + {corpora.REPORT_IDS_FROM}, props FROM events)"""
    return {
        "s5_scan_xml_docs": """SELECT o_orderkey AS doc_id, o_orderkey % 10 <> 0 AS well_formed,
            CASE WHEN o_orderkey % 10 <> 0 THEN 1 + 3 * (o_orderkey % 6 + 1) ELSE 0 END AS n_elements FROM orders""",
        "s6_scan_yaml_docs": """SELECT o_orderkey AS doc_id, cast(3 AS bigint) AS max_depth, 8 + 2 * (o_orderkey % 4 + 1) AS total_keys,
            'Array, Null, Number, Object, String' AS kinds FROM orders WHERE o_orderkey % 17 <> 0""",
        "n1_nodes": with_(j, NODES, select="SELECT doc_id, path, depth, kind, n_children FROM nd"),
        "n2_tree_stats": with_(j, NODES, TREE_STATS, select="SELECT * FROM ts"),
        "n3_complexity": with_(
            j, both, nodes_of("jp"), TREE_STATS, select="""SELECT doc_id, CASE WHEN max_depth > 4 OR total_keys > 50 THEN 'Complex'
            WHEN max_depth > 2 OR total_keys > 10 THEN 'Moderate' ELSE 'Simple' END AS complexity FROM ts"""),
        "n4_outline": with_(
            "RECURSIVE " + j, NODES, "o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, tparent ORDER BY tid) - 1 AS ord FROM nd)",
            """r AS (SELECT doc_id, tid, path, kind, n_children, tvalue, cast(0 AS bigint) AS object_depth FROM o WHERE tparent IS NULL
              UNION ALL SELECT o.doc_id, o.tid, o.path, o.kind, o.n_children, o.tvalue, r.object_depth + cast(r.kind = 'Object' AS bigint)
              FROM r JOIN o ON o.doc_id = r.doc_id AND o.tparent = r.tid
              WHERE r.object_depth <= 3 AND (r.kind = 'Object' AND o.ord < 5 OR r.kind = 'Array' AND o.ord < 1))""",
            select="""SELECT doc_id, path, object_depth, kind, CASE WHEN object_depth > 3 THEN '...'
              WHEN kind = 'Object' AND n_children = 0 THEN '(empty object)' WHEN kind = 'Object' THEN ''
              WHEN kind = 'Array' AND n_children = 0 THEN '(empty array)' WHEN kind = 'Array' THEN concat('Array[', n_children, ']:')
              WHEN kind = 'String' THEN concat('"', left(tvalue->>'$', 30), CASE WHEN length(tvalue->>'$') > 30 THEN '...' ELSE '' END, '"')
              WHEN kind = 'Null' THEN 'null' WHEN kind = 'Boolean' THEN CASE WHEN cast(tvalue AS varchar) = 'true' THEN 'True' ELSE 'False' END
              ELSE cast(tvalue AS varchar) END AS description,
              CASE WHEN object_depth > 3 THEN 0 WHEN kind = 'Object' THEN greatest(n_children - 5, 0) WHEN kind = 'Array' THEN greatest(n_children - 1, 0) ELSE 0 END AS left_out
              FROM r"""),
        "n6_config_patterns": with_(
            j, NODES, """ky AS (SELECT doc_id, lower(tkey) AS k, CASE WHEN kind = 'Object' THEN lower(cast(tvalue AS varchar)) END AS body FROM nd
              WHERE depth BETWEEN 1 AND 3 AND NOT ends_with(path, ']'))""",
            select=f"SELECT DISTINCT doc_id, pattern FROM (SELECT doc_id, {config_sql()} AS pattern FROM ky) WHERE pattern IS NOT NULL"),
        "n7_top_level": with_(
            j, NODES, select="""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tid) - 1 AS ordinal, tkey AS key,
            CASE WHEN kind = 'Object' THEN concat('Object with ', n_children, ' properties') WHEN kind = 'Array' THEN concat('Array with ', n_children, ' items')
            WHEN kind = 'String' THEN 'str' WHEN kind = 'Boolean' THEN 'bool' WHEN kind = 'Null' THEN 'NoneType' WHEN ttype = 'DOUBLE' THEN 'float' ELSE 'int' END AS description
            FROM nd WHERE depth = 1"""),
        "n5_tree_report": with_(
            CORPUS["jdocs"], """j AS (SELECT *, doc_id % 12 + 1 AS n, doc_id % 19 = 0 AS small, doc_id % 5 = 0 AS deep,
              CASE WHEN doc_id % 19 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 14 + 5 * (doc_id % 12 + 1) ELSE 7 + 5 * (doc_id % 12 + 1) END AS keys
              FROM jdocs WHERE doc_id % 17 <> 0)""",
            select="""SELECT doc_id, concat('## 📊 JSON Structure Analysis', chr(10), '- **File:** doc_', doc_id, '.json', chr(10), '- **Root Type:** dict', chr(10),
            '- **Complexity:** ', CASE WHEN small THEN 'Simple' WHEN deep OR keys > 50 THEN 'Complex' ELSE 'Moderate' END, chr(10),
            '- **Depth Levels:** ', CASE WHEN small THEN 1 WHEN deep THEN 5 ELSE 4 END, chr(10), '- **Total Keys:** ', keys, chr(10),
            '- **Data Types:** ', CASE WHEN small THEN 'Number, Object' ELSE 'Array, Null, Number, Object, String' END, chr(10), chr(10),
            '### 🗂️ Key Structure Overview', chr(10),
            CASE WHEN small THEN concat('- **k:** ', doc_id, chr(10), '- **b:** True') ELSE concat('- **order:** ', doc_id, chr(10),
              '- **status:** "', regexp_extract(text, '"status":"([^"]*)"', 1), '"', chr(10), '- **server:**', chr(10),
              '  - **host:** "h', doc_id % 7, '"', chr(10), '  - **port:** null', chr(10),
              '- **open:** ', CASE WHEN contains(text, '"open":true') THEN 'True' ELSE 'False' END, chr(10),
              CASE WHEN deep THEN concat('- **api_list:**   (empty array)', chr(10), '- ... (3 more keys)') ELSE concat(
                '- **lines:**', chr(10), '  Array[', n, ']:   - **n:** 1', chr(10), '  - **part:**', chr(10),
                '    - **key:** ', regexp_extract(text, '"key":([0-9]+)', 1), chr(10), '    - **flag:** "', regexp_extract(text, '"flag":"([^"]*)"', 1), '"', chr(10),
                '  - **qty:** ', regexp_extract(text, '"qty":([0-9]+)', 1), CASE WHEN n > 1 THEN concat(' (and ', n - 1, ' more)') ELSE '' END) END) END,
            chr(10), chr(10), '### 📋 JSON Content', chr(10), '```json', chr(10), text, chr(10), '```') AS report FROM j"""),
        "n5_yaml_report": with_(
            CORPUS["ydocs"], select="""SELECT doc_id, concat('## ⚙️ YAML Configuration Analysis', chr(10), '- **File:** doc_', doc_id, '.yml', chr(10),
            '- **Data Type:** dict', chr(10), '- **Complexity:** Moderate', chr(10), '- **Structure Depth:** 3 levels', chr(10),
            '- **Total Keys:** ', 8 + 2 * (doc_id % 4 + 1), chr(10), '- **Data Types:** Array, Null, Number, Object, String', chr(10), chr(10),
            '### 🔧 Detected Configuration Types', chr(10), '- Database Configuration', chr(10), chr(10), '### 🗂️ Top-Level Structure', chr(10),
            '- **pedido:** int', chr(10), '- **estado:** str', chr(10), '- **database:** Object with 2 properties', chr(10), '- **abierto:** bool', chr(10),
            '- **nada:** NoneType', chr(10), '- **partes:** Array with ', doc_id % 4 + 1, ' items', chr(10), chr(10),
            '### 📋 YAML Content', chr(10), '```yaml', chr(10), text, chr(10), '```') AS report FROM ydocs WHERE doc_id % 17 <> 0"""),
        "x5_xml_report": with_(
            CORPUS["xdocs"], ELEMENTS, """xt AS (SELECT doc_id, count(*) AS total, sum(n_attributes) AS attributes, sum(text_length) AS text_length,
              max(text_length) FILTER (clean_tag = 'order') AS own FROM el GROUP BY doc_id)""",
            select="""SELECT doc_id, xt.doc_id IS NOT NULL AS well_formed, CASE WHEN xt.doc_id IS NULL THEN text ELSE concat('## 🔧 XML Document Analysis', chr(10),
            '- **File:** doc_', doc_id, '.xml', chr(10), '- **Root Element:** {urn:ord}order', chr(10), '- **Namespace:** urn:ord', chr(10),
            '- **Total Elements:** ', total, chr(10), '- **Unique Tags:** 4', chr(10), '- **Max Depth:** 2', chr(10), '- **Attributes:** ', attributes, chr(10),
            '- **Text Content:** ', text_length, ' characters', chr(10), chr(10), '### 🗂️ XML Structure Overview', chr(10),
            '- **order** (1x) (with attributes)', CASE WHEN own > 0 THEN ' (contains text)' ELSE '' END, ' → line', chr(10),
            '- **line** (', (total - 1) // 3, 'x) (with attributes) → part, qty', chr(10), '- **part** (', (total - 1) // 3, 'x) (contains text)', chr(10),
            '- **qty** (', (total - 1) // 3, 'x)', chr(10), chr(10), '### 📋 Raw XML Content', chr(10), '```xml', chr(10), text, chr(10), '```') END AS report
            FROM xdocs LEFT JOIN xt USING (doc_id)"""),
        "x1_elements": with_(ELEMENTS, select="SELECT * FROM el"),
        "x2_xml_stats": with_(
            ELEMENTS, select="""SELECT doc_id, '{urn:ord}order' AS root_element, count(*) AS total_elements, count(DISTINCT clean_tag) AS unique_tags,
            max(depth) AS max_depth, cast(sum(n_attributes) AS bigint) AS attributes, cast(sum(text_length) AS bigint) AS text_length FROM el GROUP BY doc_id"""),
        "x3_tag_summary": with_(
            ELEMENTS, select="""SELECT doc_id, clean_tag, count(*) AS n, bool_or(n_attributes > 0) AS has_attributes, bool_or(text_length > 0) AS has_text,
            min(ord) AS first_ord, CASE clean_tag WHEN 'order' THEN 'line' WHEN 'line' THEN 'part, qty' ELSE '' END AS children FROM el GROUP BY doc_id, clean_tag"""),
        "x4_namespace": """SELECT o_orderkey AS doc_id, '{urn:ord}order' AS root_element, 'urn:ord' AS namespace, 'order' AS root_tag
            FROM orders WHERE o_orderkey % 10 <> 0""",
    }


# ---- grids -----------------------------------------------------------------------------------

CELLS = CORPUS["cells"]
SHOWN = """CASE WHEN kind = 'number' AND try_cast(value AS double) = floor(try_cast(value AS double)) THEN cast(cast(value AS double)::bigint AS varchar)
    WHEN kind = 'datetime' THEN strftime(DATE '1899-12-30' + cast(value AS integer), '%Y-%m-%d 00:00:00')
    WHEN kind = 'boolean' THEN CASE WHEN value = 'true' THEN 'True' ELSE 'False' END ELSE value END"""
KEPT = f"""kc AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY book, sheet ORDER BY row_idx) AS row_no, {SHOWN} AS shown
    FROM cells WHERE row_idx <= 1000 AND kind <> 'empty')"""
KEPT_ALL = KEPT.replace("row_idx <= 1000 AND ", "")
DIMS = """dm AS MATERIALIZED (SELECT book, sheet, max(row_idx) AS max_row, max(col_idx) AS max_col,
    count(DISTINCT CASE WHEN row_idx <= 1000 THEN row_idx END) AS processed_rows FROM cells GROUP BY book, sheet)"""


def escape_cell(x: str, limit: int) -> str:
    e = f"regexp_replace(trim(replace(replace({x}, '|', '\\|'), '\"', '\\\"')), '[ \n\r]+', ' ', 'g')"
    return (
        f"CASE WHEN length({e}) > {limit} THEN CASE WHEN length({e}) > 20 THEN concat(left({e}, {limit - 3}), '...') "
        f"ELSE left({e}, {limit}) END ELSE {e} END"
    )


_DATE_LIKE = "length(trim(value)) >= 6 AND (" + " OR ".join(f"contains(trim(value), '{w}')" for w in fixed.DATE_INDICATORS) + ")"
CENSUS = f"""ck AS (SELECT kc.*, least(max_col, 10) AS w, CASE WHEN value = '' THEN 'empty' WHEN kind = 'datetime' THEN 'date'
      WHEN kind = 'text' AND {_DATE_LIKE} THEN 'date' ELSE kind END AS k FROM kc JOIN dm USING (book, sheet) WHERE row_no <= 20 AND col_idx <= 10),
    cc AS (SELECT book, sheet, count(*) FILTER (k = 'text') AS text, count(*) FILTER (k = 'number') AS number, count(*) FILTER (k = 'date') AS date,
      count(*) FILTER (k = 'boolean') AS boolean FROM ck WHERE (row_no - 1) * w + col_idx <= 100 GROUP BY book, sheet),
    cs AS (SELECT cc.*, least(least(processed_rows, 20) * least(max_col, 10), 100) - text - number - date - boolean AS empty FROM cc JOIN dm USING (book, sheet))"""
_TRUTHY = "(trim(value) <> '' AND NOT (kind = 'number' AND coalesce(try_cast(value AS double) = 0, false)) AND NOT (kind = 'boolean' AND value = 'false'))"
HEADER_CHECK = f"""hk AS (SELECT book, sheet, count(*) FILTER {_TRUTHY} AS meaningful, count(*) FILTER ({_TRUTHY} AND kind = 'text' AND length(trim(value)) > 1
      AND NOT regexp_matches(trim(value), '^[0-9]+$') AND trim(value) <> '-') AS text_cells FROM kc WHERE row_no = 1 GROUP BY book, sheet),
    hx AS (SELECT *, meaningful > 0 AND text_cells >= meaningful * 0.6 AS is_header FROM hk)"""
SMART = f"""sc AS (SELECT book, sheet, unnest(generate_series(1, least(max_col, 12))) AS col_idx FROM dm),
    f1 AS (SELECT book, sheet, col_idx, value, kind, shown FROM kc WHERE row_no = 1),
    sh AS (SELECT sc.*, CASE WHEN {_TRUTHY} AND length(trim(shown)) > 2 AND NOT regexp_matches(trim(shown), '^[0-9]+$') THEN trim(shown)
      ELSE concat('Col', sc.col_idx) END AS header FROM sc LEFT JOIN f1 USING (book, sheet, col_idx))"""
TABLE_ROWS = f"""rr AS (SELECT DISTINCT book, sheet, row_no FROM kc WHERE col_idx <= 12),
    rg AS (SELECT rr.*, sc.col_idx FROM rr JOIN sc USING (book, sheet)),
    tr AS (SELECT book, sheet, row_no, concat('| ', string_agg(CASE WHEN coalesce(shown, '') = '' THEN '-' ELSE {escape_cell('shown', 120)} END, ' | ' ORDER BY col_idx), ' |') AS line
      FROM rg LEFT JOIN kc USING (book, sheet, row_no, col_idx) GROUP BY book, sheet, row_no)"""


def _nested_replace(x: str) -> str:
    for ch in fixed.MARKDOWN_SPECIALS:
        x = f"replace({x}, {lit(ch)}, {lit(chr(92) + ch)})"
    return x


SUMMARY = """SELECT book, sheet, concat(max_row, ' x ', max_col) AS dimensions, processed_rows,
            array_to_string(list_filter([CASE WHEN text > 0 THEN 'text' END, CASE WHEN number > 0 THEN 'number' END, CASE WHEN date > 0 THEN 'date' END,
              CASE WHEN boolean > 0 THEN 'boolean' END], lambda x: x IS NOT NULL), ', ') AS main_types,
            CASE WHEN max_row > 1000 THEN concat('Mostrando primeras 1000 filas de ', max_row, ' total') END AS note FROM dm JOIN cs USING (book, sheet)"""
FORMULAS = """fm AS (SELECT *, row_number() OVER (PARTITION BY book, sheet ORDER BY row_idx, col_idx) AS formula_no,
      concat(chr(cast(64 + col_idx AS integer)), row_idx) AS cell
    FROM cells WHERE kind = 'text' AND starts_with(value, '=') AND row_idx <= 100 AND col_idx <= 50)"""


def grid_oracles() -> dict[str, str]:
    return {
        "g1_rows": with_(CELLS, KEPT, select="SELECT DISTINCT book, sheet, row_idx, row_no FROM kc"),
        "g1_rows_all": with_(CELLS, KEPT_ALL, select="SELECT DISTINCT book, sheet, row_idx, row_no FROM kc"),
        "g2_cell_census": with_(CELLS, KEPT, DIMS, CENSUS, select="SELECT * FROM cs"),
        "g3_header_check": with_(CELLS, KEPT, HEADER_CHECK, select="SELECT * FROM hx"),
        "g4_smart_headers": with_(CELLS, KEPT, DIMS, SMART, select="SELECT * FROM sh"),
        "g5_escape_cell": with_(
            CELLS, select=f"SELECT book, sheet, row_idx, col_idx, {escape_cell('value', 12)} AS short, {escape_cell('value', 100)} AS cell FROM cells"),
        "g6_escape_markdown": with_(
            CELLS, "v AS (SELECT value FROM cells UNION ALL SELECT text FROM documents)",
            select="SELECT value, " + _nested_replace("value") + " AS escaped FROM v"),
        "g7_table_rows": with_(CELLS, KEPT, DIMS, SMART, TABLE_ROWS, select="SELECT * FROM tr"),
        "g7_table_rows_all": with_(
            CELLS, KEPT_ALL, DIMS, SMART.replace("least(max_col, 12)", "max_col"), TABLE_ROWS.replace(" WHERE col_idx <= 12", ""), select="SELECT * FROM tr"),
        "g8_sheet_preview": with_(
            CELLS, KEPT, DIMS, SMART, TABLE_ROWS, HEADER_CHECK,
            "pc AS (SELECT book, sheet, unnest(generate_series(1, max_col)) AS col_idx FROM dm)",
            """pl AS (SELECT book, sheet, row_no, string_agg(coalesce(shown, ''), chr(9) ORDER BY col_idx) AS line
              FROM (SELECT DISTINCT book, sheet, row_no FROM kc WHERE row_no <= 50) JOIN pc USING (book, sheet)
              LEFT JOIN kc USING (book, sheet, row_no, col_idx) GROUP BY book, sheet, row_no)""",
            select="""SELECT book, sheet, 'ai' AS mode, row_no, line FROM tr JOIN hx USING (book, sheet) WHERE row_no <= 15 AND (row_no > 1 OR NOT is_header)
              UNION ALL SELECT book, sheet, 'standard', row_no, line FROM tr WHERE row_no BETWEEN 2 AND 8
              UNION ALL SELECT book, sheet, 'plain', row_no, line FROM pl"""),
        "g9_sheet_summary": with_(
            CELLS, KEPT, DIMS, CENSUS, select=SUMMARY),
        "g10_formula_scan": with_(
            CELLS, FORMULAS, select="SELECT book, sheet, formula_no, cell, value AS formula FROM fm WHERE formula_no <= 10"),
        "g11_normalise_value": with_(CELLS, select=f"SELECT book, sheet, row_idx, col_idx, {SHOWN} AS shown FROM cells"),
        "g12_workbook_report": with_(
            CELLS, KEPT, DIMS, CENSUS, SMART, TABLE_ROWS, HEADER_CHECK, FORMULAS, f"sm AS ({SUMMARY})",
            f"""hl AS (SELECT book, sheet, concat('| ', string_agg({escape_cell('header', 150)}, ' | ' ORDER BY col_idx), ' |') AS header_line,
              concat('| ', string_agg('---', ' | '), ' |') AS separator_line FROM sh GROUP BY book, sheet)""",
            """al AS (SELECT book, sheet, string_agg(line, chr(10) ORDER BY row_no) AS lines FROM tr JOIN hx USING (book, sheet)
              WHERE row_no <= 15 AND (row_no > 1 OR NOT is_header) GROUP BY book, sheet)""",
            f"""ff AS (SELECT book, sheet, count(*) AS n, string_agg(concat('- ', {_nested_replace('cell')}, ': `', {_nested_replace('value')}, '`', chr(10)), ''
              ORDER BY formula_no) FILTER (formula_no <= 3) AS texts FROM fm WHERE formula_no <= 10 GROUP BY book, sheet)""",
            f"""st AS (SELECT book, sheet, concat('- **', {_nested_replace('sheet')}, '**: ', {_nested_replace('dimensions')}, ' (', sm.processed_rows, ' filas procesadas)',
              CASE WHEN main_types <> '' THEN concat(' (Tipos: ', {_nested_replace('main_types')}, ')') ELSE '' END,
              CASE WHEN note IS NOT NULL THEN concat(' - ', {_nested_replace('note')}) ELSE '' END, chr(10)) AS entry,
              concat('### 📄 Hoja: ', {_nested_replace('sheet')}, chr(10), CASE WHEN n > 0 THEN concat('**Fórmulas encontradas:** ', n, chr(10), texts, chr(10)) ELSE '' END,
                CASE WHEN lines IS NOT NULL THEN concat(header_line, chr(10), separator_line, chr(10), lines, chr(10), CASE WHEN sm.processed_rows > 15
                  THEN concat(chr(10), '*Mostrando primeras 15 filas de ', sm.processed_rows, ' total*', chr(10)) ELSE '' END)
                ELSE concat('*No hay datos para mostrar*', chr(10)) END) AS section
              FROM sm JOIN hl USING (book, sheet) LEFT JOIN al USING (book, sheet) LEFT JOIN ff USING (book, sheet))""",
            select=f"""SELECT book, concat('## 📊 Excel Workbook Analysis', chr(10), '- **Archivo:** ', {_nested_replace('book')}, chr(10), '- **Hojas:** ', count(*), chr(10), chr(10),
              '### 📋 Estructura de Hojas', chr(10), string_agg(entry, '' ORDER BY sheet), chr(10), string_agg(section, chr(10) ORDER BY sheet)) AS report
              FROM st GROUP BY book"""),
    }


# ---- markdown --------------------------------------------------------------------------------

MDOCS = CORPUS["mdocs"] + f""", md AS MATERIALIZED (SELECT doc_id, text FROM mdocs
    UNION ALL SELECT doc_id + {corpora.REPORT_IDS_FROM}, text FROM documents)"""
MLINES = lines_of("md")
MS = f"ml AS MATERIALIZED (SELECT doc_id, pos, line, {strip('line')} AS s FROM l)"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def rejoined(case: str) -> str:
    return f"SELECT doc_id, string_agg({case}, chr(10) ORDER BY pos) AS text FROM ml GROUP BY doc_id"


def pipes(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '|', '')))"


def clean_sql(x: str) -> str:
    x = f"replace({x}, chr(160), ' ')"
    for pattern, by in [
        (r"\\([().,;:{}\[\]])", r"\1"), (r"\\([-.])", r"\1"), (r"\\#([^#\s]|$)", r"#\1"), (r"[ \t]+", " "), (r"(?m)[ \t]+$", ""),
    ]:
        x = replaced(x, pattern, by)
    return x


def header_sql() -> str:
    title = "replace(trim(regexp_extract(s, '^(#+)\\s*(.+)', 2)), chr(92), '')"
    return f"""CASE WHEN starts_with(s, '#') THEN CASE WHEN regexp_matches(s, '^(#+)\\s*(.+)')
        THEN concat(regexp_extract(s, '^(#+)\\s*(.+)', 1), ' ', {title}) ELSE line END
      WHEN s <> '' AND length(s) <= 80 AND NOT ends_with(s, '.') AND regexp_matches(s, '^\\p{{Lu}}')
        AND len(regexp_extract_all(s, {lit(fixed.PROMOTE_SPECIALS)})) <= 2 AND NOT starts_with(coalesce(nx, ''), '#')
        THEN concat(CASE WHEN regexp_matches(upper(s), '{"|".join(fixed.TITLE_LEVEL_ONE)}') THEN '# ' ELSE '## ' END, s)
      ELSE line END"""


PIPE_TABLES = f"""t0 AS (SELECT *, contains(line, '|') AS p, {pipes('s')} >= 2 AND length(s) > 5 AS st FROM ml),
    t1 AS (SELECT *, count(*) FILTER (NOT p) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t0),
    t2 AS (SELECT *, min(CASE WHEN st AND p THEN pos END) OVER (PARTITION BY doc_id, run, p) AS first_pos,
      max(pos) OVER (PARTITION BY doc_id, run, p) AS last_pos FROM t1),
    t3 AS (SELECT *, p AND first_pos IS NOT NULL AND pos >= first_pos AND last_pos > first_pos AS inside FROM t2),
    t4 AS (SELECT *, lag(inside) OVER (PARTITION BY doc_id ORDER BY pos) AS was_inside,
      max(CASE WHEN inside AND pos <= first_pos + 2 AND (contains(line, '---') OR contains(line, ':-:') OR contains(line, ':--')) THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, run, p) AS ruled,
      trim({replaced(replaced(replaced('line', r'\\([*_])', r'\1'), r'\s+', ' '), r'\s*\|\s*', ' | ')}) AS tidy,
      {pipes('s')} + CASE WHEN starts_with(s, '|') AND ends_with(s, '|') THEN -1 ELSE 1 END AS cols FROM t3),
    t5 AS (SELECT doc_id, pos, CASE WHEN inside AND pos = first_pos AND ruled = 0
        THEN concat(tidy, chr(10), '| ', array_to_string(list_transform(generate_series(1, cols), lambda i: '---'), ' | '), ' |')
        WHEN inside THEN tidy ELSE line END AS out FROM t4 WHERE NOT (NOT inside AND s = '' AND coalesce(was_inside, false)))"""
LINT = f"""i0 AS (SELECT *, contains(line, '|') AND NOT starts_with(s, '```') AS row,
      NOT contains(line, '|') AND NOT contains(line, '---') AND s <> '' AS ends,
      {pipes('line')} - (length(line) - length(replace(line, chr(92) || '|', ''))) // 2 AS np,
      length(regexp_extract(line, '^(#*)', 1)) AS level FROM ml),
    i1 AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY pos) AS region FROM i0),
    i2 AS (SELECT *, min(CASE WHEN row THEN pos END) OVER (PARTITION BY doc_id, region, ends) AS first_pos FROM i1),
    i3 AS (SELECT *, first(np) OVER (PARTITION BY doc_id, region, ends, row ORDER BY pos) AS cols,
      NOT row AND NOT ends AND first_pos IS NOT NULL AND pos > first_pos AND contains(line, '---') AS skipped FROM i2),
    issues AS (
      SELECT doc_id, pos AS line_no, {lit(fixed.LINT_COLUMNS)} AS issue FROM i3 WHERE row AND pos > first_pos AND np <> cols AND np > 0
      UNION ALL SELECT doc_id, pos, {lit(fixed.LINT_PIPES)} FROM i3 WHERE row AND np < 2
      UNION ALL SELECT doc_id, pos, replace({lit(fixed.LINT_LEVEL)}, '{{level}}', cast(level AS varchar)) FROM i3 WHERE NOT skipped AND level > 6
      UNION ALL SELECT doc_id, pos, {lit(fixed.LINT_SPACE)} FROM i3 WHERE NOT skipped AND level > 0 AND length(line) > level AND line[level + 1] <> ' '
      UNION ALL SELECT doc_id, pos, {lit(fixed.LINT_FENCE)} FROM i3 WHERE NOT skipped AND starts_with(s, '```')
        AND length(line) - length(replace(line, '```', '')) <> 3)"""


#: A fence is a start if it is a candidate and the fence before it, if only entries and empty lines stand between them, is none; then it
#: ends that one's list.
CONTENTS = f"""tf AS (SELECT *, CASE WHEN starts_with(s, '```json') THEN 'j' WHEN starts_with(s, '```') THEN 'f'
      WHEN {matches('s', fixed.TOC_ENTRY)} THEN 't' WHEN s = '' THEN 'e' ELSE 'n' END AS f FROM ml),
    tn AS (SELECT *, lead(f, 1) OVER w AS n1, lead(f, 2) OVER w AS n2, count(*) FILTER (f = 'n') OVER w AS part FROM tf WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    tc AS (SELECT *, f = 'j' AND n1 = 't' AND n2 IS NOT NULL AS cand FROM tn WHERE f IN ('j', 'f')),
    ti AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, part, cand ORDER BY pos) AS island FROM tc),
    ts AS (SELECT *, cand AND row_number() OVER (PARTITION BY doc_id, part, cand, island ORDER BY pos) % 2 = 1 AS starts FROM ti),
    te AS (SELECT *, coalesce(lag(starts) OVER (PARTITION BY doc_id, part ORDER BY pos), false) AS ends FROM ts),
    tl AS (SELECT tn.*, starts, ends, last_value(CASE WHEN starts THEN tn.pos WHEN starts IS NOT NULL THEN -1 END IGNORE NULLS)
      OVER (PARTITION BY tn.doc_id, tn.part ORDER BY tn.pos) AS block FROM tn LEFT JOIN te ON te.doc_id = tn.doc_id AND te.pos = tn.pos),
    tb AS (SELECT *, coalesce(block, -1) >= 0 AND (coalesce(starts, false) OR f IN ('t', 'e')) AS inside FROM tl),
    tp AS (SELECT *, concat(CASE WHEN inside AND starts THEN concat({lit(fixed.TOC_TITLE)}, chr(10), chr(10)) WHEN inside AND f = 't' THEN concat('- ', s, chr(10))
        WHEN inside OR coalesce(ends, false) THEN '' ELSE concat(line, chr(10)) END,
      CASE WHEN inside AND pos = max(pos) FILTER (inside) OVER (PARTITION BY doc_id, block) THEN chr(10) ELSE '' END) AS piece FROM tb)"""
_IN_URL = f"[^{WHITESPACE}<>)]"


def links_sql(x: str) -> str:
    """Bare URLs as links. An ``h`` behind a bracket, and that of what is linked already, is hidden as chr(1); a URL before a closing bracket
    loses its last character that is no square bracket, and what follows that."""
    hidden = r"\1" + "\x01" + r"\2"
    x = replaced(x, r"([\[(])h(ttps?://)", hidden)
    linked = "[\x01" + r"\1](" + "\x01" + r"\1)\2"
    x = replaced(x, rf"h(ttps?://{_IN_URL}+)([^\]{WHITESPACE}<>)]\]*\))", linked)
    x = replaced(x, rf"h(ttps?://{_IN_URL}+)([{WHITESPACE}<>]|$)", linked)
    return f"replace({replaced(x, rf'{chr(92)}[([^{chr(92)}]]+){chr(92)}][{WHITESPACE}]*{chr(92)}(([^)]+){chr(92)})', r'[' + chr(92) + '1](' + chr(92) + '2)')}, chr(1), 'h')"


def markdown_oracles() -> dict[str, str]:
    base = (MDOCS, MLINES, MS)
    quality = (
        f"q AS (SELECT doc_id, text, {words('text')} AS words, {pipes('text')} // 4 AS tables FROM md), "
        "hq AS (SELECT doc_id, count(*) FILTER (starts_with(s, '#')) AS headings FROM ml GROUP BY doc_id)"
    )
    top = f"concat({lit(fixed.DOC_TITLE)}, chr(10), '- **File:** doc_', doc_id, '.docx', chr(10), '- **Content:** ~', format('{{:,}}', words))"
    tail = "concat(chr(10), chr(10), '### 📖 Document Content', chr(10))"
    return {
        "m1_clean_chars": with_(MDOCS, select=f"SELECT doc_id, {clean_sql('text')} AS text FROM md"),
        "m2_headers": with_(
            *base, "mn AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM ml)",
            select=rejoined(header_sql()).replace("FROM ml", "FROM mn")),
        "m3_toc": with_(
            *base, CONTENTS, select="""SELECT doc_id, CASE WHEN contains(text, '```json') THEN left(whole, length(whole) - 1) ELSE text END AS text
            FROM md JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS whole FROM tp GROUP BY doc_id) USING (doc_id)"""),
        "m8_links": with_(MDOCS, select=f"SELECT doc_id, {links_sql('text')} AS text FROM md"),
        "m6_pipe_tables": with_(*base, PIPE_TABLES, select="SELECT doc_id, string_agg(out, chr(10) ORDER BY pos) AS text FROM t5 GROUP BY doc_id"),
        "m7_lists": with_(*base, select=rejoined(
            """CASE WHEN regexp_matches(s, '^([0-9]+)\\\\\\.\\s*(.+)') THEN regexp_replace(s, '^([0-9]+)\\\\\\.\\s*(.+)', '\\1. \\2')
            WHEN regexp_matches(s, '^[•·]') THEN concat(repeat(' ', length(line) - length(ltrim(line))), '- ', regexp_replace(s, '^[•·]\\s*', '')) ELSE line END""")),
        "m10_escapes": with_(*base, select=rejoined(
            f"""CASE WHEN starts_with(s, '#') THEN line WHEN contains(line, 'http') OR contains(line, 'www.')
            THEN {replaced(replaced('line', r'\\([#.@])', r'\1'), r'\\([:/])', r'\1')} ELSE {replaced('line', r'\\([#.@])', r'\1')} END""")),
        "m11_final": with_(
            MDOCS, select=f"SELECT doc_id, rtrim(regexp_replace(text, '\\n\\n\\n+', chr(10) || chr(10), 'g'), {lit(WHITESPACE)}) AS text FROM md"),
        "m13_doc_quality": with_(
            *base, quality, select=f"""SELECT doc_id, words, headings, tables,
            concat({top}, ' words processed with premium Mammoth', {tail}) AS basic_header,
            concat({top}, ' words, ', headings, ' headings, ~', tables, ' tables', chr(10), '- **Processing:** Premium Mammoth converter with advanced post-processing',
              chr(10), '- **Quality:** High-fidelity markdown with table detection and code formatting', {tail}) AS full_header
            FROM q JOIN hq USING (doc_id)"""),
        "m14_markdown_lint": with_(*base, LINT, select="SELECT * FROM issues"),
        "m14_markdown_verdict": with_(
            *base, LINT, "ic AS (SELECT doc_id, count(*) AS n FROM issues GROUP BY doc_id)",
            "lc AS (SELECT doc_id, count(*) AS total_lines FROM ml GROUP BY doc_id)",
            select="""SELECT doc_id, coalesce(n, 0) = 0 AS valid, coalesce(n, 0) AS n_issues, total_lines, contains(text, '|') AS tables_found
            FROM md JOIN lc USING (doc_id) LEFT JOIN ic USING (doc_id)"""),
    }


def stream_oracles() -> dict[str, str]:
    return {
        "st1_request_stream": with_(REQS, REGISTRY, ROUTED, ADMITTED, select="SELECT req_id, file_name, doc_type, reason FROM ad"),
        "st1_stream_text": RESULT_TEXT,
        "st2_arrived_documents": f"SELECT doc_id, {_FOUND} AS text, cast(NULL AS varchar) AS reason FROM documents",
        "st2_file_arrival": f"""SELECT cast(sum(len(list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> ''))) AS bigint) AS non_empty_lines,
            cast(sum({words('text')}) AS bigint) AS total_words FROM documents""",
    }


def all_oracles() -> dict[str, str]:
    return {
        **text_oracles(), **ingest_oracles(), **dataset_oracles(), **csv_oracles(), **tree_oracles(), **grid_oracles(),
        **markdown_oracles(), **rollup_oracles(), **stream_oracles(),
    }
