"""SQL per query for the check engine, on the same tables."""

from __future__ import annotations

import re

from doclake import constants as C
from doclake.plans import oracle_markdown as M
from doclake.plans.derived import DUCK_VIEWS, NOW_LIVE, NOW_SWEEP
from doclake.plans.registry import AWKWARD_NAME, JOB_COLUMNS, MARKDOWN_RULES, OLD_HASH, TICK, TICKS

ORACLES: dict[str, str] = {}

_SHARED = {
    "mixed_jobs": f"""SELECT * REPLACE (CASE WHEN page_total % 3 = 0 THEN substring(sha256({OLD_HASH}), 1, 16)
        ELSE opts_hash END AS opts_hash) FROM jobs""",
    "awkward_jobs": f"SELECT * REPLACE ({AWKWARD_NAME} AS filename) FROM jobs",
    "option_table": f"""SELECT img = 1 AS include_images, csv = 1 AS include_csv,
        substring(sha256(concat('rev={C.CONVERTER_REV};img=', img, ';csv=', csv)), 1, 16) AS opts_hash
        FROM (SELECT unnest([0, 0, 1, 1]) AS img, unnest([0, 1, 0, 1]) AS csv)""",
    "probe": rf"""SELECT doc_id, any_value(n) AS n_pages, sum(CASE WHEN page_no % greatest(1, n // {C.PROBE_PAGES}) = 0
        THEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) ELSE 0 END) AS text_chars
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM page_text) GROUP BY doc_id""",
    "cached": """SELECT sha256, opts_hash, id AS cached_id, result_dir, n_tables, n_images FROM (
        SELECT *, row_number() OVER (PARTITION BY sha256, opts_hash ORDER BY created_at DESC, id DESC) AS r
        FROM jobs WHERE status = 'done') WHERE r = 1""",
    "probed": """SELECT u.*, coalesce(p.n_pages, 0) AS n_pages, coalesce(p.text_chars, 0) AS text_chars
        FROM uploads u LEFT JOIN probe p ON p.doc_id = u.upload_id""",
    "quota_input": f"""SELECT p.*, c.cached_id, c.result_dir, c.n_tables, c.n_images,
        c.cached_id IS NULL AND is_pdf AND NOT broken AND length <= {C.MAX_BYTES}
          AND n_pages BETWEEN 1 AND {C.MAX_PAGES} AND text_chars >= {C.MIN_TEXT_CHARS} AS eligible
        FROM probed p LEFT JOIN cached c ON p.sha256 = c.sha256 AND p.opts_hash = c.opts_hash""",
    "judged": f"""SELECT *, CASE WHEN length > {C.MAX_BYTES} THEN 'too_big' WHEN NOT is_pdf THEN 'not_pdf'
        WHEN over_quota THEN 'over_quota' WHEN broken THEN 'broken' WHEN n_pages = 0 THEN 'empty'
        WHEN n_pages > {C.MAX_PAGES} THEN 'too_many_pages' WHEN text_chars < {C.MIN_TEXT_CHARS} THEN 'no_text' END AS reason
        FROM (SELECT q.*, coalesce(j.n, 0) + coalesce(sum(eligible::int) OVER (PARTITION BY q.session_id
          ORDER BY arrival, upload_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          >= {C.MAX_QUEUED_PER_SESSION} AS over_quota
          FROM quota_input q LEFT JOIN (SELECT session_id, count(*) AS n FROM jobs WHERE status = 'queued'
            GROUP BY session_id) j ON j.session_id = q.session_id)""",
    "ahead_prev": """SELECT j.*, CASE WHEN status = 'queued' THEN (SELECT count(*) FROM jobs a
        WHERE a.status IN ('queued', 'running') AND a.created_at < j.created_at) END AS ahead FROM jobs j""",
    "ahead_curr": """SELECT j.*, CASE WHEN status = 'queued' THEN (SELECT count(*) FROM curr_jobs a
        WHERE a.status IN ('queued', 'running') AND a.created_at < j.created_at) END AS ahead FROM curr_jobs j""",
    "sent": """SELECT c.* FROM ahead_curr c LEFT JOIN ahead_prev p ON c.id = p.id
        WHERE p.id IS NULL OR c.status = 'running' OR c.status IS DISTINCT FROM p.status
          OR c.finished_at IS DISTINCT FROM p.finished_at OR coalesce(c.ahead, 0) <> coalesce(p.ahead, 0)""",
    "delta": f"""SELECT * FROM curr_jobs WHERE finished_at = {NOW_LIVE}
        UNION ALL SELECT * REPLACE (concat('new-', id) AS id) FROM curr_jobs WHERE status = 'failed'""",
    "shown_prev": "SELECT *, {LABEL} AS label FROM (SELECT *, {PROGRESS} AS progress FROM ahead_prev)",
    "shown_curr": "SELECT *, {LABEL} AS label FROM (SELECT *, {PROGRESS} AS progress FROM ahead_curr)",
    # pipe rows, numbered in islands
    "pipe_lines": r"""SELECT doc_id, n, x, k, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS table_no FROM (
        SELECT *, min(CASE WHEN dashes AND place > 1 THEN n END) OVER (PARTITION BY doc_id, island) AS k FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY n) AS place,
            regexp_matches(x, '^\s*\|(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*$') AS dashes FROM (
            SELECT doc_id, n, x, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM raw_lines
            WHERE regexp_matches(x, '^\s*\|')))) WHERE n >= k - 1""",
    "table_rows": r"""SELECT doc_id, table_no, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY n) - 1 AS row_no,
        list_transform(string_split(regexp_replace(regexp_replace(x, '^\s*\|', ''), '\|\s*$', ''), '|'),
          lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')) AS cells
        FROM pipe_lines WHERE n <> k""",
}
_PROGRESS = f"""CASE WHEN status = 'done' THEN 100 WHEN status = 'running' AND coalesce(started_at, 0) <> 0
    THEN CAST(trunc(least(95.0, ({NOW_LIVE} - started_at) / greatest(1.0, coalesce(nullif(page_total, 0), 1)
      * {C.SEC_PER_PAGE}) * 100)) AS int) ELSE 0 END"""
_LABEL = f"""CASE status WHEN 'done' THEN '{C.LABEL_DONE}' WHEN 'running' THEN concat(progress, '%')
    WHEN 'failed' THEN '{C.LABEL_FAILED}' ELSE CASE WHEN ahead = 0 THEN '{C.LABEL_STARTING}'
    ELSE concat('{C.LABEL_AHEAD[0]}', ahead, '{C.LABEL_AHEAD[1]}') END END"""
_VIEWS = DUCK_VIEWS | {k: v.replace("{PROGRESS}", _PROGRESS).replace("{LABEL}", _LABEL) for k, v in _SHARED.items()}


def _with(body: str, ctes: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``body`` preceded by the views it needs, directly or through other views."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name, view in _VIEWS.items():
            if name not in ordered and re.search(rf"\b{name}\b", sql):
                visit(view)
                if name not in ordered:
                    ordered.append(name)

    for _, sql in ctes:
        visit(sql)
    visit(body)
    parts = [(name, _VIEWS[name]) for name in ordered] + list(ctes)
    if not parts:
        return body
    # a recursive statement cannot be materialized; everything else is computed once
    listed = ",\n".join(f"{name} AS {'' if recursive and re.search(rf'FROM {name} r', sql) else 'MATERIALIZED '}({sql})"
                        for name, sql in parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}{listed}\n{body}"


def _add(name: str, body: str, ctes: list[tuple[str, str]] = (), recursive: bool = False) -> None:
    ORACLES[name] = _with(body, ctes, recursive)


# --- sources and sinks
_add("scan_uploads", """SELECT part, length, length > 50000 AS too_big, CASE WHEN length <= 50000 THEN length END AS n_read
    FROM (SELECT doc_id % 64 AS part, CAST(sum(strlen(text) + 1) AS bigint) AS length FROM documents GROUP BY 1)""")
_add("magic_test", "SELECT doc_id, doc_id % 17 <> 0 AS is_pdf FROM documents")
_add("content_hash", """SELECT sha256(text) AS sha256, max(strlen(text)) AS length, count(*) AS n_copies
    FROM documents GROUP BY 1""")
_add("document_lines", """SELECT doc_id, unnest(range(len(a))) AS n, unnest(a) AS x
    FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)""")
_add("document_roundtrip", "SELECT doc_id, text FROM documents")
_add("result_sink", """SELECT DISTINCT sha256(text) AS sha256,
    substring(sha256(concat('rev=7;img=', doc_id % 2, ';csv=1')), 1, 16) AS opts_hash, text,
    CAST(n_chars % 7 AS int) AS n_tables, CAST(n_chars % 5 AS int) AS n_images FROM documents""")
_add("table_csv_sink", r"""SELECT doc_id, printf('table-%02d', table_no) AS table,
    concat(chr(65279), coalesce(string_agg(array_to_string(list_transform(cells, lambda c:
      CASE WHEN regexp_matches(c, '[",\r\n]') THEN concat('"', replace(c, '"', '""'), '"') ELSE c END), ','),
      chr(10) ORDER BY row_no), ''), chr(10)) AS csv
    FROM (SELECT DISTINCT doc_id, table_no FROM pipe_lines) LEFT JOIN table_rows USING (doc_id, table_no)
    GROUP BY doc_id, table_no""")
ORACLES["packed_csv"] = (ORACLES["table_csv_sink"].replace("printf('table-%02d', table_no) AS table", "CAST(table_no AS int) AS table_no")
                         .replace("''), chr(10)) AS csv", "'')) AS csv"))
_add("upsert_results", """SELECT sha256, opts_hash, id, finished_at, n_tables, n_images FROM jobs WHERE status = 'done'
    QUALIFY row_number() OVER (PARTITION BY sha256, opts_hash ORDER BY finished_at DESC, id DESC) = 1""")
_BASE = r"""CASE WHEN regexp_matches(stem, '^\.*$') THEN 'file' ELSE stem END"""
_STEM = r"""trim(regexp_replace(regexp_replace(regexp_extract(filename, '[^/]*$'), '^(.+)\.[^.]+$', '\1'),
    '[\\/:*?"<>|]', '_', 'g'))"""
_add("safe_names", f"""SELECT id, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k - 1) END AS folder FROM (
    SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY created_at DESC, id) AS k FROM (
      SELECT id, created_at, {_BASE} AS base FROM (SELECT *, {_STEM} AS stem FROM awkward_jobs)))""")
_add("bundle_manifest", f"""SELECT id, folder, rel_path, concat(folder, '/', rel_path) AS entry FROM (
      SELECT id, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k - 1) END AS folder FROM (
        SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY created_at DESC, id DESC) AS k FROM (
          SELECT id, created_at, {_BASE} AS base FROM (SELECT *, {_STEM} AS stem FROM awkward_jobs
            WHERE status = 'done' AND result_dir NOT LIKE 'r/0%')))),
      (SELECT unnest(['doc.md', 'images/image-1.png', 'tables/table-01.csv']) AS rel_path)""")

# --- admission
_add("text_probe", "SELECT doc_id, n_pages, CAST(text_chars AS bigint) AS text_chars FROM probe")
_add("classify_uploads", f"""SELECT upload_id, CASE WHEN length > {C.MAX_BYTES} THEN 'too_big' WHEN NOT is_pdf THEN 'not_pdf'
    WHEN upload_id % 23 = 0 THEN 'over_quota' WHEN broken THEN 'broken' WHEN n_pages = 0 THEN 'empty'
    WHEN n_pages > {C.MAX_PAGES} THEN 'too_many_pages' WHEN text_chars < {C.MIN_TEXT_CHARS} THEN 'no_text' END AS reject_reason
    FROM probed""")
_add("session_quota", f"""SELECT upload_id, coalesce(n, 0) + coalesce(sum((is_pdf AND length <= {C.MAX_BYTES})::int) OVER (
      PARTITION BY u.session_id ORDER BY arrival, upload_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      >= {C.MAX_QUEUED_PER_SESSION} AS over_quota
    FROM uploads u LEFT JOIN (SELECT session_id, count(*) AS n FROM jobs WHERE status = 'queued' GROUP BY session_id) j
      ON j.session_id = u.session_id""")
_MESSAGE = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.REJECT_MESSAGES.items()) + " END"
_ADMIT = f"""SELECT CAST(upload_id AS varchar) AS id, session_id, filename,
    CASE WHEN reason IN ('too_big', 'not_pdf', 'over_quota') THEN '-' ELSE sha256 END AS sha256, opts_hash,
    CASE WHEN reason IS NOT NULL THEN 'failed' WHEN cached_id IS NOT NULL THEN 'done' ELSE 'queued' END AS status,
    CASE WHEN reason IS NULL OR reason IN ('too_many_pages', 'no_text') THEN CAST(n_pages AS int) END AS page_total,
    CAST(NULL AS double) AS started_at,
    CASE WHEN reason IS NOT NULL OR cached_id IS NOT NULL THEN CAST({NOW_LIVE} AS double) END AS finished_at,
    {_MESSAGE} AS error, CASE WHEN reason IS NULL THEN result_dir END AS result_dir,
    CASE WHEN reason IS NULL THEN n_tables END AS n_tables, CASE WHEN reason IS NULL THEN n_images END AS n_images,
    0 AS attempts, CAST({NOW_LIVE} AS double) AS created_at FROM judged"""
_add("admit", _ADMIT)
_add("stream_admit", _ADMIT)

# --- cache
_add("opts_hash", """SELECT doc_id, substring(sha256(concat('rev=7;img=', (doc_id % 2 = 0)::int, ';csv=', (doc_id % 3 = 0)::int)),
    1, 16) AS opts_hash FROM documents""")
_add("decode_opts", """SELECT id, include_images, include_csv, include_images IS NULL AS stale
    FROM mixed_jobs m LEFT JOIN option_table o ON m.opts_hash = o.opts_hash""")
_add("fail_stale", f"""SELECT id, CASE WHEN gone THEN 'failed' ELSE status END AS status,
    CASE WHEN gone THEN '{C.STALE_OPTIONS_MESSAGE}' ELSE error END AS error,
    CASE WHEN gone THEN {NOW_LIVE} ELSE finished_at END AS finished_at
    FROM (SELECT *, status = 'queued' AND opts_hash NOT IN (SELECT opts_hash FROM option_table) AS gone FROM mixed_jobs)""")
_add("cached_results", "SELECT * FROM cached")
_add("apply_cache", """SELECT upload_id, CASE WHEN cached_id IS NULL THEN 'queued' ELSE 'done' END AS status,
    result_dir, n_tables, n_images FROM uploads u LEFT JOIN cached c ON u.sha256 = c.sha256 AND u.opts_hash = c.opts_hash""")
_add("invalidated", """SELECT id, result_dir FROM mixed_jobs WHERE status = 'done'
    AND opts_hash NOT IN (SELECT opts_hash FROM option_table)""")

# --- job log
_FOLDED = f"SELECT {', '.join(JOB_COLUMNS)} FROM jobs"
_add("fold_jobs", f"""SELECT * REPLACE (CASE WHEN attempts > 0 AND finished_at IS NULL THEN 'queued' ELSE status END AS status)
    FROM ({_FOLDED})""")
_add("stream_fold", f"""SELECT * REPLACE (CASE WHEN attempts > 0 AND finished_at IS NULL THEN 'queued' ELSE status END AS status)
    FROM ({_FOLDED})""")
_add("list_jobs", f"""SELECT id, status, created_at FROM jobs WHERE session_id = 's7'
    ORDER BY created_at DESC, id DESC LIMIT {C.LIST_LIMIT}""")
_add("list_jobs_admin", f"SELECT id, session_id, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT {C.LIST_LIMIT}")
_add("owned", """SELECT concat('q', id) AS request_id, id, filename, result_dir FROM jobs
    WHERE status = 'done' AND (page_total % 2 = 0 OR session_id = 's1' OR page_total % 7 = 0)""")
_add("queued_counts", "SELECT session_id, count(*) AS n_queued FROM jobs WHERE status = 'queued' GROUP BY session_id")
_add("with_ahead", "SELECT id, ahead FROM ahead_prev")
_add("is_busy", "SELECT coalesce(bool_or(status = 'running'), false) AS busy FROM jobs")
_add("with_progress", f"SELECT id, {_PROGRESS} AS progress FROM jobs")
_add("serialize", "SELECT * EXCLUDE (session_id, result_dir, label) FROM shown_prev")
_add("session_view", f"""SELECT id, status, progress, ahead, (SELECT bool_or(status = 'running') FROM jobs) AS busy
    FROM shown_prev WHERE session_id = 's7' ORDER BY created_at DESC, id DESC LIMIT {C.LIST_LIMIT}""")
_add("json_rows", """SELECT id, concat('{"id":"', id, '","status":"', status, '","progress":', progress, ',"ahead":',
    coalesce(CAST(ahead AS varchar), 'null'), '}') AS json FROM shown_prev""")
_add("next_in_line", "SELECT id, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 10")
_add("requeue_running", """SELECT id, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status,
    CASE WHEN status <> 'running' THEN started_at END AS started_at,
    CAST(attempts + (status = 'running')::int AS int) AS attempts FROM jobs""")
_add("quarantine", f"""SELECT id, CASE WHEN bad THEN 'failed' ELSE status END AS status,
    CASE WHEN bad THEN '{C.POISON_MESSAGE}' ELSE error END AS error,
    CASE WHEN bad THEN {NOW_LIVE} ELSE finished_at END AS finished_at
    FROM (SELECT *, status = 'queued' AND attempts >= {C.MAX_ATTEMPTS} AS bad FROM jobs)""")
_add("retain", f"SELECT id, created_at FROM jobs WHERE NOT created_at < {NOW_SWEEP - C.RETENTION_SEC}")
_add("expired", f"SELECT id, created_at FROM jobs WHERE created_at < {NOW_SWEEP - C.RETENTION_SEC}")
_add("orphan_files", f"""SELECT 'upload' AS kind, sha256 AS name FROM jobs GROUP BY sha256
      HAVING max(created_at) < {NOW_SWEEP - C.RETENTION_SEC}
    UNION ALL SELECT 'result', substring(result_dir, 3) FROM jobs WHERE result_dir IS NOT NULL GROUP BY result_dir
      HAVING max(created_at) < {NOW_SWEEP - C.RETENTION_SEC}""")
_add("with_label", "SELECT id, label FROM shown_prev")
_add("session_summary", """SELECT session_id, bool_or(status = 'running') AS my_running,
    count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'done') >= 2 AS offer_bulk,
    NOT bool_or(status = 'running') AND (SELECT bool_or(status = 'running') FROM jobs) AS show_beat
    FROM jobs GROUP BY session_id""")

# --- change feed
_add("diff_snapshots", "SELECT id, status, finished_at, ahead FROM sent")
_add("feed_frame", """SELECT n_rows, busy, CASE WHEN n_rows > 0 OR NOT busy THEN 'data' ELSE 'keepalive' END AS frame
    FROM (SELECT (SELECT count(*) FROM sent) AS n_rows, (SELECT bool_or(status = 'running') FROM curr_jobs) AS busy)""")
_add("apply_delta", """SELECT id, status, finished_at FROM jobs WHERE id NOT IN (SELECT id FROM delta)
    UNION ALL SELECT id, status, finished_at FROM delta""")
_add("apply_full", f"""SELECT id, CASE WHEN status = 'failed' THEN 'removed'
      WHEN finished_at IS DISTINCT FROM new_finished THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT j.id, j.status, j.finished_at, c.finished_at AS new_finished FROM jobs j JOIN curr_jobs c ON j.id = c.id)
    UNION ALL SELECT id, 'added' FROM delta WHERE id LIKE 'new-%'""")
_add("settled", """SELECT c.id FROM curr_jobs c JOIN jobs p ON c.id = p.id WHERE c.status = 'done' AND p.status <> 'done'""")
_add("changed_fields", """SELECT a.id, concat_ws(',', CASE WHEN a.status <> b.status THEN 'class' END,
      CASE WHEN a.label <> b.label THEN 'label' END,
      CASE WHEN CASE WHEN a.status IN ('running', 'done') THEN a.progress ELSE 0 END
        <> CASE WHEN b.status IN ('running', 'done') THEN b.progress ELSE 0 END THEN 'bar' END,
      CASE WHEN CASE WHEN a.status = 'failed' THEN nullif(a.error, '') END IS DISTINCT FROM
        CASE WHEN b.status = 'failed' THEN nullif(b.error, '') END THEN 'error' END,
      CASE WHEN b.status = 'done' AND a.status <> 'done' THEN 'chip' END) AS fields
    FROM shown_prev a JOIN shown_curr b ON a.id = b.id""")
# every tick folds what has arrived until then, and sends what differs from the tick before
_add("stream_feed", """SELECT tick, id, status, finished_at, ahead FROM (
      SELECT *, lag({'s': status, 'f': finished_at, 'a': ahead}) OVER (PARTITION BY id ORDER BY tick) AS sent FROM ticks)
    WHERE sent IS NULL OR status = 'running' OR sent IS DISTINCT FROM {'s': status, 'f': finished_at, 'a': ahead}""", [
    ("arrived", f"SELECT *, {TICK.format(n='CAST(substring(id, 2) AS bigint)')} AS arrival FROM job_events"),
    ("states", f"""SELECT tick, id, arg_max(status, seq) AS status, max(created_at) AS created_at,
        arg_max(finished_at, seq) FILTER (op = 'finish') AS finished_at
      FROM (SELECT unnest(range({TICKS}))::INTEGER AS tick) t JOIN arrived ON arrival <= tick GROUP BY tick, id"""),
    ("ticks", """SELECT s.*, CASE WHEN status = 'queued' THEN (SELECT count(*) FROM states a WHERE a.tick = s.tick
        AND a.status IN ('queued', 'running') AND a.created_at < s.created_at) END AS ahead FROM states s""")])

_add("indexed_view", f"""SELECT id, status, progress, ahead, CASE WHEN status = 'queued' THEN CAST(pages AS bigint) END AS pages_ahead,
      CASE WHEN status = 'queued' THEN pages * CAST({C.SEC_PER_PAGE} AS double) END AS wait_sec
    FROM (SELECT s.*, coalesce((SELECT sum(coalesce(nullif(a.page_total, 0), 1)) FROM jobs a
      WHERE a.status IN ('queued', 'running') AND a.created_at < s.created_at), 0) AS pages FROM shown_prev s)
    WHERE session_id = 's7' ORDER BY created_at DESC, id DESC LIMIT {C.LIST_LIMIT}""")
ORACLES["bucketed_fold"] = ORACLES["fold_jobs"]
_add("changes_by_digest", f"""SELECT id, 'removed' AS change FROM jobs WHERE page_total = 5
    UNION ALL SELECT id, 'changed' FROM curr_jobs WHERE finished_at = {NOW_LIVE} AND page_total <> 5
    UNION ALL SELECT concat('new-', id), 'added' FROM curr_jobs WHERE page_total = 7""")

# --- Markdown
_ENTITIES = "html"
# the references that occur in the pages; the ampersand comes last, so that nothing is read twice
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _ENTITIES = f"regexp_replace({_ENTITIES}, '&{_name};?', '{_char}', 'g')"
_add("unescape", f"SELECT page_id, {_ENTITIES} AS html FROM pages")

for _rule in M.RULES:
    assert _rule.__name__ in MARKDOWN_RULES
    _add(_rule.__name__, M.docs_of("f0_"), M.chain([_rule])[0], recursive=_rule is M.relevel_headings)
_ALL, _NAMES = M.chain(M.RULES)
_add("clean_markdown", M.docs_of(_NAMES[-1]), _ALL, recursive=True)

_add("clean_long_markdown", M.docs_of(_NAMES[-1]), _ALL, recursive=True)

# --- extraction
_add("extract_tables", """SELECT doc_id, table_no, row_no, unnest(range(len(cells))) AS col_no, unnest(cells) AS value
    FROM table_rows""")
_add("count_artifacts", r"""SELECT doc_id, CAST(coalesce(t.n, 0) AS int) AS n_tables, CAST(coalesce(i.n, 0) AS int) AS n_images
    FROM documents d LEFT JOIN (SELECT doc_id, max(table_no) AS n FROM pipe_lines GROUP BY doc_id) t USING (doc_id)
    LEFT JOIN (SELECT doc_id, sum(len(regexp_extract_all(x, '<!-- image -->|!\[[^\]]*\]\([^)]*\)'))) AS n
      FROM raw_lines GROUP BY doc_id) i USING (doc_id)""")
_add("apply_image_mode", M.docs_of("shown"), [("shown", r"""SELECT doc_id, n, CASE
    WHEN doc_id % 2 = 0 THEN regexp_replace(x, '(!\[[^\]]*\]\()(?:[^)]*/)?images/([^)]*\))', '\1images/\2', 'g')
    ELSE regexp_replace(x, '!\[[^\]]*\]\([^)]*\)', '<!-- image -->', 'g') END AS x FROM raw_lines""")])

# --- conversion: one text per content and options
_ASKED, _ASKED_NAMES = M.chain(M.RULES, "asked_lines")
_add("convert_jobs", f"""SELECT j.id, CASE WHEN poison OR stale THEN 'failed' WHEN status <> 'queued' THEN status
      WHEN made THEN 'done' ELSE 'failed' END AS status,
    CASE WHEN poison THEN '{C.POISON_MESSAGE}' WHEN stale THEN '{C.STALE_OPTIONS_MESSAGE}' WHEN status = 'queued' AND NOT made
      THEN 'no converted text' ELSE error END AS error,
    CASE WHEN status = 'queued' THEN {NOW_LIVE} ELSE finished_at END AS finished_at,
    CASE WHEN fresh AND made THEN concat(j.sha256, '-', j.opts_hash) ELSE result_dir END AS result_dir,
    CASE WHEN fresh AND made THEN r.n_t ELSE n_tables END AS n_tables,
    CASE WHEN fresh AND made THEN r.n_i ELSE n_images END AS n_images,
    CASE WHEN r.include_csv AND r.n_t > 0 THEN CAST(r.n_t AS bigint) END AS n_csv, r.text
    FROM (SELECT *, status = 'queued' AND NOT poison AND NOT stale AS fresh FROM (
      SELECT *, status = 'queued' AND attempts >= {C.MAX_ATTEMPTS} AS poison,
        status = 'queued' AND attempts < {C.MAX_ATTEMPTS} AND opts_hash NOT IN (SELECT opts_hash FROM option_table) AS stale
      FROM mixed_jobs)) j
    LEFT JOIN (SELECT *, true AS was_made FROM made_results) r ON r.sha256 = j.sha256 AND r.opts_hash = j.opts_hash,
    LATERAL (SELECT coalesce(r.was_made, false) AS made)""", [
    ("asked", f"""SELECT DISTINCT m.sha256, m.opts_hash, include_images, include_csv, f.doc_id AS first_doc,
        f.doc_id * 2 + include_images::int AS work_id
      FROM mixed_jobs m JOIN option_table o ON o.opts_hash = m.opts_hash
      JOIN (SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1) f ON f.sha256 = m.sha256
      WHERE status = 'queued' AND attempts < {C.MAX_ATTEMPTS} AND f.doc_id % 41 <> 0"""),
    ("asked_lines", r"""SELECT work_id AS doc_id, n, CASE
        WHEN include_images THEN regexp_replace(x, '(!\[[^\]]*\]\()(?:[^)]*/)?images/([^)]*\))', '\1images/\2', 'g')
        ELSE regexp_replace(x, '!\[[^\]]*\]\([^)]*\)', '<!-- image -->', 'g') END AS x
      FROM raw_lines r JOIN (SELECT DISTINCT work_id, first_doc, include_images FROM asked) a ON a.first_doc = r.doc_id"""),
    *_ASKED,
    ("made_results", rf"""SELECT a.sha256, a.opts_hash, a.include_csv, coalesce(t.text, '') AS text,
        CAST(coalesce(p.n, 0) AS int) AS n_t, CAST(coalesce(i.n, 0) AS int) AS n_i
      FROM asked a LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS text FROM {_ASKED_NAMES[-1]} GROUP BY doc_id) t
        ON t.doc_id = a.work_id
      LEFT JOIN (SELECT doc_id, max(table_no) AS n FROM pipe_lines GROUP BY doc_id) p ON p.doc_id = a.first_doc
      LEFT JOIN (SELECT doc_id, sum(len(regexp_extract_all(x, '<!-- image -->|!\[[^\]]*\]\([^)]*\)'))) AS n
        FROM raw_lines GROUP BY doc_id) i ON i.doc_id = a.first_doc""")], recursive=True)

# --- reports
_add("calibrate", """SELECT count(*) AS n_jobs, CAST(sum(page_total) AS bigint) AS pages,
    sum(finished_at - started_at) / sum(page_total) AS sec_per_page
    FROM jobs WHERE status = 'done' AND started_at IS NOT NULL AND finished_at IS NOT NULL AND page_total > 0""")
_add("wait_estimate", f"""SELECT id, CAST(pages AS bigint) AS pages_ahead, pages * CAST({C.SEC_PER_PAGE} AS double) AS wait_sec
    FROM (SELECT j.id, coalesce((SELECT sum(coalesce(nullif(a.page_total, 0), 1)) FROM jobs a
      WHERE a.status IN ('queued', 'running') AND a.created_at < j.created_at), 0) AS pages FROM jobs j WHERE status = 'queued')""")
_RUNS = """(SELECT doc_id, sum(len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: regexp_matches(w, '[가-힣]{{13,}}')))) AS n
    FROM {0} GROUP BY doc_id)"""
_add("runon_report", f"""SELECT CAST(sum(b.n) AS bigint) AS n_before, CAST(sum(coalesce(a.n, 0)) AS bigint) AS n_after,
    count(*) FILTER (b.n <> coalesce(a.n, 0)) AS n_docs_changed
    FROM {_RUNS.format('raw_lines')} b LEFT JOIN {_RUNS.format(_NAMES[-1])} a USING (doc_id)""", _ALL, recursive=True)
_add("symbol_report", f"""SELECT symbol, count(*) AS n, count(DISTINCT doc_id) AS n_docs
    FROM (SELECT doc_id, unnest(regexp_extract_all(x, '{M.SYM}')) AS symbol FROM raw_lines) GROUP BY symbol""")


def _changes() -> str:
    before, parts = "raw_lines", []
    for rule, name in zip(M.RULES, _NAMES):
        parts.append(f"""SELECT '{rule.__name__}' AS rule, count(*) AS n_docs_changed
            FROM ({M.docs_of(before)}) a JOIN ({M.docs_of(name)}) b USING (doc_id) WHERE a.text <> b.text""")
        before = name
    return " UNION ALL ".join(parts)


_add("rule_changes", _changes(), _ALL, recursive=True)

# --- streaming
_add("stream_dedup", "SELECT DISTINCT sha256, opts_hash FROM jobs")
# what arrives in the last lot, long after its time, is older than the watermark and dropped
_ON_TIME = "(SELECT * FROM uses WHERE NOT late)"
_add("stream_retain", f"SELECT id FROM {_ON_TIME}")
# gaps and islands; an entry is final once the watermark has passed its end
_add("stream_entries", f"""SELECT sha256, opts_hash, arg_min(id, created_at) AS first_id, count(*) AS n_uses, min(created_at) AS started_at,
      max(created_at) + {C.RETENTION_SEC} AS expires_at
    FROM (SELECT *, sum((fresh IS NOT FALSE)::int) OVER (PARTITION BY sha256, opts_hash ORDER BY created_at, id) AS island FROM (
      SELECT *, created_at - lag(created_at) OVER (PARTITION BY sha256, opts_hash ORDER BY created_at, id) > {C.RETENTION_SEC} AS fresh
      FROM {_ON_TIME}))
    GROUP BY sha256, opts_hash, island
    HAVING max(created_at) + {C.RETENTION_SEC} <= (SELECT max(created_at) FROM uses) - 2 * {C.RETENTION_SEC}""")

_add("stream_expired", f"""SELECT f.*, u.created_at + 600 * e.last_seq + {C.RETENTION_SEC} AS expires_at
    FROM (SELECT * REPLACE (CASE WHEN attempts > 0 AND finished_at IS NULL THEN 'queued' ELSE status END AS status) FROM ({_FOLDED})) f
    JOIN {_ON_TIME} u ON u.id = f.id JOIN (SELECT id, max(seq) AS last_seq FROM job_events GROUP BY id) e ON e.id = f.id
    WHERE u.created_at + 600 * e.last_seq + {C.RETENTION_SEC} <= (SELECT max(u.created_at + 600 * seq) FROM uses u JOIN job_events j ON j.id = u.id)
      - 2 * {C.RETENTION_SEC}""")
