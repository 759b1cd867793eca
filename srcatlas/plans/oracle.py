"""The registered queries in SQL, to be checked against another engine.

They follow the meaning of the operators by other means: one row per line,
window functions and plain patterns instead of array functions.
"""

from __future__ import annotations

from srcatlas.functions.names import LANGUAGES
from srcatlas.operators.imports import NODE_MODULES, PYTHON_MODULES
from srcatlas.operators.todos import DOCUMENTATION_PHRASES, MARKERS
from srcatlas.plans import bridge as b
from srcatlas.plans import oracle_base as o
from srcatlas.plans.oracle_base import CODE_FILES, DEPTH, EXT, LISTABLE, NAME, PARENT, REPO_FILES, quote, trimmed

W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
LANGUAGE = o.lookup_sql("ext", LANGUAGES, "'Other'")
LINES = (
    "CAST(length(content) - length(replace(content, chr(10), ''))"
    " + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"
)

SQL: dict[str, str] = {}


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n"


# --- statistics -----------------------------------------------------------

BY_EXT = f"""
by_ext AS (
  SELECT repo, ext, count(*) AS files, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines
  FROM (SELECT repo, {EXT} AS ext, {LINES} AS lines FROM code_files) GROUP BY repo, ext)"""
REPO_BY_EXT = f"""
by_ext AS (SELECT repo, ext, count(*) AS files FROM (SELECT repo, {EXT} AS ext FROM repo_files) GROUP BY repo, ext)"""
EXTENSIONS = (
    "coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN ext <> '' THEN concat('.', ext) END))), '|'), '')"
)
LANGUAGE_STATS = f"""
language_stats AS (
  SELECT repo, {LANGUAGE} AS language, CAST(sum(files) AS BIGINT) AS files, CAST(sum(lines) AS BIGINT) AS lines,
         {EXTENSIONS} AS extensions
  FROM by_ext GROUP BY 1, 2)"""
TOTALS = f"""
{o.dirs_sql('code_files')},
totals AS (
  SELECT repo, count(*) AS files,
         (SELECT count(*) FROM up WHERE up.repo = c.repo) AS directories, CAST(sum({LINES}) AS BIGINT) AS total_lines
  FROM code_files c GROUP BY repo)"""

SQL["language_stats"] = with_(CODE_FILES, BY_EXT, LANGUAGE_STATS) + "SELECT * FROM language_stats"
SQL["language_stats_no_lines"] = with_(REPO_FILES, REPO_BY_EXT) + (
    f"SELECT repo, {LANGUAGE} AS language, CAST(sum(files) AS BIGINT) AS files, {EXTENSIONS} AS extensions"
    " FROM by_ext GROUP BY 1, 2"
)
SQL["languages_ranked"] = with_(CODE_FILES, BY_EXT, LANGUAGE_STATS) + (
    "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY files DESC, language) AS rank, language, files"
    " FROM language_stats"
)
SQL["extension_counts"] = with_(CODE_FILES, BY_EXT) + "SELECT * FROM by_ext"
SQL["line_counts"] = with_(CODE_FILES) + f"SELECT repo, path, size_bytes, {LINES} AS lines FROM code_files"
SQL["chunked_line_counts"] = SQL["line_counts"].replace("size_bytes, ", "")
SQL["codebase_totals"] = with_(CODE_FILES, TOTALS) + "SELECT * FROM totals"
SQL["stats_rollup"] = with_(CODE_FILES, BY_EXT) + (
    f"SELECT repo, language, CAST(grouping(repo, language) AS BIGINT) AS level, CAST(sum(files) AS BIGINT) AS files,"
    f" CAST(sum(lines) AS BIGINT) AS lines FROM (SELECT *, {LANGUAGE} AS language FROM by_ext) GROUP BY ROLLUP (repo, language)"
)
SHOWN = f"SELECT repo, {EXT} AS ext FROM repo_files WHERE NOT is_symlink AND NOT {o.IN_GIT}"
SQL["visible_file_stats"] = with_(REPO_FILES) + (
    f"SELECT repo, ext, count(*) AS files FROM ({SHOWN} AND NOT regexp_matches(path, '(^|/)\\.')) GROUP BY repo, ext"
)
SQL["all_file_stats"] = with_(REPO_FILES) + f"SELECT repo, ext, count(*) AS files FROM ({SHOWN}) GROUP BY repo, ext"


def rollup_sql(source: str, lines: bool) -> str:
    extra = ", CAST(coalesce(sum(n), 0) AS BIGINT) AS lines" if lines else ""
    return f"""
{o.dirs_sql(source)},
every AS (SELECT repo, path FROM up UNION ALL SELECT DISTINCT repo, '' FROM {source}),
below AS (
  SELECT e.repo, e.path, count(x.path) AS files, CAST(coalesce(sum(x.size_bytes), 0) AS BIGINT) AS bytes{extra}
  FROM every e JOIN {source} x ON x.repo = e.repo AND (e.path = '' OR starts_with(x.path, concat(e.path, '/')))
  GROUP BY e.repo, e.path)
SELECT below.repo, below.path,
       (SELECT count(*) FROM up WHERE up.repo = below.repo AND up.path <> below.path
          AND (below.path = '' OR starts_with(up.path, concat(below.path, '/')))) AS dirs,
       files, bytes{', lines' if lines else ''} FROM below"""


SQL["directory_rollup"] = with_(CODE_FILES) + "," + rollup_sql("code_files", False)
SQL["directory_rollup_lines"] = (
    with_(CODE_FILES, f"counted AS (SELECT *, {LINES} AS n FROM code_files)") + "," + rollup_sql("counted", True)
)
URL_FILES = """
bare AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS u, html FROM pages),
url_rest AS (
  SELECT string_split(u, '/')[1] AS repo,
         regexp_replace(CASE WHEN contains(u, '/') THEN regexp_replace(u, '^[^/]*/', '') ELSE '' END, '/+$', '') AS rest,
         CAST(strlen(html) AS BIGINT) AS size_bytes FROM bare),
url_files AS (SELECT repo, CASE WHEN rest = '' THEN 'index' ELSE rest END AS path, size_bytes FROM url_rest)"""
SQL["url_tree_rollup"] = with_(URL_FILES) + "," + rollup_sql("url_files", False)

LANGUAGE_ROW = (
    "concat('  ', format('{:<14}', language), format('{:>4}', files), ' files  ',"
    " format('{:>8}', format('{:,}', lines)), ' lines')"
)
SQL["stats_report"] = with_(CODE_FILES, BY_EXT, LANGUAGE_STATS, TOTALS) + f"""
SELECT repo, CAST(0 AS BIGINT) AS part, CAST(k AS BIGINT) AS seq,
       CASE k WHEN 0 THEN 'Codebase Statistics' WHEN 1 THEN '───────────────────'
              WHEN 2 THEN concat('Files:        ', files, ' total') WHEN 3 THEN concat('Directories:  ', directories) ELSE '' END AS text
FROM totals, range(5) r(k)
UNION ALL SELECT repo, 1, 0, 'By Language:' FROM totals
UNION ALL SELECT repo, 2, row_number() OVER (PARTITION BY repo ORDER BY files DESC, language), {LANGUAGE_ROW} FROM language_stats
UNION ALL SELECT repo, 3, 0, '' FROM totals
UNION ALL SELECT repo, 3, 1, concat('Total:       ', format('{{:,}}', total_lines), ' lines of code') FROM totals"""
SQL["stats_json"] = with_(CODE_FILES, BY_EXT, LANGUAGE_STATS, TOTALS) + """
SELECT t.repo, concat('{"files":', t.files, ',"directories":', directories, ',"total_lines":', total_lines, ',"by_language":[',
  (SELECT string_agg(concat('{"language":"', language, '","files":', s.files, ',"lines":', lines, ',"extensions":[',
     CASE WHEN extensions = '' THEN '' ELSE concat('"', replace(extensions, '|', '","'), '"') END, ']}'), ','
     ORDER BY s.files DESC, language) FROM language_stats s WHERE s.repo = t.repo), ']}') AS json
FROM totals t"""

# --- columns of paths, sizes and lines --------------------------------------

SQL["path_columns"] = with_(REPO_FILES) + f"""
SELECT repo, path, {NAME} AS name, {PARENT} AS parent, {DEPTH} AS depth, ext, {o.canon_sql()} AS canon_ext, {LANGUAGE} AS language
FROM (SELECT repo, path, {EXT} AS ext FROM repo_files)"""


def size_sql(v: str) -> str:
    scaled = " ".join(
        f"WHEN {v} >= {1 << p} THEN concat(format('{{:.1f}}', CAST({v} AS DOUBLE) / {1 << p}), '{u}')"
        for p, u in ((30, "G"), (20, "M"), (10, "K"))
    )
    return f"CASE {scaled} ELSE concat({v}, 'B') END"


SQL["size_labels"] = with_(CODE_FILES) + (
    f"SELECT repo, path, {size_sql('size_bytes')} AS label, format('{{:,}}', size_bytes) AS grouped,"
    f" {size_sql('(size_bytes * 997)')} AS label_m, {size_sql('(size_bytes * 1000003)')} AS label_g FROM code_files"
)
INDENT = "(CAST(length({0}) + 3 * (length({0}) - length(replace({0}, chr(9), ''))) AS BIGINT))"
LEAD = "regexp_extract(raw, '^[ \\t]*')"
SQL["source_line_table"] = with_(CODE_FILES, o.lines_sql()) + f"""
SELECT repo, path, line, content, {INDENT.format(LEAD.replace('raw', 'content'))} AS indent FROM (
  SELECT ls.repo, ls.path, line, CASE WHEN ends_with(raw, chr(13)) AND line < last THEN raw[:-2] ELSE raw END AS content
  FROM (SELECT *, max(line) OVER (PARTITION BY repo, path) AS last FROM ls) ls
  WHERE NOT (line = last AND raw = ''))"""
SQL["chunked_source_lines"] = SQL["source_line_table"]
SQL["ancestor_dirs"] = with_(REPO_FILES, o.dirs_sql("repo_files")) + "SELECT * FROM up"

# --- filters ---------------------------------------------------------------

NODES = "SELECT repo, path, depth, node_type FROM nodes"
SQL["list_all"] = with_(REPO_FILES, LISTABLE, o.dirs_sql("base"), o.nodes_sql("base", "up")) + NODES
SQL["depth_limit"] = SQL["list_all"] + " WHERE depth <= 3"
SQL["dirs_only"] = SQL["list_all"] + " WHERE node_type = 'dir'"
GLOBBED = """
kept AS (SELECT * FROM base WHERE NOT regexp_matches(path, '(^|/)(d1.|[^/]*\\.[jt]s|m[^0-2]|\\.gitignore)(/|$)'))"""
SQL["ignore_glob"] = with_(REPO_FILES, LISTABLE, GLOBBED, o.dirs_sql("kept"), o.nodes_sql("kept", "up")) + NODES
TIMED = """
timed AS (SELECT * FROM base WHERE mtime >= TIMESTAMP '2024-01-03 00:00:00' AND mtime <= TIMESTAMP '2024-01-20 12:00:00')"""
SQL["newer_older"] = with_(REPO_FILES, LISTABLE, TIMED, o.dirs_sql("base"), o.nodes_sql("timed", "up")) + NODES
SQL["size_cap"] = with_(CODE_FILES, o.lines_sql(cap=4000)) + (
    "SELECT repo, path, ext AS canon_ext, CAST(strlen(content) AS BIGINT) AS bytes FROM f"
)

# --- ignore rules and tracked paths -------------------------------------------

# (folder, line, pattern, negated, dir_only, anchored, test of the path below the folder)
RULES = [
    ("root", 2, "*.xyz", False, False, False, r"(^|/)[^/]*\.xyz$"),
    ("root", 3, "doc_*8.xyz", True, False, False, r"(^|/)doc_[^/]*8\.xyz$"),
    ("root", 4, "de/d3", False, True, True, r"^de/d3$"),
    ("root", 5, "m2", False, True, False, r"(^|/)m2$"),
    ("root", 6, "**/d5/*.py", False, False, True, r"^(.*/)?d5/[^/]*\.py$"),
    ("root", 8, "doc_1?.kt", False, False, False, r"(^|/)doc_1[^/]\.kt$"),
    ("root", 9, "trailing", False, False, False, r"(^|/)trailing$"),
    ("nested", 1, "d7/m1", False, False, True, r"^d7/m1$"),
    ("nested", 2, "*.md", False, False, False, r"(^|/)[^/]*\.md$"),
    ("nested", 3, "d4/*.md", True, False, True, r"^d4/[^/]*\.md$"),
    ("nested", 4, "d1/**/doc_*[02468].swift", False, False, True, r"^d1/(.*/)?doc_[^/]*[02468]\.swift$"),
]
RULE_ROWS = ", ".join(
    f"({quote(f)}, {n}, {quote(p)}, {str(g).lower()}, {str(d).lower()}, {str(a).lower()}, {quote(t)})"
    for f, n, p, g, d, a, t in RULES
)
RULES_CTE = f"""
rule_rows(folder, line, pattern, negated, dir_only, anchored, test) AS (VALUES {RULE_ROWS}),
rules AS (
  SELECT repo, '' AS base_dir, r.* FROM (SELECT DISTINCT source AS repo FROM documents), rule_rows r WHERE folder = 'root'
  UNION ALL SELECT repo, lang, r.* FROM (SELECT DISTINCT source AS repo, lang FROM documents), rule_rows r WHERE folder = 'nested')"""
SQL["ignore_rules"] = with_(RULES_CTE) + (
    "SELECT repo, base_dir, CAST(line AS BIGINT) AS line, pattern, negated, dir_only, anchored FROM rules"
)


def included_sql(files: str, dirs: str) -> str:
    return f"""
entries AS (SELECT repo, path, false AS is_dir FROM {files} UNION ALL SELECT repo, path, true FROM {dirs}),
hits AS (
  SELECT e.repo, e.path, e.is_dir, r.negated, length(r.base_dir) AS b, r.line
  FROM entries e JOIN rules r ON e.repo = r.repo AND (r.base_dir = '' OR starts_with(e.path, concat(r.base_dir, '/')))
  WHERE (e.is_dir OR NOT r.dir_only)
    AND regexp_matches(CASE WHEN r.base_dir = '' THEN e.path ELSE e.path[length(r.base_dir) + 2:] END, r.test)),
ignored AS (
  SELECT repo, path, is_dir FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, path, is_dir ORDER BY b DESC, line DESC) AS k FROM hits)
  WHERE k = 1 AND NOT negated),
included AS (
  SELECT * FROM entries e WHERE NOT EXISTS (
    SELECT 1 FROM ignored i WHERE i.repo = e.repo
      AND (i.path = e.path AND i.is_dir = e.is_dir OR i.is_dir AND starts_with(e.path, concat(i.path, '/')))))"""


SQL["gitignore_included"] = (
    with_(REPO_FILES, RULES_CTE, o.dirs_sql("repo_files"), included_sql("repo_files", "up")) + "SELECT * FROM included"
)
SQL["gitignore_listing"] = (
    with_(
        REPO_FILES, RULES_CTE, LISTABLE, o.dirs_sql("base"), included_sql("base", "up"),
        "passed AS (SELECT base.* FROM base SEMI JOIN included i ON base.repo = i.repo AND base.path = i.path AND NOT i.is_dir)",
        o.dirs_sql("passed", "above"),
        "shown_dirs AS (SELECT repo, path FROM above UNION SELECT repo, path FROM included WHERE is_dir)",
        o.nodes_sql("passed", "shown_dirs"),
    )
    + NODES
)
SQL["show_all_listing"] = SQL["list_all"]
SQL["included_dirs_only"] = SQL["gitignore_listing"] + " WHERE node_type = 'dir'"
TRACKED = """
tracked AS (
  SELECT repo, path FROM repo_files JOIN labels USING (doc_id) WHERE quality = 1
  UNION SELECT repo, path FROM repo_files JOIN labels USING (doc_id) WHERE NOT (toxic = 1) AND NOT (doc_id % 2 = 0))"""
SQL["tracked_union"] = with_(REPO_FILES, TRACKED) + "SELECT * FROM tracked"
SQL["tracked_listing"] = (
    with_(
        REPO_FILES, TRACKED, LISTABLE, o.dirs_sql("base"), o.dirs_sql("tracked", "above"),
        "passed AS (SELECT * FROM base SEMI JOIN tracked t ON base.repo = t.repo AND base.path = t.path)",
        "shown_dirs AS (SELECT * FROM up SEMI JOIN above a ON up.repo = a.repo AND up.path = a.path)",
        o.nodes_sql("passed", "shown_dirs"),
    )
    + NODES
)

# --- task markers ------------------------------------------------------------

TODO = quote(r"(?i)^\s*(?://+|/?\*+|#+|--+|;+)\s*!?\s*(TODO|FIXME|HACK|XXX|BUG|NOTE)\s*:\s*(.+)")
TODOS = f"""
marked AS (
  SELECT repo, path, line, upper(regexp_extract(raw, {TODO}, 1)) AS marker,
         {trimmed(f"string_split(string_split({trimmed(f'regexp_extract(raw, {TODO}, 2)')}, '*/')[1], '-->')[1]")} AS text
  FROM ls WHERE regexp_matches(raw, {TODO})),
todos AS (
  SELECT * FROM marked WHERE text <> '' AND NOT starts_with(text, '`') AND NOT contains(lower(text), 'marker')
  {' '.join(f"AND NOT starts_with(text, {quote(p)})" for p in DOCUMENTATION_PHRASES)})"""
FROM_CODE = (CODE_FILES, o.lines_sql())
SQL["todos"] = with_(*FROM_CODE, TODOS) + "SELECT * FROM todos"
SQL["chunked_todos"] = SQL["todos"]
SQL["todos_by_marker"] = with_(*FROM_CODE, TODOS) + (
    f"SELECT repo, {LANGUAGE} AS language, "
    + ", ".join(f'count(*) FILTER (marker = {quote(m)}) AS "{m}"' for m in MARKERS)
    + f" FROM (SELECT *, {EXT} AS ext FROM todos) GROUP BY 1, 2"
)
SQL["todos_only_files"] = (
    with_(
        *FROM_CODE, TODOS, o.dirs_sql("code_files"),
        "kept AS (SELECT c.* FROM code_files c SEMI JOIN todos t ON c.repo = t.repo AND c.path = t.path)",
        o.nodes_sql("kept", "up", "code_files"),
    )
    + NODES
)
SQL["top_todo_files"] = with_(*FROM_CODE, TODOS) + (
    "SELECT repo, path, count(*) AS todos FROM todos GROUP BY repo, path ORDER BY todos DESC, repo, path LIMIT 25"
)
SQL["top_size_files"] = with_(CODE_FILES) + (
    "SELECT repo, path, size_bytes FROM code_files ORDER BY size_bytes DESC, repo, path LIMIT 25"
)

# --- signatures ------------------------------------------------------------

# (pattern, group of the symbol, whether a trailing = is cut), first match wins.
SIGNATURES = {
    "rs": [(rf"^pub\s+(async\s+)?fn\s+({W}+)[^{{;]*", 2, False)]
    + [(rf"^pub\s+{k}\s+({W}+)[^{{;]*", 1, False) for k in ("struct", "enum", "trait")]
    + [(rf"^pub\s+type\s+({W}+)[^;]+", 1, False), (rf"^pub\s+const\s+({W}+):\s*[^=]+", 1, False)],
    "ts": [
        (rf"^export\s+(async\s+)?function\s+({W}+)[^{{]*", 2, False),
        (rf"^export\s+interface\s+({W}+)[^{{]*", 1, False),
        (rf"^export\s+type\s+({W}+)[^=]*=\s*[^;{{]+", 1, False),
        (rf"^export\s+(abstract\s+)?class\s+({W}+)[^{{]*", 2, False),
        (rf"^export\s+const\s+({W}+):\s*[^=]+", 1, False),
        (rf"^export\s+(const\s+)?enum\s+({W}+)[^{{]*", 2, False),
    ],
    "js": [
        (rf"^export\s+(async\s+)?function\s+({W}+)\s*\([^)]*\)", 2, False),
        (rf"^export\s+class\s+({W}+)[^{{]*", 1, False),
        (rf"^export\s+const\s+({W}+)\s*=", 1, True),
    ],
    "py": [
        (rf"^async\s+def\s+({W}+)\s*\([^)]*\)\s*->\s*[^:]+", 1, False),
        (rf"^async\s+def\s+({W}+)\s*\([^)]*\)", 1, False),
        (rf"^def\s+({W}+)\s*\([^)]*\)\s*->\s*[^:]+", 1, False),
        (rf"^def\s+({W}+)\s*\([^)]*\)", 1, False),
        (rf"^class\s+({W}+)[^:]*", 1, False),
    ],
    "go": [
        (rf"^func\s+\([^)]+\)\s*([A-Z]{W}*)\s*\([^)]*\)[^{{]*", 1, False),
        (rf"^func\s+([A-Z]{W}*)\s*\([^)]*\)[^{{]*", 1, False),
        (rf"^type\s+([A-Z]{W}*)\s+{W}+", 1, False),
        (rf"^const\s+([A-Z]{W}*)\s*[^=]*=", 1, True),
        (rf"^var\s+([A-Z]{W}*)\s+{W}+", 1, False),
    ],
}


def _signature_cases(what: str) -> str:
    cases = []
    for ext, rules in SIGNATURES.items():
        for pattern, group, cut in rules:
            p = quote(pattern)
            full = f"regexp_extract(t, {p}, 0)"
            clean = trimmed(f"rtrim(rtrim({trimmed(full)}, '{{'), ';')")
            value = {
                "signature": trimmed(f"rtrim({full}, '=')") if cut else clean,
                "symbol": f"regexp_extract(t, {p}, {group})",
            }[what]
            cases.append(f"WHEN ext = '{ext}' AND regexp_matches(t, {p}) THEN {value}")
    return "CASE " + "\n".join(cases) + " END"


SIGS = f"""
found AS (
  SELECT repo, path, line, {_signature_cases('signature')} AS signature, {_signature_cases('symbol')} AS symbol,
         {INDENT.format(LEAD)} AS indent
  FROM ls WHERE NOT (ext = 'py' AND (starts_with(t, 'def _') OR starts_with(t, 'async def _') OR starts_with(t, 'class _')))),
sigs AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS seq, line, signature, symbol, indent
  FROM found WHERE signature IS NOT NULL)"""
LANGS = {"rust": ".rs", "ts": ".ts", "js": ".js", "python": ".py", "go": ".go"}
for _name, _ext in LANGS.items():
    SQL[f"signatures_{_name}"] = with_(o.language_files_sql(_ext), o.lines_sql(), SIGS) + "SELECT * FROM sigs"
SQL["symbols_by_language"] = with_(*FROM_CODE, SIGS) + (
    f"SELECT {LANGUAGE} AS language, count(*) AS symbols, count(DISTINCT concat(repo, ':', path)) AS files"
    f" FROM (SELECT *, {EXT} AS ext FROM sigs) GROUP BY 1"
)
SQL["symbol_spans"] = with_(*FROM_CODE, SIGS) + (
    "SELECT repo, path, seq, symbol, CAST(instr(signature, symbol) AS BIGINT) AS start FROM sigs"
)

# --- imports ---------------------------------------------------------------


def _in(value: str, items: list[str]) -> str:
    return f"{value} IN ({', '.join(quote(i) for i in items)})"


Q = "['\"]"
ES_IMPORT = quote(rf"import\s+(?:[^'\"]+\s+from\s+)?{Q}([^'\"]+){Q}")
REQUIRE = quote(rf"require\s*\(\s*{Q}([^'\"]+){Q}\s*\)")
EXPORT_FROM = quote(rf"export\s+(?:\*|\{{[^}}]*\}})\s+from\s+{Q}([^'\"]+){Q}")
USE = quote(r"^use\s+([^;]+);")
PY_IMPORT = quote(rf"^import\s+({W}+)")
PY_FROM = quote(rf"^from\s+(\.*)({W}+)?")
GO_SINGLE = quote(r'^import\s+"([^"]+)"')
GO_LINE = quote(rf'^\s*(?:{W}+\s+)?"([^"]+)"')
IMPORTS = f"""
js_modules AS (
  SELECT repo, path, line, 1 AS k, regexp_extract(t, {ES_IMPORT}, 1) AS m FROM ls WHERE ext IN ('js', 'ts')
  UNION ALL SELECT repo, path, line, 2, regexp_extract(t, {REQUIRE}, 1) FROM ls WHERE ext = 'js'
  UNION ALL SELECT repo, path, line, 3, regexp_extract(t, {EXPORT_FROM}, 1) FROM ls WHERE ext IN ('js', 'ts')),
rust_paths AS (
  SELECT repo, path, line, p, CASE WHEN contains(p, '{{') THEN {trimmed("string_split(p, '::')[1]")} ELSE string_split(p, '::')[1] END AS root
  FROM (SELECT repo, path, line, {trimmed(f'regexp_extract(t, {USE}, 1)')} AS p FROM ls WHERE ext = 'rs' AND regexp_matches(t, {USE}))),
go_marks AS (
  SELECT *, CASE WHEN starts_with(t, 'import (') THEN 1 WHEN t = ')' THEN 0 END AS mark FROM ls WHERE ext = 'go'),
go_state AS (
  SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (
    PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM go_marks),
go_modules AS (
  SELECT repo, path, line, 1 AS k, regexp_extract(t, {GO_SINGLE}, 1) AS m FROM go_state
  UNION ALL SELECT repo, path, line, 2, regexp_extract(t, {GO_LINE}, 1) FROM go_state WHERE inside AND mark IS NULL),
stated AS (
  SELECT repo, path, 'js' AS lang, line, k,
         CASE WHEN starts_with(m, './') OR starts_with(m, '../') THEN 'internal'
              WHEN starts_with(m, 'node:') OR {_in('m', NODE_MODULES)} THEN 'std' ELSE 'external' END AS category,
         CASE WHEN starts_with(m, './') OR starts_with(m, '../') OR {_in('m', NODE_MODULES)} THEN m
              WHEN starts_with(m, 'node:') THEN m[6:]
              WHEN starts_with(m, '@') THEN array_to_string(string_split(m, '/')[1:2], '/')
              ELSE string_split(m, '/')[1] END AS module
  FROM js_modules WHERE m <> ''
  UNION ALL SELECT repo, path, 'rs', line, 1,
         CASE WHEN root IN ('std', 'core', 'alloc') THEN 'std' WHEN root IN ('crate', 'self', 'super') THEN 'internal' ELSE 'external' END,
         CASE WHEN root IN ('std', 'core', 'alloc', 'crate', 'self', 'super')
              THEN regexp_replace(p, '^(std|core|alloc|crate|self)::', '') ELSE root END
  FROM rust_paths
  UNION ALL SELECT repo, path, 'py', line, 1, CASE WHEN {_in('m', PYTHON_MODULES)} THEN 'std' ELSE 'external' END, m
  FROM (SELECT repo, path, line, regexp_extract(t, {PY_IMPORT}, 1) AS m FROM ls WHERE ext = 'py') WHERE m <> ''
  UNION ALL SELECT repo, path, 'py', line, 2,
         CASE WHEN dots <> '' THEN 'internal' WHEN {_in('m', PYTHON_MODULES)} THEN 'std' ELSE 'external' END, concat(dots, m)
  FROM (SELECT repo, path, line, regexp_extract(t, {PY_FROM}, 1) AS dots, regexp_extract(t, {PY_FROM}, 2) AS m
        FROM ls WHERE ext = 'py') WHERE dots <> '' OR m <> ''
  UNION ALL SELECT repo, path, 'go', line, k,
         CASE WHEN NOT contains(m, '.') AND NOT contains(m, '/') THEN 'std'
              WHEN contains(m, '/internal/') OR starts_with(m, 'internal/') THEN 'internal' ELSE 'external' END,
         CASE WHEN NOT contains(m, '.') AND NOT contains(m, '/') OR contains(m, '/internal/') OR starts_with(m, 'internal/') THEN m
              ELSE array_to_string(string_split(m, '/')[1:3], '/') END
  FROM go_modules WHERE m <> ''),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY repo, path, category, module ORDER BY line, k) AS again FROM stated),
imports AS (
  SELECT repo, path, category, row_number() OVER (PARTITION BY repo, path, category ORDER BY line, k) AS seq, module
  FROM counted
  WHERE again = 1 OR NOT (category = 'external' AND lang IN ('js', 'py', 'go') OR category = 'std' AND lang IN ('py', 'go')))"""
WIDE = """
wide AS (
  SELECT repo, path, coalesce(external, '') AS external, coalesce(std, '') AS std, coalesce(internal, '') AS internal, total,
         concat_ws(', ', replace(external, chr(10), ', '), CASE WHEN std IS NOT NULL THEN concat('std::{', replace(std, chr(10), ', '), '}') END,
           CASE WHEN internal IS NOT NULL THEN concat('crate::{', replace(internal, chr(10), ', '), '}') END) AS summary
  FROM (SELECT repo, path, count(*) AS total,
               string_agg(module, chr(10) ORDER BY seq) FILTER (category = 'external') AS external,
               string_agg(module, chr(10) ORDER BY seq) FILTER (category = 'std') AS std,
               string_agg(module, chr(10) ORDER BY seq) FILTER (category = 'internal') AS internal
        FROM imports GROUP BY repo, path))"""
for _name, _ext in LANGS.items():
    SQL[f"imports_{_name}"] = with_(o.language_files_sql(_ext), o.lines_sql(), IMPORTS) + "SELECT * FROM imports"
SQL["import_usage"] = with_(*FROM_CODE, IMPORTS) + (
    "SELECT category, module, count(*) AS imports, count(DISTINCT concat(repo, ':', path)) AS files"
    " FROM imports GROUP BY category, module"
)
SQL["file_imports_wide"] = with_(*FROM_CODE, IMPORTS, WIDE) + "SELECT * FROM wide"
SQL["chunked_imports"] = SQL["file_imports_wide"]

# --- comments --------------------------------------------------------------


def _block_sql(name: str, exts: str, opening: str, drop: str, lead: str = "") -> str:
    """CTE (repo, path, comment) of block comments at the start of the text."""
    body = quote(rf"(?s)^{lead}\s*{opening}(.*?)\*/")
    star = trimmed("ltrim(" + trimmed("s") + ", '*')")
    return f"""
{name} AS (
  SELECT repo, path, array_to_string(kept, chr(10)) AS comment FROM (
    SELECT repo, path, list_filter(list_transform(string_split(regexp_extract(content, {body}, 1), chr(10)),
             lambda s: {star}), lambda s: s <> ''{drop}) AS kept FROM f WHERE ext IN ({exts}))
  WHERE len(kept) > 0)"""


def _run_sql(name: str, source: str, breaks: str, takes: str, value: str) -> str:
    """CTE of the taken lines before the first breaking line."""
    return f"""
{name} AS (
  SELECT repo, path, string_agg(v, chr(10) ORDER BY line) AS comment FROM (
    SELECT repo, path, line, {takes} AS taken, {value} AS v,
           count(*) FILTER ({breaks}) OVER (PARTITION BY repo, path ORDER BY line) AS broken FROM {source})
  WHERE broken = 0 AND taken GROUP BY repo, path HAVING bool_or(v <> ''))"""


SLASHES = "starts_with(t, '//')"
MAGIC = ["#!", "# frozen_string_literal", "# encoding:", "# coding:"]
IS_MAGIC = (
    "(starts_with(t, '#!') OR ext = 'rb' AND ("
    + " OR ".join(f"starts_with(t, {quote(m)})" for m in MAGIC[1:])
    + "))"
)
DOCSTRING = quote(r"""(?s)^(?:[ \t\r]*(?:#[^\n]*)?\n)*\s*(?:"{3}(.*?)"{3}|'{3}(.*?)'{3})""")
PHP_HEAD = r"\s*(?:<\?(?:php)?)?"
_tail = trimmed("t[{0}:]")
COMMENTS = ",".join(
    [
        _block_sql("doc_blocks", "'js', 'ts'", r"/\*\*", " AND s <> '/'"),
        _block_sql("java_blocks", "'java', 'kt', 'swift'", r"/\*\*", " AND NOT starts_with(s, '@')"),
        _block_sql("php_blocks", "'php'", r"/\*\*", " AND NOT starts_with(s, '@')", PHP_HEAD),
        _block_sql("c_blocks", "'rs', 'c', 'cpp', 'cs'", r"/\*", ""),
        "\nslashed AS (SELECT * FROM ls WHERE ext IN ('js', 'ts', 'c', 'cpp', 'java', 'kt', 'swift'))",
        _run_sql("slash_runs", "slashed", f"t <> '' AND NOT {SLASHES}", SLASHES, _tail.format(3)),
        f"""
php_ls AS (
  SELECT repo, path, line, {trimmed('raw')} AS t FROM (
    SELECT repo, path, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line FROM (
      SELECT repo, path, string_split(regexp_replace(content, {quote('^' + PHP_HEAD)}, ''), chr(10)) AS parts FROM f WHERE ext = 'php')))""",
        _run_sql(
            "php_runs", "php_ls", f"t <> '' AND NOT {SLASHES} AND NOT (starts_with(t, '#') AND NOT starts_with(t, '#['))",
            f"({SLASHES} OR starts_with(t, '#') AND NOT starts_with(t, '#['))",
            f"CASE WHEN {SLASHES} THEN {_tail.format(3)} ELSE {_tail.format(2)} END",
        ),
        "\ncs_ls AS (SELECT * FROM ls WHERE ext = 'cs')",
        _run_sql(
            "cs_runs", "cs_ls", f"t <> '' AND NOT {SLASHES} AND NOT starts_with(t, 'using ') AND NOT starts_with(t, '[')",
            f"{SLASHES} AND NOT (starts_with(t, '///') AND (starts_with({_tail.format(4)}, '<') OR ends_with({_tail.format(4)}, '>')))",
            f"CASE WHEN starts_with(t, '///') THEN {_tail.format(4)} ELSE {_tail.format(3)} END",
        ),
        "\nrs_ls AS (SELECT * FROM ls WHERE ext = 'rs')",
        _run_sql("rs_modules", "rs_ls", f"t <> '' AND NOT {SLASHES}", "starts_with(t, '//!')", _tail.format(4)),
        f"""
rs_first AS (
  SELECT *, min(line) FILTER (starts_with(t, '///')) OVER (PARTITION BY repo, path) AS first,
         count(*) FILTER (t <> '' AND NOT {SLASHES} AND NOT starts_with(t, '#[') AND NOT starts_with(t, '#!['))
           OVER (PARTITION BY repo, path ORDER BY line) AS code_before FROM rs_ls),
rs_after AS (
  SELECT * FROM rs_first r WHERE line >= first
    AND EXISTS (SELECT 1 FROM rs_first q WHERE q.repo = r.repo AND q.path = r.path AND q.line = r.first AND q.code_before = 0))""",
        _run_sql("rs_items", "rs_after", "NOT starts_with(t, '///')", "starts_with(t, '///')", _tail.format(4)),
        f"""
docstrings AS (
  SELECT repo, path, array_to_string(list_transform(string_split(doc, chr(10)), lambda s: {trimmed('s')}), chr(10)) AS comment
  FROM (SELECT repo, path, {trimmed(f'concat(regexp_extract(content, {DOCSTRING}, 1), regexp_extract(content, {DOCSTRING}, 2))')} AS doc
        FROM f WHERE ext = 'py') WHERE doc <> ''),
hash_ls AS (SELECT *, {IS_MAGIC} AS magic FROM ls WHERE ext IN ('rb', 'sh')),
hash_first AS (
  SELECT *, min(line) FILTER (starts_with(t, '#') AND NOT magic) OVER (PARTITION BY repo, path) AS first,
         min(line) FILTER (t <> '' AND NOT starts_with(t, '#')) OVER (PARTITION BY repo, path) AS code FROM hash_ls),
hash_after AS (SELECT * FROM hash_first WHERE line >= first AND (code IS NULL OR first < code))""",
        _run_sql("hash_runs", "hash_after", "NOT starts_with(t, '#')", "starts_with(t, '#') AND NOT magic", _tail.format(2)),
        f"""
go_ls AS (
  SELECT *, min(line) FILTER (starts_with(t, '/*') OR starts_with(t, 'package ')) OVER (PARTITION BY repo, path) AS stop
  FROM ls WHERE ext = 'go'),
go_above AS (SELECT * FROM go_ls WHERE stop IS NULL OR line < stop),
go_code AS (SELECT *, max(line) FILTER (t <> '' AND NOT {SLASHES}) OVER (PARTITION BY repo, path) AS code FROM go_above),
go_runs AS (
  SELECT repo, path, string_agg({_tail.format(3)}, chr(10) ORDER BY line) AS comment FROM go_code
  WHERE {SLASHES} AND (code IS NULL OR line > code) GROUP BY repo, path HAVING bool_or({_tail.format(3)} <> '')),
go_stops AS (SELECT repo, path FROM go_ls WHERE line = stop AND starts_with(t, '/*'))""",
        _block_sql("go_any_blocks", "'go'", r".*?/\*", "").replace(r"\s*.*?", ".*?"),
        """
go_blocks AS (SELECT g.* FROM go_any_blocks g SEMI JOIN go_stops s ON g.repo = s.repo AND g.path = s.path),
ranked_comments AS (
  SELECT 1 AS k, * FROM doc_blocks UNION ALL SELECT 1, * FROM java_blocks UNION ALL SELECT 1, * FROM php_blocks
  UNION ALL SELECT CASE WHEN ext IN ('c', 'cpp') THEN 1 ELSE 3 END, c_blocks.* FROM c_blocks JOIN f USING (repo, path)
  UNION ALL SELECT 2, * FROM slash_runs UNION ALL SELECT 2, * FROM php_runs UNION ALL SELECT 1, * FROM cs_runs
  UNION ALL SELECT 1, * FROM rs_modules UNION ALL SELECT 2, * FROM rs_items UNION ALL SELECT 1, * FROM docstrings
  UNION ALL SELECT 1, * FROM hash_runs UNION ALL SELECT 1, * FROM go_blocks UNION ALL SELECT 2, * FROM go_runs),
comments AS (SELECT repo, path, arg_min(comment, k) AS comment FROM ranked_comments GROUP BY repo, path)""",
    ]
)
for _name, _exts in {
    "rust": (".rs",), "python": (".py",), "js": (".js", ".ts"), "go": (".go",), "c": (".c", ".cpp"),
    "ruby": (".rb",), "shell": (".sh",), "javadoc": (".java", ".kt", ".swift"), "php": (".php",), "csharp": (".cs",),
}.items():
    SQL[f"comments_{_name}"] = with_(o.language_files_sql(*_exts), o.lines_sql(), COMMENTS) + "SELECT * FROM comments"
SQL["comment_first_line"] = with_(*FROM_CODE, COMMENTS) + (
    "SELECT repo, path, string_split(comment, chr(10))[1] AS first_line FROM comments"
)


def wrap_sql(text: str, width: str) -> str:
    """List of wrapped lines; each step takes up to a word end, or a full width of a longer word."""
    words = f"regexp_replace({trimmed(text)}, '\\s+', ' ', 'g')"
    step = f"concat('(?s)(?:.{{1,', {width}, '}}(?: |$)|[^ ]{{', {width}, '}})')"
    return (
        f"CASE WHEN {trimmed(text)} = '' THEN [''] ELSE"
        f" list_transform(regexp_extract_all({words}, {step}), lambda p: rtrim(p)) END"
    )


SQL["wrap_comments"] = with_(*FROM_CODE, COMMENTS) + f"""
SELECT repo, path, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS seq, unnest(w) AS text
FROM (SELECT repo, path, {wrap_sql("replace(comment, chr(10), ' ')", "40")} AS w FROM comments)"""


# --- metadata and layout ----------------------------------------------------

PARTS = with_(*FROM_CODE, COMMENTS, SIGS, IMPORTS, WIDE, TODOS)


def metadata_sql(groups: dict[str, int]) -> str:
    """CTE ``meta`` (repo, path, seq, section, style, content, symbol, indent).

    ``groups`` gives the odd rank of every wanted section; the even rank before
    a section holds its separator.
    """
    parts = {
        "comment": """SELECT repo, path, {g} AS g, generate_subscripts(p, 1) AS k, 'comment' AS section, 'comment' AS style,
            unnest(p) AS content, CAST(NULL AS VARCHAR) AS symbol, CAST(0 AS BIGINT) AS indent
          FROM (SELECT repo, path, string_split(regexp_replace(comment, '\n$', ''), chr(10)) AS p FROM comments)""",
        "type": "SELECT repo, path, {g}, seq, 'type', 'type_signature', signature, symbol, CAST(indent AS BIGINT) FROM sigs",
        "import": """SELECT repo, path, {g}, 1, 'import', 'import', concat('imports: ', summary), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM wide
          WHERE summary <> ''""",
        "todo": """SELECT repo, path, {g}, line, 'todo', 'todo', concat(marker, ': ', text, ' (line ', line, ')'), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT)
          FROM todos""",
    }
    wanted = " UNION ALL ".join(parts[s].format(g=groups[s]) for s in parts if s in groups)
    return f"""
sections(repo, path, g, k, section, style, content, symbol, indent) AS ({wanted}),
separated AS (
  SELECT * FROM sections
  UNION ALL SELECT repo, path, g - 1, 0, 'separator', 'comment', '', NULL, 0 FROM (
    SELECT repo, path, g, row_number() OVER (PARTITION BY repo, path ORDER BY g) AS n FROM (SELECT DISTINCT repo, path, g FROM sections))
  WHERE n > 1),
meta AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY g, k) AS seq, section, style, content, symbol, indent
  FROM separated)"""


ALL_GROUPS = {"comment": 1, "type": 3, "import": 5, "todo": 7}
META = metadata_sql(ALL_GROUPS)
SQL["metadata_lines"] = PARTS + "," + META + " SELECT * FROM meta"
SQL["metadata_lines_types_first"] = PARTS + "," + metadata_sql({"type": 1, "comment": 3}) + (
    " SELECT repo, path, seq, section, content, indent FROM meta"
)
FLAGS = """
flags AS (
  SELECT f.repo, f.path, count(m.seq) FILTER (section = 'comment') AS c, count(m.seq) FILTER (section = 'type') AS t,
         count(m.seq) FILTER (section = 'import') AS i, count(m.seq) FILTER (section = 'todo') AS d,
         arg_min(m.section, m.seq) FILTER (section IN ('comment', 'type')) AS lead_section,
         arg_min(m.content, m.seq) FILTER (section IN ('comment', 'type')) AS lead,
         arg_min(m.content, m.seq) FILTER (section = 'todo') AS todo, arg_min(m.content, m.seq) FILTER (section = 'import') AS import
  FROM f LEFT JOIN meta m ON m.repo = f.repo AND m.path = f.path GROUP BY f.repo, f.path),
shown AS (
  SELECT *, c + t + i + d AS total, c > 0 AND t > 0 AS both_leads,
         CASE WHEN c > 0 THEN c = 1 WHEN t > 0 THEN t = 1 ELSE d = 1 END AS first_is_single,
         CASE WHEN c + t > 0 THEN lead_section WHEN d > 0 THEN 'todo' WHEN i > 0 THEN 'import' END AS first_section,
         coalesce(lead, todo, import) AS first_line FROM flags)"""
SQL["metadata_flags"] = PARTS + "," + META + "," + FLAGS + """
SELECT repo, path, total, total = 0 AS is_empty, c > 0 AND c = total AS only_comment, t > 0 AND t = total AS only_type,
       i > 0 AND i = total AS only_import, d > 0 AND d = total AS only_todo, both_leads AS has_both, d > 0 AS has_todos,
       i > 0 AS has_imports, first_is_single, first_section, first_line FROM shown"""


def block_sql(lines: str, owners: str, width: str = "") -> str:
    """CTE ``blocks`` (repo, path, seq, text, indent) of the rows below a name; NULL text is a blank row.

    ``lines`` names a relation (repo, path, idx, content, indent, width), ``owners``
    one whose paths get a frame.
    """
    pieces = wrap_sql("content", "width") if width else "[content]"
    wrapped = f"CASE WHEN width IS NULL THEN [content] ELSE {pieces} END" if width else pieces
    return f"""
trimmed_lines AS (SELECT repo, path, idx, {trimmed('content')} AS content, CAST(indent AS BIGINT) AS indent, width FROM {lines}),
around AS (
  SELECT *, lag(indent) OVER w AS before, lag(content) OVER w AS before_content,
         CASE WHEN content <> '' THEN lead(CASE WHEN content <> '' THEN indent END IGNORE NULLS) OVER w END AS following
  FROM trimmed_lines WINDOW w AS (PARTITION BY repo, path ORDER BY idx)),
pieces AS (
  SELECT repo, path, idx, indent, CASE WHEN content = '' THEN [NULL] ELSE
    list_concat(CASE WHEN indent = 0 AND before_content <> '' AND (before > 0 OR coalesce(following > indent, false))
                THEN [CAST(NULL AS VARCHAR)] ELSE [] END, {wrapped}) END AS texts
  FROM around),
framed AS (
  SELECT repo, path, idx, generate_subscripts(texts, 1) AS k, unnest(texts) AS text, indent FROM pieces
  UNION ALL SELECT DISTINCT repo, path, -1, 0, NULL, 0 FROM {owners}
  UNION ALL SELECT DISTINCT repo, path, 1000000000, 0, NULL, 0 FROM {owners}),
blocks AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY idx, k) - 1 AS seq, text,
         CASE WHEN text IS NULL THEN 0 ELSE indent END AS indent FROM framed)"""


SQL["group_separators"] = (
    with_(
        *FROM_CODE, SIGS,
        "typed AS (SELECT repo, path, seq AS idx, signature AS content, indent, CAST(NULL AS BIGINT) AS width FROM sigs)",
        block_sql("typed", "sigs"),
    )
    + "SELECT repo, path, seq, coalesce(text, '') AS text, indent FROM blocks"
)


def layout_sql(width: str) -> str:
    """CTEs ``laid`` (…, layout, inline) and ``blocks`` for whole-block display."""
    return f"""
laid AS (
  SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN total = 1 THEN 'inline' WHEN first_is_single THEN 'inline_block' ELSE 'block' END AS layout
  FROM shown),
below AS (
  SELECT m.repo, m.path, m.seq AS idx, m.content, m.indent, {width} AS width
  FROM meta m JOIN laid l ON l.repo = m.repo AND l.path = m.path
  WHERE layout = 'block' OR layout = 'inline_block' AND CASE
    WHEN c + t = 0 AND i > 0 AND d > 0 THEN section = 'import' ELSE m.seq > CASE WHEN both_leads THEN 2 ELSE 1 END END),
owners AS (SELECT repo, path FROM laid WHERE layout IN ('block', 'inline_block')),
{block_sql('below', 'owners', 'width').strip()}"""


SQL["layouts"] = PARTS + "," + META + "," + FLAGS + "," + layout_sql("CAST(60 AS BIGINT)") + """
SELECT repo, path, layout, CASE WHEN layout IN ('inline', 'inline_block') THEN first_line END AS inline,
       (SELECT count(*) FROM blocks b WHERE b.repo = l.repo AND b.path = l.path) AS block_rows FROM laid l"""

# --- trees and reports ------------------------------------------------------

TREE = f"""
{o.dirs_sql('code_files')},
{o.nodes_sql('code_files', 'up', 'code_files').strip()},
tree AS (
  SELECT *, CASE WHEN path = '' THEN '.' ELSE {NAME} END AS name, CASE WHEN path = '' THEN NULL ELSE {PARENT} END AS parent,
         string_split(path, '/') AS parts FROM nodes),
flagged AS (
  SELECT *, depth > 0 AND name = max(name) OVER (PARTITION BY repo, parent) AS is_last,
         depth > 0 AND name = min(name) OVER (PARTITION BY repo, parent) AS is_first FROM tree),
chains AS (
  SELECT repo, path, n, array_to_string(parts[1:n], '/') AS above
  FROM (SELECT repo, path, parts, unnest(range(1, depth)) AS n FROM flagged WHERE depth > 1)),
prefixes AS (
  SELECT c.repo, c.path, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY n) AS prefix
  FROM chains c JOIN flagged a ON a.repo = c.repo AND a.path = c.above AND a.node_type = 'dir' GROUP BY c.repo, c.path),
drawn AS (
  SELECT x.*, coalesce(p.prefix, '') AS prefix,
         CASE WHEN depth = 0 THEN '' WHEN is_last THEN '└── ' ELSE '├── ' END AS connector
  FROM flagged x LEFT JOIN prefixes p ON p.repo = x.repo AND p.path = x.path)"""
TREE_ONLY = with_(CODE_FILES, TREE)
SQL["tree_last_flag"] = TREE_ONLY + "SELECT repo, path, is_last FROM flagged"
SQL["tree_prefix"] = TREE_ONLY + "SELECT repo, path, prefix, connector FROM drawn"
SQL["tree_preorder"] = TREE_ONLY + (
    "SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN path = '' THEN [] ELSE parts END) AS preorder"
    " FROM tree"
)
SQL["sibling_rank"] = TREE_ONLY + (
    "SELECT repo, path, row_number() OVER (PARTITION BY repo, parent ORDER BY name) AS sibling_rank FROM tree WHERE depth > 0"
)
COUNTS = (
    "SELECT repo, count(*) FILTER (node_type = 'dir' AND depth > 0) AS directories,"
    " count(*) FILTER (node_type = 'file') AS files FROM nodes GROUP BY repo"
)
SQL["listing_counts"] = (
    with_(REPO_FILES, LISTABLE, o.dirs_sql("base"), o.nodes_sql("base", "up")) + COUNTS
)


def closing_sql(text: str) -> str:
    return f"""
UNION ALL SELECT repo, '', 0, '' FROM ({COUNTS})
UNION ALL SELECT repo, '', 1, {text} FROM ({COUNTS})"""


TEXT_CLOSING = closing_sql("concat(directories, ' directories, ', files, ' files')")
MARKDOWN_CLOSING = closing_sql("concat('*', directories, ' directories, ', files, ' files*')")
FIRST_COMMENT = "string_split(comment, chr(10))[1]"
SQL["text_report"] = with_(*FROM_CODE, COMMENTS, TREE) + f"""
SELECT d.repo, d.path, CAST(0 AS BIGINT) AS seq,
       concat(prefix, connector, name, CASE WHEN node_type = 'file' THEN concat('  [', {size_sql('size_bytes')}, ']') ELSE '' END,
              CASE WHEN comment IS NULL THEN '' ELSE concat('  ', {FIRST_COMMENT}) END) AS text
FROM (SELECT drawn.*, c.comment FROM drawn LEFT JOIN comments c ON c.repo = drawn.repo AND c.path = drawn.path) d
{TEXT_CLOSING}"""
WIDTH = f"CASE WHEN 80 - 4 * {DEPTH.replace('path', 'm.path')} - 2 > 10 THEN 80 - 4 * {DEPTH.replace('path', 'm.path')} - 2 END"
SQL["text_report_full"] = PARTS + "," + META + "," + FLAGS + "," + layout_sql(WIDTH) + "," + TREE + f""",
headed AS (
  SELECT d.*, layout, first_line, CASE WHEN first_section = 'type' THEN
           (SELECT arg_min(m.indent, m.seq) FROM meta m WHERE m.repo = d.repo AND m.path = d.path AND section = 'type') ELSE 0 END AS pad
  FROM drawn d LEFT JOIN laid l ON l.repo = d.repo AND l.path = d.path)
SELECT repo, path, CAST(0 AS BIGINT) AS seq, concat(prefix, connector, name, CASE WHEN layout IN ('inline', 'inline_block')
         THEN concat('  # ', repeat(' ', pad), first_line) ELSE '' END) AS text FROM headed
UNION ALL SELECT b.repo, b.path, b.seq + 1, concat(prefix, CASE WHEN is_last THEN '    ' ELSE '│   ' END,
         CASE WHEN b.text IS NULL THEN '' ELSE concat('# ', repeat(' ', b.indent), b.text) END)
FROM blocks b JOIN drawn d ON d.repo = b.repo AND d.path = b.path
{TEXT_CLOSING}"""
SQL["markdown_report"] = with_(*FROM_CODE, COMMENTS, TREE) + f"""
SELECT d.repo, d.path, CAST(0 AS BIGINT) AS seq, concat(repeat('  ', depth), CASE WHEN node_type = 'dir' THEN concat('- **', name, '/**')
  ELSE concat('- `', name, '` (', {size_sql('size_bytes')}, ')', CASE WHEN comment IS NULL THEN '' ELSE concat(' - ', {FIRST_COMMENT}) END) END) AS text
FROM (SELECT tree.*, c.comment FROM tree LEFT JOIN comments c ON c.repo = tree.repo AND c.path = tree.path) d
{MARKDOWN_CLOSING}"""
SQL["markdown_report_full"] = PARTS + "," + META + "," + FLAGS + "," + TREE + f""",
items AS (
  SELECT d.*, coalesce(total, 0) AS total, first_line, c, t, i, d.depth AS level, s.d AS todos,
         (SELECT count(*) FROM meta m WHERE m.repo = d.repo AND m.path = d.path) AS every
  FROM tree d LEFT JOIN shown s ON s.repo = d.repo AND s.path = d.path),
rest AS (
  SELECT m.repo, m.path, m.seq, {trimmed('m.content')} AS content, level FROM meta m JOIN items x ON x.repo = m.repo AND x.path = m.path
  WHERE every > 1 AND CASE WHEN c + t = 0 AND i > 0 AND todos > 0 THEN section = 'import'
                           ELSE m.seq > CASE WHEN c > 0 AND t > 0 THEN 2 ELSE 1 END END),
quoted AS (SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY seq) AS n, content, level FROM rest WHERE content <> ''),
lasts AS (
  SELECT x.repo, x.path, x.level, greatest(coalesce(max(n), 0), 1) AS n, count(n) AS found
  FROM items x LEFT JOIN quoted q ON q.repo = x.repo AND q.path = x.path WHERE every > 1 GROUP BY x.repo, x.path, x.level)
SELECT repo, path, CAST(0 AS BIGINT) AS seq, concat(repeat('  ', depth), CASE WHEN node_type = 'dir' THEN concat('- **', name, '/**')
  ELSE concat('- `', name, '`', CASE WHEN total = 0 THEN '' ELSE concat(' - ', first_line) END) END) AS text FROM items
UNION ALL SELECT repo, path, 1, repeat('  ', level + 1) FROM lasts
UNION ALL SELECT repo, path, 2, concat(repeat('  ', level + 1), '> ') FROM lasts WHERE found = 0
UNION ALL SELECT repo, path, n + 1, concat(repeat('  ', level + 1), '> ', content) FROM quoted
UNION ALL SELECT repo, path, n + 2, '' FROM lasts
{MARKDOWN_CLOSING}"""


def _json_list(category: str) -> str:
    items = f"list(CAST(to_json(module) AS VARCHAR) ORDER BY seq) FILTER (category = '{category}')"
    return f"""CASE WHEN count(*) FILTER (category = '{category}') > 0
      THEN concat('"{category}":[', array_to_string({items}, ','), ']') END"""


SQL["json_records"] = PARTS + f""",
t AS (SELECT repo, path, concat('[', string_agg(CAST(to_json(signature) AS VARCHAR), ',' ORDER BY seq), ']') AS types FROM sigs GROUP BY repo, path),
d AS (SELECT repo, path, concat('[', string_agg(concat('{{"type":"', marker, '","text":', CAST(to_json(text) AS VARCHAR), ',"line":', line, '}}'), ','
        ORDER BY line), ']') AS todos FROM todos GROUP BY repo, path),
i AS (SELECT repo, path, concat('{{', concat_ws(',', {_json_list('external')}, {_json_list('std')}, {_json_list('internal')}), '}}') AS imports
      FROM imports GROUP BY repo, path)
SELECT x.repo, x.path, concat('{{', concat_ws(',', '"type":"file"', concat('"name":', CAST(to_json({NAME.replace('path', 'x.path')}) AS VARCHAR)),
    concat('"path":', CAST(to_json(x.path) AS VARCHAR)),
    CASE WHEN comment IS NOT NULL THEN concat('"comment":', CAST(to_json(comment) AS VARCHAR)) END,
    CASE WHEN types IS NOT NULL THEN concat('"types":', types) END, CASE WHEN todos IS NOT NULL THEN concat('"todos":', todos) END,
    CASE WHEN imports IS NOT NULL THEN concat('"imports":', imports) END, concat('"size_bytes":', size_bytes),
    concat('"size_human":"', {size_sql('size_bytes')}, '"')), '}}') AS json
FROM code_files x LEFT JOIN comments c ON c.repo = x.repo AND c.path = x.path LEFT JOIN t ON t.repo = x.repo AND t.path = x.path
  LEFT JOIN d ON d.repo = x.repo AND d.path = x.path LEFT JOIN i ON i.repo = x.repo AND i.path = x.path"""
NAMED = """concat('"name":', CAST(to_json(name) AS VARCHAR), ',"path":', CAST(to_json(path) AS VARCHAR))"""
COMMA = "CASE WHEN depth > 0 AND NOT is_first THEN ',' ELSE '' END"
SQL["json_tree"] = with_(*FROM_CODE, COMMENTS, TREE) + f"""
SELECT repo, path, depth AS level, concat({COMMA}, '{{"type":"dir",', {NAMED}, ',"children":[') AS text FROM flagged WHERE node_type = 'dir'
UNION ALL SELECT repo, path, depth + 1, ']}}' FROM flagged WHERE node_type = 'dir'
UNION ALL SELECT repo, path, depth, concat({COMMA}, '{{"type":"file",', {NAMED},
    CASE WHEN comment IS NULL THEN '' ELSE concat(',"comment":', CAST(to_json(comment) AS VARCHAR)) END, '}}')
FROM (SELECT x.*, c.comment FROM flagged x LEFT JOIN comments c ON c.repo = x.repo AND c.path = x.path) WHERE node_type = 'file'"""

# --- sources, sinks and streams ------------------------------------------------

SQL["corpus_round_trip"] = with_(REPO_FILES) + (
    "SELECT repo, path, CAST(size_bytes AS BIGINT) AS size_bytes, is_symlink, false AS is_dir FROM repo_files"
)
SQL["stream_comments"] = with_(*FROM_CODE, COMMENTS) + "SELECT * FROM comments"
SQL["stream_signatures"] = with_(*FROM_CODE, SIGS) + "SELECT * FROM sigs"
SQL["stream_todos"] = SQL["todos"]
SQL["stream_imports"] = with_(*FROM_CODE, IMPORTS) + "SELECT * FROM imports"
SQL["stream_extension_counts"] = SQL["extension_counts"]
SQL["stream_changed_counts"] = with_(CODE_FILES, BY_EXT.replace("FROM code_files)", "FROM code_files WHERE length(path) % 7 <> 0)")) + "SELECT * FROM by_ext"
SQL["stream_language_counts"] = with_(CODE_FILES, BY_EXT, LANGUAGE_STATS) + "SELECT repo, language, files, lines FROM language_stats"
SQL["scanned_entries"] = with_(CODE_FILES, o.dirs_sql("code_files")) + (
    "SELECT repo, path, size_bytes, false AS is_dir, sha256(content) AS digest FROM code_files"
    " UNION ALL SELECT repo, path, 0, true, NULL FROM up"
)
SQL["stream_arrived_files"] = with_(CODE_FILES, BY_EXT) + "SELECT 'all' AS repo, ext, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines FROM by_ext GROUP BY ext"
SQL["stream_scanned_files"] = with_(*FROM_CODE, TODOS) + "SELECT 'all' AS repo, concat(repo, '/', path) AS path, line, marker, text FROM todos"

# --- odd bytes, unknown times, empty directories, written tables, choices --------------

NUMBER = r"CAST(regexp_extract(path, 'doc_(\d+)', 1) AS BIGINT)"
SQL["language_extensions"] = with_(CODE_FILES, BY_EXT) + f"SELECT repo, {LANGUAGE} AS language, ext, files, lines FROM by_ext"
SQL["valid_text_only"] = with_(*FROM_CODE) + (
    f"SELECT repo, path, ext AS canon_ext, CAST(strlen(content) AS BIGINT) AS bytes FROM f WHERE {NUMBER} % 9 <> 4"
)
SQL["line_counts_any_bytes"] = with_(CODE_FILES) + f"""
SELECT repo, path, CASE WHEN {NUMBER} % 9 = 4 THEN CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT)
  ELSE {LINES} END AS lines FROM code_files"""
UNTIMED = """
timed AS (SELECT * FROM base WHERE coalesce(doc_id % 6 = 2, false)
  OR mtime >= TIMESTAMP '2024-01-03 00:00:00' AND mtime <= TIMESTAMP '2024-01-20 12:00:00')"""
SQL["newer_unknown_times"] = with_(REPO_FILES, LISTABLE, UNTIMED, o.dirs_sql("base"), o.nodes_sql("timed", "up")) + NODES
SQL["empty_directories"] = """
SELECT repo, path, CAST(length(path) - length(replace(path, '/', '')) + 1 AS BIGINT) AS depth, 'dir' AS node_type
FROM (SELECT DISTINCT source AS repo, unnest(['void', 'void/deep']) AS path FROM documents)"""
SQL["filters_combined"] = SQL["gitignore_listing"].removesuffix(NODES) + "," + TIMED.strip() + f"""
{NODES} WHERE depth <= 3 AND (node_type = 'dir' OR (repo, path) IN (SELECT (repo, path) FROM timed))"""
SQL["tracked_from_tables"] = SQL["tracked_union"]
NAMED_BY_TEXT = """
named AS (
  SELECT repo, concat(path, chr(9), coalesce(text, '')) AS path, doc_id, quality, NOT (toxic = 1) AND NOT (doc_id % 2 = 0) AS changed
  FROM repo_files JOIN (SELECT doc_id, text FROM documents) USING (doc_id) JOIN labels USING (doc_id))"""
SQL["tracked_from_text"] = with_(REPO_FILES, NAMED_BY_TEXT) + """
SELECT repo, path FROM named WHERE quality = 1 OR changed
UNION SELECT repo, concat(path, '.old') FROM named WHERE changed AND doc_id % 3 = 0"""
# The two closing rows are the root's too; the root's first row is never empty.
SQL["text_report_places"] = f"""
WITH laid_out AS (
  SELECT repo, path, strlen(text) + 1 AS bytes, coalesce(sum(strlen(text) + 1) OVER (
           PARTITION BY repo ORDER BY path = '' AND (seq = 1 OR text = ''), CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_byte
  FROM ({SQL["text_report"]}))
SELECT repo, path, CAST(min(first_byte) AS BIGINT) AS first_byte, CAST(sum(bytes) AS BIGINT) AS bytes FROM laid_out GROUP BY repo, path"""
SQL["own_extractor"] = with_(*FROM_CODE) + """
SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS seq, left(t, 20) AS content, 'long' AS style,
       CAST(NULL AS VARCHAR) AS symbol, CAST(0 AS BIGINT) AS indent FROM ls WHERE length(t) > 60"""
for _name, _groups in {"types": {"type": 1}, "todos": {"todo": 1}, "imports": {"import": 1}, "default": {"comment": 1}}.items():
    SQL[f"metadata_choice_{_name}"] = PARTS + "," + metadata_sql(_groups) + " SELECT * FROM meta"
