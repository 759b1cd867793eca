"""The derived files of ``bridge.py`` spelled out in SQL, and shared SQL pieces."""

from __future__ import annotations

from srcatlas.functions.names import CANONICAL_EXTENSIONS
from srcatlas.plans import bridge as b


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(pattern: str, fields: dict[str, str]) -> str:
    pieces = b.FIELD.split(pattern)
    parts = [fields[p] if i % 2 else quote(p) for i, p in enumerate(pieces) if i % 2 or p]
    return "concat(" + ", ".join(parts) + ")" if parts else "''"


def _choose(index: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options))
    return f"CASE {index} {cases} END"


def _content(kind: tuple[str, str, list[list[str]]]) -> str:
    _, family, headers = kind
    fields = {"s": "coalesce(sentences[1], '')", "l": "lang", "o": "source", "d": "CAST(doc_id AS VARCHAR)"}
    variants = ["[" + ", ".join(_fill(p, fields) for p in lines) + "]" for lines in headers]
    patterns = b.whole(family)
    own = {**fields, "x": "x", "w": "string_split(x, ' ')[1]", "i": "CAST(i - 1 AS VARCHAR)"}
    line = _choose(f"(i - 1) % {len(patterns)}", [_fill(p, own) for p in patterns])
    head = _choose(f"(doc_id // 20) % {len(headers)}", variants)
    return f"list_concat({head}, list_transform(sentences, lambda x, i: {line}))"


def files_sql(kind_of: str, kinds: list[int]) -> str:
    """CTE ``code_files`` (doc_id, repo, path, mtime, content, size_bytes)."""
    rows = "CASE kind " + " ".join(f"WHEN {k} THEN {_content(b.KINDS[k])}" for k in kinds) + " END"
    ext = _choose("kind", [quote(k[0]) for k in b.KINDS])
    return f"""
sentences AS (
  SELECT doc_id, lang, source, CAST({kind_of} AS INTEGER) AS kind,
         list_filter(list_transform(string_split(replace(text, '.', chr(10)), chr(10)), lambda s: trim(s)),
                     lambda s: s <> '') AS sentences
  FROM documents),
joined AS (
  SELECT doc_id, lang, source, array_to_string({rows}, chr(10)) AS body, {ext} AS ext,
         CASE WHEN doc_id % 11 = 0 THEN concat(chr(13), chr(10)) ELSE chr(10) END AS eol
  FROM sentences),
code_files AS (
  SELECT doc_id, source AS repo,
         concat(lang, '/d', doc_id % 13, '/',
                CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('m', doc_id % 5, '/') END, 'doc_', doc_id, ext) AS path,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS mtime,
         concat(replace(body, chr(10), eol), CASE WHEN doc_id % 3 = 0 THEN '' ELSE eol END) AS content,
         CAST(strlen(concat(replace(body, chr(10), eol), CASE WHEN doc_id % 3 = 0 THEN '' ELSE eol END)) AS BIGINT) AS size_bytes
  FROM joined)"""


CODE_FILES = files_sql(f"(doc_id + doc_id // 20) % {len(b.KINDS)}", list(range(len(b.KINDS))))


def language_files_sql(*exts: str) -> str:
    kinds = [k for k, kind in enumerate(b.KINDS) if kind[0] in exts]
    turn = str(kinds[0]) if len(kinds) == 1 else _choose(f"doc_id % {len(kinds)}", [str(k) for k in kinds])
    return files_sql(turn, kinds)


# Name parts of a path.
NAME = "regexp_extract(path, '[^/]*$')"
PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
DEPTH = "CAST(length(path) - length(replace(path, '/', '')) + 1 AS BIGINT)"
EXT = f"lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1))"


def lookup_sql(value: str, groups: dict[str, list[str]], default: str) -> str:
    cases = " ".join(
        f"WHEN {value} IN ({', '.join(quote(e) for e in exts)}) THEN {quote(g)}" for g, exts in groups.items()
    )
    return f"CASE {cases} ELSE {default} END"


def canon_sql() -> str:
    return lookup_sql(EXT, CANONICAL_EXTENSIONS, "NULL")


TRIMMED = "trim({0}, concat(' ', chr(9), chr(13), chr(10)))"


def trimmed(value: str) -> str:
    return TRIMMED.format(value)


def lines_sql(source: str = "code_files", cap: int | None = None) -> str:
    """CTEs ``f`` (repo, path, ext, content) and ``ls`` (…, line, raw, t): t is trimmed."""
    small = f"WHERE size_bytes <= {cap}" if cap else ""
    return f"""
f AS (SELECT * FROM (SELECT repo, path, {canon_sql()} AS ext, content FROM {source} {small})
      WHERE ext IS NOT NULL),
split_files AS (SELECT repo, path, ext, string_split(content, chr(10)) AS parts FROM f),
raw_lines AS (
  SELECT repo, path, ext, unnest(parts) AS raw, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line
  FROM split_files),
ls AS (SELECT repo, path, ext, line, raw, {trimmed('raw')} AS t FROM raw_lines)"""


def dirs_sql(source: str, name: str = "up") -> str:
    """CTE of (repo, path): every directory but the root."""
    return f"""
{name} AS (
  SELECT DISTINCT repo, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path
  FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS n FROM {source}))"""


IGNORE_FILES = {"root": "\n".join(b.ROOT_RULES) + "\n", "nested": "\n".join(b.NESTED_RULES) + "\n"}

# The derived repositories with hidden folders, links and ignore files.
REPO_FILES = CODE_FILES + f""",
repo_files AS (
  SELECT repo, CASE WHEN doc_id % 29 = 7 THEN concat('.git/objects/', path)
                    WHEN doc_id % 23 = 5 THEN concat('.github/', path) ELSE path END AS path,
         size_bytes, mtime, doc_id % 31 = 3 AS is_symlink, doc_id
  FROM code_files
  UNION ALL SELECT DISTINCT source, '.gitignore', {len(IGNORE_FILES['root'])}, TIMESTAMP '2024-01-01 00:00:00', false,
                   CAST(NULL AS BIGINT) FROM documents
  UNION ALL SELECT DISTINCT source, concat(lang, '/.gitignore'), {len(IGNORE_FILES['nested'])},
                   TIMESTAMP '2024-01-01 00:00:00', false, CAST(NULL AS BIGINT) FROM documents)"""

IN_GIT = "list_contains(string_split(path, '/'), '.git')"
LISTABLE = f"""base AS (SELECT * FROM repo_files WHERE NOT is_symlink AND NOT {IN_GIT})"""


def nodes_sql(files: str, dirs: str, roots: str = "repo_files") -> str:
    """CTE ``nodes`` (repo, path, depth, node_type, size_bytes)."""
    return f"""
nodes AS (
  SELECT DISTINCT repo, '' AS path, CAST(0 AS BIGINT) AS depth, 'dir' AS node_type, CAST(NULL AS BIGINT) AS size_bytes FROM {roots}
  UNION ALL SELECT repo, path, {DEPTH}, 'dir', NULL FROM {dirs}
  UNION ALL SELECT repo, path, {DEPTH}, 'file', size_bytes FROM {files})"""
