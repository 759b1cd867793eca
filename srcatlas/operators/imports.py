"""Imports per file, sorted into external, standard and internal modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.display import simplify_path
from srcatlas.functions.text import HWS, bind, raw_lines, rtrim, trim
from srcatlas.operators.corpus import with_text

CATEGORIES = ["external", "std", "internal"]

# Roots, built-in modules and library modules per language.
RUST_STD_ROOTS = ["std", "core", "alloc"]
RUST_INTERNAL_ROOTS = ["crate", "self", "super"]
NODE_MODULES = [
    "assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns",
    "domain", "events", "fs", "http", "https", "module", "net", "os", "path", "process", "punycode",
    "querystring", "readline", "repl", "stream", "string_decoder", "timers", "tls", "tty", "url", "util",
    "v8", "vm", "zlib",
]
PYTHON_MODULES = [
    "abc", "aifc", "argparse", "array", "ast", "asynchat", "asyncio", "asyncore", "atexit", "audioop",
    "base64", "bdb", "binascii", "bisect", "builtins", "bz2", "calendar", "cgi", "cgitb", "chunk", "cmath",
    "cmd", "code", "codecs", "codeop", "collections", "colorsys", "compileall", "concurrent",
    "configparser", "contextlib", "contextvars", "copy", "copyreg", "cProfile", "crypt", "csv", "ctypes",
    "curses", "dataclasses", "datetime", "dbm", "decimal", "difflib", "dis", "distutils", "doctest",
    "email", "encodings", "enum", "errno", "faulthandler", "fcntl", "filecmp", "fileinput", "fnmatch",
    "fractions", "ftplib", "functools", "gc", "getopt", "getpass", "gettext", "glob", "graphlib", "grp",
    "gzip", "hashlib", "heapq", "hmac", "html", "http", "imaplib", "imghdr", "importlib", "inspect", "io",
    "ipaddress", "itertools", "json", "keyword", "linecache", "locale", "logging", "lzma", "mailbox",
    "mailcap", "marshal", "math", "mimetypes", "mmap", "modulefinder", "multiprocessing", "netrc",
    "nntplib", "numbers", "operator", "optparse", "os", "pathlib", "pdb", "pickle", "pickletools", "pipes",
    "pkgutil", "platform", "plistlib", "poplib", "posix", "pprint", "profile", "pstats", "pty", "pwd",
    "pyclbr", "pydoc", "queue", "quopri", "random", "re", "readline", "reprlib", "resource", "rlcompleter",
    "runpy", "sched", "secrets", "select", "selectors", "shelve", "shlex", "shutil", "signal", "site",
    "smtpd", "smtplib", "sndhdr", "socket", "socketserver", "sqlite3", "ssl", "stat", "statistics",
    "string", "stringprep", "struct", "subprocess", "sunau", "symtable", "sys", "sysconfig", "syslog",
    "tabnanny", "tarfile", "telnetlib", "tempfile", "termios", "textwrap", "threading", "time", "timeit",
    "tkinter", "token", "tokenize", "tomllib", "trace", "traceback", "tracemalloc", "tty", "turtle",
    "types", "typing", "unicodedata", "unittest", "urllib", "uu", "uuid", "venv", "warnings", "wave",
    "weakref", "webbrowser", "winreg", "winsound", "wsgiref", "xdrlib", "xml", "xmlrpc", "zipapp",
    "zipfile", "zipimport", "zlib", "zoneinfo",
]

# Import statements, on the trimmed line.
RUST_USE = r"(?U)^use\s([^;]++);"
JS_REQUIRE = r"""(?U)require\s*+\(\s*+['"]([^'"]++)['"]\s*+\)"""
PY_IMPORT = r"(?U)^import\s+(\w+)"
PY_FROM = r"(?U)^from\s+(\.*)(\w+)?"
GO_SINGLE = r'(?U)^import\s+"([^"]+)"'
GO_BLOCK_LINE = r'(?U)^(?:\w+\s+)?"([^"]+)"'
GO_BLOCK_START = rf"(?md)^[{HWS}]*+import \("
GO_BLOCK_END = rf"(?md)^[{HWS}]*+\)[{HWS}]*+$"
_FROM_MODULE = r"""\s++from\s++['"]([^'"]++)['"]"""
EXPORT_STAR = r"(?U)export\s++\*"
EXPORT_FROM = r"(?U)export\s++(?:\*|\{[^}]*+\})" + _FROM_MODULE
# Only braces: a later opening takes over inside the braces. It leads to the
# same closing brace and module, and each character is read once.
EXPORT_BRACES_FROM = r"(?U)export\s++\{(?:(?!export\s++\{)[^}])*+\}" + _FROM_MODULE

def _item(category: str, module: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), module.alias("module"))


def _null_if_empty(col: Column) -> Column:
    return bind(col, lambda c: F.when(c != "", c))


def _rust(lines: Column) -> Column:
    def category(path: Column) -> Column:
        root = F.substring_index(path, "::", 1)
        name = F.when(F.contains(path, F.lit("{")), trim(root)).otherwise(root)
        return (
            F.when(name.isin(RUST_STD_ROOTS), _item("std", simplify_path(path)))
            .when(name.isin(RUST_INTERNAL_ROOTS), _item("internal", simplify_path(path)))
            .otherwise(_item("external", name))
        )

    def stated(t: Column) -> Column:
        path = trim(F.regexp_extract(t, RUST_USE, 1))
        return F.when(F.startswith(t, F.lit("use")) & t.rlike(RUST_USE), bind(path, category))

    def items(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("use")), bind(trim(line), stated))

    return F.filter(F.transform(lines, items), lambda m: m.isNotNull())


def es_import_module(line: Column) -> Column:
    """Module of the first ``import … from 'm'`` or ``import 'm'`` of a line.

    The line is cut at its quotes. A piece introduces a module when it ends in
    ``import`` and blanks, or in ``from`` and blanks with an ``import`` and at
    least one character before; the next piece is the module. Each character
    is read a fixed number of times, also on one very long line.
    """
    pieces = F.split(line, "['\"]")

    def opens(piece: Column) -> Column:
        bare = rtrim(piece)
        spaced = F.length(bare) < F.length(piece)
        head = F.left(bare, F.length(bare) - 4)
        after = F.regexp_extract(head, r"(?Us)import\s(.*)$", 1)
        from_form = F.endswith(bare, F.lit("from")) & F.right(head, F.lit(1)).rlike(r"(?U)^\s$") & (
            F.length(after) >= 2
        )
        return spaced & (F.endswith(bare, F.lit("import")) | from_form)

    starts = F.transform(
        pieces,
        lambda p, i: F.when(
            (i + 2 < F.size(pieces)) & F.contains(p, F.lit("import")) & opens(p),
            _null_if_empty(F.get(pieces, i + 1)),
        ),
    )
    return F.get(F.filter(starts, lambda m: m.isNotNull()), F.lit(0))


def _js_category(module: Column) -> Column:
    scoped = F.substring_index(module, "/", 2)
    return (
        F.when(
            F.startswith(module, F.lit("./")) | F.startswith(module, F.lit("../")),
            _item("internal", module),
        )
        .when(F.startswith(module, F.lit("node:")), _item("std", F.substring(module, 6, 1 << 30)))
        .when(module.isin(NODE_MODULES), _item("std", module))
        .when(F.startswith(module, F.lit("@")), _item("external", scoped))
        .otherwise(_item("external", F.substring_index(module, "/", 1)))
    )


def _js(lines: Column, with_require: bool) -> Column:
    def modules(line: Column) -> Column:
        found = [F.when(F.contains(line, F.lit("import")), es_import_module(trim(line)))]
        if with_require:
            found.append(
                F.when(
                    F.contains(line, F.lit("require")),
                    _null_if_empty(F.regexp_extract(line, JS_REQUIRE, 1)),
                )
            )
        found.append(
            F.when(
                F.contains(line, F.lit("export")) & F.contains(line, F.lit("from")),
                _null_if_empty(
                    F.when(
                        line.rlike(EXPORT_STAR), F.regexp_extract(line, EXPORT_FROM, 1)
                    ).otherwise(F.regexp_extract(line, EXPORT_BRACES_FROM, 1))
                ),
            )
        )
        quoted = F.contains(line, F.lit("'")) | F.contains(line, F.lit('"'))
        return F.when(quoted, F.filter(F.array(*found), lambda m: m.isNotNull()))

    per_line = F.filter(F.transform(lines, modules), lambda a: F.size(a) > 0)
    return F.transform(F.flatten(per_line), _js_category)


def _python(lines: Column) -> Column:
    def category(module: Column) -> Column:
        known = F.when(module.isin(PYTHON_MODULES), _item("std", module))
        return F.when(module != "", known.otherwise(_item("external", module)))

    def stated(t: Column) -> Column:
        dots, name = F.regexp_extract(t, PY_FROM, 1), F.regexp_extract(t, PY_FROM, 2)
        return (
            F.when(F.startswith(t, F.lit("import")), bind(F.regexp_extract(t, PY_IMPORT, 1), category))
            .when(
                F.startswith(t, F.lit("from")) & (dots != ""), _item("internal", F.concat(dots, name))
            )
            .when(F.startswith(t, F.lit("from")), bind(name, category))
        )

    def items(line: Column) -> Column:
        named = F.contains(line, F.lit("import")) | F.contains(line, F.lit("from"))
        return F.when(named, bind(trim(line), stated))

    return F.filter(F.transform(lines, items), lambda m: m.isNotNull())


def _go_category(pkg: Column) -> Column:
    simple = ~F.contains(pkg, F.lit(".")) & ~F.contains(pkg, F.lit("/"))
    inner = F.contains(pkg, F.lit("/internal/")) | F.startswith(pkg, F.lit("internal/"))
    return (
        F.when(simple, _item("std", pkg))
        .when(inner, _item("internal", pkg))
        .otherwise(_item("external", F.substring_index(pkg, "/", 3)))
    )


def _go(text: Column) -> Column:
    """Single imports anywhere and the quoted lines of ``import ( … )`` blocks.

    The text is cut where a block opens and each piece once more where the
    block closes, so membership in a block needs no state carried over lines.
    """

    def single(t: Column) -> Column:
        return F.when(
            F.startswith(t, F.lit("import")), _null_if_empty(F.regexp_extract(t, GO_SINGLE, 1))
        )

    def quoted(part: Column) -> Column:
        return F.filter(raw_lines(part), lambda s: F.contains(s, F.lit('"')))

    def outside(part: Column) -> Column:
        return F.transform(quoted(part), lambda s: F.array(single(trim(s))))

    def inside(part: Column) -> Column:
        def both(t: Column) -> Column:
            return F.array(single(t), _null_if_empty(F.regexp_extract(t, GO_BLOCK_LINE, 1)))

        return F.transform(quoted(part), lambda s: bind(trim(s), both))

    def piece(part: Column, k: Column) -> Column:
        body = F.coalesce(F.get(F.split(part, "\n", 2), F.lit(1)), F.lit(""))
        halves = F.split(body, GO_BLOCK_END, 2)
        after = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        return F.when(k == 0, outside(part)).otherwise(
            F.concat(inside(F.get(halves, F.lit(0))), outside(after))
        )

    pieces = F.split(text, GO_BLOCK_START)
    found = F.flatten(F.flatten(F.transform(pieces, piece)))
    return F.transform(F.filter(found, lambda m: m.isNotNull()), _go_category)


# Categories that list a module once, in first-seen order.
DISTINCT_CATEGORIES = {
    "rs": [],
    "ts": ["external"],
    "js": ["external"],
    "py": ["external", "std"],
    "go": ["external", "std"],
}


def _grouped(items: Column, distinct: list[str]) -> Column:
    def group(category: str) -> Column:
        found = F.transform(
            F.filter(items, lambda m: m["category"] == category), lambda m: m["module"]
        )
        return F.array_distinct(found) if category in distinct else found

    return F.struct(*[group(c).alias(c) for c in CATEGORIES])


def import_items(text: Column, lines: Column, canon_ext: Column) -> Column:
    """All import statements of a file as (category, module), in file order."""
    return (
        F.when(canon_ext == "rs", _rust(lines))
        .when(canon_ext == "ts", _js(lines, with_require=False))
        .when(canon_ext == "js", _js(lines, with_require=True))
        .when(canon_ext == "py", _python(lines))
        .when(canon_ext == "go", _go(text))
    )


def grouped_imports(items: Column, canon_ext: Column) -> Column:
    """STRUCT of the three lists with the language's rule on repeats; NULL when empty."""
    out = None
    by_rule: dict[tuple[str, ...], list[str]] = {}
    for ext, distinct in DISTINCT_CATEGORIES.items():
        by_rule.setdefault(tuple(distinct), []).append(ext)
    for distinct, exts in by_rule.items():
        test = canon_ext.isin(exts)
        value = _grouped(items, list(distinct))
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.when(F.size(items) > 0, out)


def imports_total(imports: Column) -> Column:
    return sum((F.size(imports[c]) for c in CATEGORIES[1:]), F.size(imports[CATEGORIES[0]]))


def file_imports(files: DataFrame, **gates: int) -> DataFrame:
    """(repo, path, imports): the wide form, built inside each file's row."""
    items = import_items(F.col("text"), F.col("lines"), F.col("canon_ext"))
    # As a generator the items are worked out once, not again for the size test.
    return (
        with_text(files, **gates)
        .where(F.col("canon_ext").isin(list(DISTINCT_CATEGORIES)))
        .select("repo", "path", "canon_ext", "text", raw_lines(F.col("text")).alias("lines"))
        .select(
            "repo",
            "path",
            "canon_ext",
            F.explode(F.filter(F.array(items), lambda a: F.size(a) > 0)).alias("items"),
        )
        .select(
            "repo", "path", grouped_imports(F.col("items"), F.col("canon_ext")).alias("imports")
        )
    )


def extract_imports(files: DataFrame, **gates: int) -> DataFrame:
    """(repo, path, category, seq, module): the long form; seq counts inside a category."""
    wide = file_imports(files, **gates)

    def rows(category: str) -> Column:
        return F.transform(
            F.col("imports")[category],
            lambda m, i: F.struct(
                F.lit(category).alias("category"), (i + 1).alias("seq"), m.alias("module")
            ),
        )

    every = F.concat(*[rows(c) for c in CATEGORIES])
    return wide.select("repo", "path", F.explode(every).alias("r")).select("repo", "path", "r.*")
