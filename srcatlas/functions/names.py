"""Path columns and the extension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spelling -> canonical extension, grouped by the canonical one.
CANONICAL_EXTENSIONS = {
    "rs": ["rs"],
    "py": ["py", "pyw", "pyi"],
    "js": ["js", "jsx", "mjs", "cjs"],
    "ts": ["ts", "tsx", "mts", "cts"],
    "go": ["go"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp", "hxx", "hh"],
    "cs": ["cs"],
    "java": ["java"],
    "rb": ["rb"],
    "php": ["php"],
    "sh": ["sh", "bash", "zsh", "fish"],
    "swift": ["swift"],
    "kt": ["kt", "kts"],
    "scala": ["scala", "sc"],
    "lua": ["lua"],
    "pl": ["pl", "pm"],
    "r": ["r"],
    "jl": ["jl"],
    "dart": ["dart"],
    "ex": ["ex", "exs"],
    "erl": ["erl", "hrl"],
    "hs": ["hs", "lhs"],
    "ml": ["ml", "mli"],
    "fs": ["fs", "fsi", "fsx"],
    "clj": ["clj", "cljs", "cljc", "edn"],
    "zig": ["zig"],
    "vue": ["vue"],
    "svelte": ["svelte"],
}

# Language shown in statistics -> its extensions.
LANGUAGES = {
    "Rust": ["rs"],
    "JavaScript": ["js", "mjs", "cjs"],
    "TypeScript": ["ts", "mts", "cts"],
    "JSX": ["jsx"],
    "TSX": ["tsx"],
    "Python": ["py", "pyw", "pyi"],
    "Go": ["go"],
    "Java": ["java"],
    "Kotlin": ["kt", "kts"],
    "C": ["c", "h"],
    "C++": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"],
    "C#": ["cs"],
    "Swift": ["swift"],
    "Ruby": ["rb", "erb"],
    "PHP": ["php"],
    "Shell": ["sh", "bash", "zsh", "fish"],
    "HTML": ["html", "htm"],
    "CSS": ["css"],
    "Sass": ["scss", "sass"],
    "Less": ["less"],
    "Vue": ["vue"],
    "Svelte": ["svelte"],
    "JSON": ["json"],
    "YAML": ["yaml", "yml"],
    "TOML": ["toml"],
    "XML": ["xml"],
    "Config": ["ini", "cfg"],
    "Markdown": ["md", "markdown"],
    "Text": ["txt"],
    "reStructuredText": ["rst"],
    "SQL": ["sql"],
    "GraphQL": ["graphql", "gql"],
    "Protocol Buffers": ["proto"],
    "Lua": ["lua"],
    "R": ["r"],
    "Scala": ["scala"],
    "Clojure": ["clj", "cljs", "cljc"],
    "Elixir": ["ex", "exs"],
    "Erlang": ["erl", "hrl"],
    "Haskell": ["hs", "lhs"],
    "OCaml": ["ml", "mli"],
    "F#": ["fs", "fsx", "fsi"],
    "Perl": ["pl", "pm"],
    "Dart": ["dart"],
    "Zig": ["zig"],
    "Nim": ["nim"],
    "No Extension": [""],
}
UNKNOWN_LANGUAGE = "Other"


def _pairs(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(ext, group) for group, exts in groups.items() for ext in exts]


def _lookup(ext: Column, groups: dict[str, list[str]]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in _pairs(groups) for v in pair])
    return F.try_element_at(table, ext)


def language_table(spark: SparkSession) -> DataFrame:
    """Dimension table (ext, language); its size is fixed by the list above."""
    return spark.createDataFrame(_pairs(LANGUAGES), "ext string, language string")


def base_name(path: Column) -> Column:
    """Last component; ``.`` for the root."""
    return F.when(path == "", F.lit(".")).otherwise(F.substring_index(path, "/", -1))


def parent_path(path: Column) -> Column:
    """Directory part; empty for entries of the root, NULL for the root itself."""
    keep = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(path == "", F.lit(None)).otherwise(F.left(path, F.greatest(keep, F.lit(0))))


def path_depth(path: Column) -> Column:
    """0 for the root, 1 for its entries."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "", F.lit(0)).otherwise(slashes + 1)


def file_ext(path: Column) -> Column:
    """Lower-cased text after the last dot; empty when there is none.

    A name whose only dot is its first character has no extension.
    """
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+\.([^.]*)$", 1))


def canonical_ext(ext: Column) -> Column:
    """Canonical extension for one of the recognised spellings, else NULL."""
    return _lookup(ext, CANONICAL_EXTENSIONS)


def language_of(ext: Column) -> Column:
    return F.coalesce(_lookup(ext, LANGUAGES), F.lit(UNKNOWN_LANGUAGE))


def ancestors(path: Column, include_root: bool = True) -> Column:
    """All proper ancestor directories, outermost first."""
    parts = F.split(path, "/")
    depth = path_depth(path)
    inner = F.when(
        depth > 1,
        F.transform(
            F.sequence(F.lit(1), depth - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")
        ),
    ).otherwise(F.array().cast("array<string>"))
    if not include_root:
        return inner
    return F.when(depth > 0, F.concat(F.array(F.lit("")), inner)).otherwise(inner)


def sort_key(path: Column) -> Column:
    """Key whose order is depth-first preorder with siblings by raw name."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def with_path_columns(files: DataFrame) -> DataFrame:
    path = F.col("path")
    ext = file_ext(path)
    return files.select(
        "*",
        base_name(path).alias("name"),
        parent_path(path).alias("parent"),
        path_depth(path).alias("depth"),
        ext.alias("ext"),
    ).select("*", canonical_ext(F.col("ext")).alias("canon_ext"))
