"""Registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.functions import display, names, quoting, text as tx
from srcatlas.operators import chunks, filters, ignore, metadata as md, reports, stats, tree
from srcatlas.operators.comments import extract_comments
from srcatlas.operators.corpus import source_lines, with_text
from srcatlas.operators.imports import CATEGORIES, extract_imports, file_imports, imports_total
from srcatlas.operators.signatures import extract_signatures
from srcatlas.operators.todos import extract_todos
from srcatlas.plans import bridge
from srcatlas.plans.bridge import code_files, language_files, repository_files, url_files
from srcatlas.session import shared_folder
from srcatlas.sinks import documents, writers
from srcatlas.sources import arrivals, dirscan, printed, tables
from srcatlas.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NEWER, OLDER = "2024-01-03T00:00:00Z", "2024-01-20T12:00:00Z"
SIZE_CAP = 4_000
TOP_K = 25
WRAP_WIDTH = 40
CHUNK = 700
ALL_SECTIONS = md.Sections(comments=True, types=True, todos=True, imports=True, full=True)


def query(fn: Query) -> Query:
    """Register under the function's name; whole numbers come out as bigint."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        small = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType))}
        return df.select(*[F.col(c).cast("bigint").alias(c) if c in small else F.col(c) for c in df.columns])

    QUERIES[fn.__name__] = run
    return fn


def joined(items: Column, sep: str = "|") -> Column:
    return F.array_join(items, sep)


# --- statistics -----------------------------------------------------------


@query
def language_stats(spark, sf_dir):
    found = stats.listed_language_stats(stats.language_extensions(code_files(spark, sf_dir)))
    return found.withColumn("extensions", joined(F.col("extensions")))


@query
def language_extensions(spark, sf_dir):
    return stats.language_extensions(code_files(spark, sf_dir))


@query
def language_stats_no_lines(spark, sf_dir):
    found = stats.listed_language_stats(stats.language_extensions(repository_files(spark, sf_dir), with_lines=False))
    return found.drop("lines").withColumn("extensions", joined(F.col("extensions")))


@query
def languages_ranked(spark, sf_dir):
    found = stats.language_stats(code_files(spark, sf_dir), with_lines=False)
    return stats.languages_by_files(found).select("repo", "rank", "language", "files")


@query
def extension_counts(spark, sf_dir):
    return stats.extension_counts(code_files(spark, sf_dir))


@query
def line_counts(spark, sf_dir):
    lines = tx.count_lines(F.col("content"), F.col("size_bytes"))
    return code_files(spark, sf_dir).select("repo", "path", "size_bytes", lines.alias("lines"))


@query
def chunked_line_counts(spark, sf_dir):
    return chunks.chunk_line_counts(chunks.cut_files(code_files(spark, sf_dir), CHUNK))


@query
def chunked_source_lines(spark, sf_dir):
    found = chunks.chunk_source_lines(chunks.cut_files(code_files(spark, sf_dir), CHUNK))
    return found.select("repo", "path", "line", "content", tx.indent_of(F.col("content")).alias("indent"))


@query
def chunked_todos(spark, sf_dir):
    return chunks.chunk_todos(chunks.cut_files(code_files(spark, sf_dir), CHUNK))


@query
def codebase_totals(spark, sf_dir):
    return stats.codebase_totals(code_files(spark, sf_dir))


@query
def stats_rollup(spark, sf_dir):
    return stats.stats_rollup(code_files(spark, sf_dir))


@query
def visible_file_stats(spark, sf_dir):
    return stats.extension_counts(stats.countable_files(repository_files(spark, sf_dir)), with_lines=False)


@query
def all_file_stats(spark, sf_dir):
    files = stats.countable_files(repository_files(spark, sf_dir), show_hidden=True)
    return stats.extension_counts(files, with_lines=False)


@query
def directory_rollup(spark, sf_dir):
    return stats.directory_rollup(code_files(spark, sf_dir))


@query
def directory_rollup_lines(spark, sf_dir):
    lines = tx.count_lines(F.col("content"), F.col("size_bytes"))
    return stats.directory_rollup(code_files(spark, sf_dir).withColumn("n", lines), {"lines": "n"})


@query
def url_tree_rollup(spark, sf_dir):
    return stats.directory_rollup(url_files(spark, sf_dir))


@query
def stats_report(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = reports.stats_report(stats.language_stats(files), stats.codebase_totals(files))
    return rows.select("repo", F.col("sort_key")[0]["o"].alias("part"), "seq", "text")


@query
def stats_json(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return reports.stats_json(stats.listed_language_stats(stats.language_extensions(files)), stats.codebase_totals(files))


# --- columns of paths, sizes and lines --------------------------------------


@query
def path_columns(spark, sf_dir):
    files = names.with_path_columns(repository_files(spark, sf_dir))
    return files.select(
        "repo", "path", "name", "parent", "depth", "ext", "canon_ext", names.language_of(F.col("ext")).alias("language")
    )


@query
def size_labels(spark, sf_dir):
    size = F.col("size_bytes")
    return code_files(spark, sf_dir).select(
        "repo", "path", display.format_size(size).alias("label"), display.format_number(size).alias("grouped"),
        display.format_size(size * 997).alias("label_m"), display.format_size(size * 1_000_003).alias("label_g"),
    )


@query
def source_line_table(spark, sf_dir):
    found = source_lines(code_files(spark, sf_dir))
    return found.select("repo", "path", "line", "content", tx.indent_of(F.col("content")).alias("indent"))


@query
def ancestor_dirs(spark, sf_dir):
    return stats.directories(repository_files(spark, sf_dir))


# --- filters ---------------------------------------------------------------


def _listing(nodes: DataFrame) -> DataFrame:
    return nodes.select("repo", "path", "depth", "node_type")


@query
def list_all(spark, sf_dir):
    return _listing(tree.list_nodes(repository_files(spark, sf_dir)))


@query
def depth_limit(spark, sf_dir):
    return _listing(tree.list_nodes(repository_files(spark, sf_dir), max_depth=3))


@query
def dirs_only(spark, sf_dir):
    return _listing(tree.list_nodes(repository_files(spark, sf_dir), dirs_only=True))


@query
def ignore_glob(spark, sf_dir):
    patterns = ["d1?", "*.[jt]s", "m[!0-2]", ".gitignore"]
    return _listing(tree.list_nodes(repository_files(spark, sf_dir), ignore_names=patterns))


@query
def newer_older(spark, sf_dir):
    return _listing(tree.list_nodes(repository_files(spark, sf_dir), newer=NEWER, older=OLDER))


@query
def size_cap(spark, sf_dir):
    return with_text(code_files(spark, sf_dir), max_file_size=SIZE_CAP).select(
        "repo", "path", "canon_ext", F.octet_length("text").alias("bytes")
    )


# --- ignore rules and tracked paths -------------------------------------------


@query
def ignore_rules(spark, sf_dir):
    rules = ignore.read_ignore_rules(repository_files(spark, sf_dir))
    return rules.select("repo", "base_dir", "line", "pattern", "negated", "dir_only", "anchored")


@query
def gitignore_included(spark, sf_dir):
    files = repository_files(spark, sf_dir)
    return ignore.included_entries(files, ignore.read_ignore_rules(files))


@query
def gitignore_listing(spark, sf_dir):
    files = repository_files(spark, sf_dir)
    return _listing(tree.list_nodes(files, rules=ignore.read_ignore_rules(files)))


@query
def show_all_listing(spark, sf_dir):
    files = repository_files(spark, sf_dir)
    return _listing(tree.list_nodes(files, rules=ignore.read_ignore_rules(files), show_all=True))


@query
def included_dirs_only(spark, sf_dir):
    files = repository_files(spark, sf_dir)
    rules = ignore.read_ignore_rules(files)
    return _listing(tree.list_nodes(files, rules=rules, dirs_only=True, rules_hide_dirs=True))


def _index_and_status(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Index: documents with a label; status: all labelled ones, by their marks."""
    files = repository_files(spark, sf_dir).withColumn(
        "doc_id", F.regexp_extract("path", r"doc_(\d+)", 1).try_cast("bigint")
    )
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = files.select("repo", "path", "doc_id").join(labels, "doc_id")
    index = marked.where("quality = 1").select("repo", "path")
    status = marked.select(
        "repo", "path", (F.col("toxic") == 1).alias("is_new"), (F.col("doc_id") % 2 == 0).alias("is_ignored")
    )
    return index, status


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.tracked_paths(*_index_and_status(spark, sf_dir))


@query
def tracked_union(spark, sf_dir):
    return _tracked(spark, sf_dir)


@query
def tracked_listing(spark, sf_dir):
    return _listing(tree.list_nodes(repository_files(spark, sf_dir), tracked=_tracked(spark, sf_dir)))


# --- task markers ------------------------------------------------------------


@query
def todos(spark, sf_dir):
    return extract_todos(code_files(spark, sf_dir))


@query
def todos_by_marker(spark, sf_dir):
    return stats.todos_by_marker(extract_todos(code_files(spark, sf_dir)))


@query
def todos_only_files(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return _listing(tree.list_nodes(files, with_todos=extract_todos(files)))


@query
def top_todo_files(spark, sf_dir):
    return stats.top_files(stats.todos_per_file(extract_todos(code_files(spark, sf_dir))), "todos", TOP_K)


@query
def top_size_files(spark, sf_dir):
    return stats.top_files(code_files(spark, sf_dir).select("repo", "path", "size_bytes"), "size_bytes", TOP_K)


# --- signatures ------------------------------------------------------------


def _signatures(ext: str) -> Query:
    return lambda spark, sf_dir: extract_signatures(language_files(spark, sf_dir, ext))


for _name, _ext in {"rust": ".rs", "ts": ".ts", "js": ".js", "python": ".py", "go": ".go"}.items():
    _fn = _signatures(_ext)
    _fn.__name__ = f"signatures_{_name}"
    query(_fn)


@query
def symbols_by_language(spark, sf_dir):
    return stats.symbols_by_language(extract_signatures(code_files(spark, sf_dir)))


@query
def symbol_spans(spark, sf_dir):
    found = extract_signatures(code_files(spark, sf_dir))
    return found.select(
        "repo", "path", "seq", "symbol", display.symbol_span(F.col("signature"), F.col("symbol")).alias("start")
    )


# --- imports ---------------------------------------------------------------


def _imports(ext: str) -> Query:
    return lambda spark, sf_dir: extract_imports(language_files(spark, sf_dir, ext))


for _name, _ext in {"rust": ".rs", "ts": ".ts", "js": ".js", "python": ".py", "go": ".go"}.items():
    _fn = _imports(_ext)
    _fn.__name__ = f"imports_{_name}"
    query(_fn)


@query
def import_usage(spark, sf_dir):
    return stats.import_usage(file_imports(code_files(spark, sf_dir)))


def _wide(found: DataFrame) -> DataFrame:
    imports = F.col("imports")
    return found.select(
        "repo", "path", *[joined(imports[c], "\n").alias(c) for c in CATEGORIES],
        imports_total(imports).alias("total"), display.imports_summary(imports).alias("summary"),
    )


@query
def file_imports_wide(spark, sf_dir):
    return _wide(file_imports(code_files(spark, sf_dir)))


@query
def chunked_imports(spark, sf_dir):
    return _wide(chunks.chunk_imports(chunks.cut_files(code_files(spark, sf_dir), CHUNK)))


# --- comments --------------------------------------------------------------


def _comments(*exts: str) -> Query:
    return lambda spark, sf_dir: extract_comments(language_files(spark, sf_dir, *exts))


for _name, _exts in {
    "rust": (".rs",), "python": (".py",), "js": (".js", ".ts"), "go": (".go",), "c": (".c", ".cpp"),
    "ruby": (".rb",), "shell": (".sh",), "javadoc": (".java", ".kt", ".swift"), "php": (".php",), "csharp": (".cs",),
}.items():
    _fn = _comments(*_exts)
    _fn.__name__ = f"comments_{_name}"
    query(_fn)


@query
def comment_first_line(spark, sf_dir):
    return extract_comments(code_files(spark, sf_dir)).select(
        "repo", "path", tx.first_line(F.col("comment")).alias("first_line")
    )


@query
def wrap_comments(spark, sf_dir):
    flat = F.regexp_replace("comment", "\n", " ")
    wrapped = extract_comments(code_files(spark, sf_dir)).select(
        "repo", "path", F.posexplode(tx.wrap_text(flat, WRAP_WIDTH)).alias("seq", "text")
    )
    return wrapped


# --- metadata and layout ----------------------------------------------------


@query
def metadata_lines(spark, sf_dir):
    return md.metadata_lines(code_files(spark, sf_dir), ALL_SECTIONS)


@query
def metadata_lines_types_first(spark, sf_dir):
    found = md.metadata_lines(
        code_files(spark, sf_dir), md.select_sections(comments=True, types=True), md.TYPES_FIRST
    )
    return found.select("repo", "path", "seq", "section", "content", "indent")


@query
def metadata_flags(spark, sf_dir):
    lines = md.with_section_lines(md.file_sections(code_files(spark, sf_dir), ALL_SECTIONS))
    first = md.first_metadata_line()
    return lines.select(
        "repo", "path", md.total_lines().alias("total"), md.is_empty().alias("is_empty"),
        *[md.has_only(s).alias(f"only_{s}") for s in md.SECTIONS], md.has_both().alias("has_both"),
        md.has_todos().alias("has_todos"), md.has_imports().alias("has_imports"),
        md.first_section_is_single_line().alias("first_is_single"),
        first["section"].alias("first_section"), first["content"].alias("first_line"),
    )


@query
def group_separators(spark, sf_dir):
    """Block rows of the signatures alone, with the blank rows between groups."""
    found = md.file_sections(code_files(spark, sf_dir), md.Sections(comments=False, types=True, full=True))
    some = F.filter(F.array("signatures"), lambda a: F.size(a) > 0)
    typed = found.select("repo", "path", F.explode(some).alias("signatures")).select(
        "repo", "path", md.type_lines(F.col("signatures")).alias("lines")
    )
    rows = md.block_table(md.with_block_rows(typed, "lines", "block"))
    return rows.select("repo", "path", "seq", F.coalesce("text", F.lit("")).alias("text"), "indent")


@query
def layouts(spark, sf_dir):
    lines = md.with_section_lines(md.file_sections(code_files(spark, sf_dir), ALL_SECTIONS))
    laid = md.with_layout(lines, full=True, width=60)
    return laid.select("repo", "path", "layout", F.col("inline.content").alias("inline"), F.size("block").alias("block_rows"))


# --- trees and reports ------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.list_nodes(code_files(spark, sf_dir))


@query
def tree_last_flag(spark, sf_dir):
    return tree.with_last_flag(_nodes(spark, sf_dir)).select("repo", "path", "is_last")


@query
def tree_prefix(spark, sf_dir):
    drawn = tree.drawn_nodes(_nodes(spark, sf_dir))
    return drawn.select("repo", "path", "prefix", "connector")


@query
def tree_preorder(spark, sf_dir):
    return tree.with_preorder(_nodes(spark, sf_dir)).select("repo", "path", "preorder")


@query
def sibling_rank(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).where("depth > 0")
    return tree.with_sibling_rank(nodes).select("repo", "path", "sibling_rank")


@query
def listing_counts(spark, sf_dir):
    return stats.listing_counts(tree.list_nodes(repository_files(spark, sf_dir)))


def _listed_sections(files: DataFrame, sections: md.Sections = md.Sections()) -> DataFrame:
    """The listed files with their sections."""
    return tree.listed_files(md.file_sections(files, sections, every=True))


@query
def text_report(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = reports.text_report(tree.list_nodes(files), md.with_section_lines(_listed_sections(files)), show_size=True)
    return rows.select("repo", "path", "seq", "text")


@query
def text_report_full(spark, sf_dir):
    files = code_files(spark, sf_dir)
    lines = md.with_section_lines(_listed_sections(files, ALL_SECTIONS))
    rows = reports.text_report(tree.list_nodes(files), lines, full=True, wrap=80, prefix="# ")
    return rows.select("repo", "path", "seq", "text")


@query
def markdown_report(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = reports.markdown_report(tree.list_nodes(files), md.with_section_lines(_listed_sections(files)), show_size=True)
    return rows.select("repo", "path", "seq", "text")


@query
def markdown_report_full(spark, sf_dir):
    files = code_files(spark, sf_dir)
    lines = md.with_section_lines(_listed_sections(files, ALL_SECTIONS))
    rows = reports.markdown_report(tree.list_nodes(files), lines, full=True)
    return rows.select("repo", "path", "seq", "text")


@query
def json_records(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return reports.json_records(tree.list_nodes(files), _listed_sections(files, ALL_SECTIONS), show_size=True)


@query
def json_tree(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = reports.json_tree(tree.list_nodes(files), _listed_sections(files))
    return rows.select("repo", "path", F.size("sort_key").alias("level"), "text")


# --- sources, sinks and streams ------------------------------------------------


def _scratch(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@query
def corpus_round_trip(spark, sf_dir):
    """Write the corpus table, read it back and list it without its contents."""
    target = _scratch(spark, "corpus")
    writers.write_table(repository_files(spark, sf_dir), target)
    return tables.read_corpus(spark, target).select("repo", "path", "size_bytes", "is_symlink", "is_dir")


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files that arrive in two batches, each with a file for every core."""
    cores = spark.sparkContext.defaultParallelism
    source = _scratch(spark, "arriving")
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given.repartition(2 * cores, "doc_id").write.parquet(source)
    written = spark.read.parquet(source).inputFiles()
    docs = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", -(-len(written) // 2)).parquet(source)
    return bridge.files_of(docs, bridge.kind_column(), list(range(len(bridge.KINDS))))


def _stream_extraction(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = _scratch(spark, f"stream-{kind}")
        jobs.start_extraction(_document_stream(spark, sf_dir), kind, target, target + "-progress").awaitTermination()
        return spark.read.parquet(target)

    run.__name__ = f"stream_{kind}"
    return run


for _kind in jobs.EXTRACTORS:
    query(_stream_extraction(_kind))


def _stream_counts(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    target = _scratch(spark, "stream-counts")
    jobs.start_counts(_document_stream(spark, sf_dir), target, target + "-progress", by).awaitTermination()
    return jobs.latest_counts(spark, target)


@query
def stream_extension_counts(spark, sf_dir):
    return _stream_counts(spark, sf_dir, "ext")


@query
def stream_language_counts(spark, sf_dir):
    return _stream_counts(spark, sf_dir, "language")


@query
def stream_changed_counts(spark, sf_dir):
    """Every file arrives empty, then as it is; some are removed again."""
    files = code_files(spark, sf_dir)
    day, source = F.expr("INTERVAL 1 DAY"), _scratch(spark, "changes")
    removed = F.length("path") % 7 == 0
    columns = ["repo", "path", "size_bytes", "mtime", "is_dir", "content"]
    first = files.select(*columns).withColumn("content", F.lit(b"")).withColumn("removed", F.lit(False))
    second = files.select(*columns).withColumn("mtime", F.col("mtime") + day).withColumn("removed", F.lit(False))
    third = second.where(removed).withColumn("mtime", F.col("mtime") + day).withColumn("removed", F.lit(True))
    target = _scratch(spark, "changed-counts")
    for versions in (first, second, third):
        versions.write.mode("append").parquet(source)
        changes = spark.readStream.schema(versions.schema).parquet(source)
        jobs.start_file_counts(changes, target, target + "-progress", "ext").awaitTermination()
    return jobs.latest_counts(spark, target)


def _written_files(spark: SparkSession, sf_dir: str) -> str:
    """The derived files as real files, one folder for each repository."""
    root = _scratch(spark, "tree")
    writers.write_files(code_files(spark, sf_dir), root)
    return root


@query
def scanned_entries(spark, sf_dir):
    """Every file and directory of the written trees, as a directory scan finds them."""
    root = _written_files(spark, sf_dir)
    roots = code_files(spark, sf_dir).select("repo").distinct()
    found = dirscan.scan_dirs(roots.withColumn("root", F.concat(F.lit(root + "/"), "repo")))
    return found.select("repo", "path", "size_bytes", "is_dir", F.sha2("content", 256).alias("digest"))


@query
def stream_scanned_files(spark, sf_dir):
    """Task markers of the written trees, read as files that arrive in a folder."""
    root = _written_files(spark, sf_dir)
    target = _scratch(spark, "stream-files")
    arriving = jobs.stream_corpus(spark, root, "all", log=target + "-log")
    jobs.start_extraction(arriving, "todos", target, target + "-progress").awaitTermination()
    return spark.read.parquet(target)


@query
def stream_arrived_files(spark, sf_dir):
    """Files per extension of the written trees, as a stream that sees every name counts them."""
    root, target = _written_files(spark, sf_dir), _scratch(spark, "arrived")
    files = arrivals.stream_arrivals(spark, root, "all", target + "-log")
    jobs.start_file_counts(files, target, target + "-progress", "ext").awaitTermination()
    return jobs.latest_counts(spark, target)


# --- odd bytes, unknown times, empty directories, written tables, choices --------------


def _number() -> Column:
    return F.regexp_extract("path", r"doc_(\d+)", 1).try_cast("bigint")


def _odd_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code files, every ninth one with a last byte that is not UTF-8."""
    broken = F.concat("content", F.unhex(F.lit("FF")))
    return code_files(spark, sf_dir).withColumn("content", F.when(_number() % 9 == 4, broken).otherwise(F.col("content")))


@query
def valid_text_only(spark, sf_dir):
    return with_text(_odd_bytes(spark, sf_dir)).select("repo", "path", "canon_ext", F.octet_length("text").alias("bytes"))


@query
def line_counts_any_bytes(spark, sf_dir):
    return _odd_bytes(spark, sf_dir).select("repo", "path", tx.count_lines(F.col("content")).alias("lines"))


@query
def newer_unknown_times(spark, sf_dir):
    unknown = F.coalesce(_number() % 6 == 2, F.lit(False))
    files = repository_files(spark, sf_dir).withColumn("mtime", F.when(~unknown, F.col("mtime")))
    return _listing(tree.list_nodes(files, newer=NEWER, older=OLDER))


@query
def empty_directories(spark, sf_dir):
    """Directories without files: listed unless a rule leaves them or one above out."""
    files = repository_files(spark, sf_dir)
    named = F.explode(F.array(*[F.lit(p) for p in ("void", "void/deep", "void/m2", "void/m2/x", ".git/void")]))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.select(F.col("source").alias("repo")).distinct().select(
        "repo", named.alias("path"), F.lit(0).cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("mtime"),
        F.lit(False).alias("is_symlink"), F.lit(True).alias("is_dir"), F.lit(None).cast("binary").alias("content"),
    )
    nodes = tree.list_nodes(files.unionByName(empty), rules=ignore.read_ignore_rules(files))
    return _listing(nodes.where("path LIKE '%void%'"))


@query
def filters_combined(spark, sf_dir):
    files = repository_files(spark, sf_dir)
    rules = ignore.read_ignore_rules(files)
    return _listing(tree.list_nodes(files, rules=rules, newer=NEWER, older=OLDER, max_depth=3))


@query
def tracked_from_tables(spark, sf_dir):
    """Tracked paths from a written index and a written status table."""
    index, status = _index_and_status(spark, sf_dir)
    at = _scratch(spark, "index")
    writers.write_table(index, at + "-index")
    writers.write_table(status, at + "-status")
    return ignore.tracked_paths(tables.read_tracked(spark, at + "-index"), tables.read_status(spark, at + "-status"))


@query
def tracked_from_text(spark, sf_dir):
    """Tracked paths from a printed index and a printed status; names hold whole texts, every third changed one was renamed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = F.concat("path", F.lit("\t"), F.coalesce("text", F.lit("")))
    files = repository_files(spark, sf_dir).select("repo", "path", _number().alias("doc_id")).join(docs, "doc_id").join(labels, "doc_id")
    files = files.withColumn("path", odd)
    code = F.when(F.col("toxic") == 1, printed.NEW).when(F.col("doc_id") % 2 == 0, printed.IGNORED)
    renamed = F.when(code.isNull() & (F.col("doc_id") % 3 == 0), F.concat(F.lit("\0"), "path", F.lit(".old"))).otherwise("")
    letters = F.coalesce(code, F.when(F.col("doc_id") % 3 == 0, "R ").otherwise(" M"))
    at = _scratch(spark, "printed")
    index = files.where("quality = 1").select("repo", quoting.quoted(F.col("path")).alias("value"))
    index.write.partitionBy("repo").option("lineSep", "\n").text(at + "-index")
    status = files.select("repo", F.concat(letters, F.lit(" "), "path", renamed).alias("value"))
    status.write.partitionBy("repo").option("lineSep", "\0").text(at + "-status")
    return ignore.tracked_paths(
        printed.read_printed_index(spark, at + "-index"), printed.read_printed_status(spark, at + "-status", nul=True)
    )


@query
def text_report_places(spark, sf_dir):
    """Where every path's rows lie in its repository's written text report."""
    files = code_files(spark, sf_dir)
    rows = reports.text_report(tree.list_nodes(files), md.with_section_lines(_listed_sections(files)), show_size=True)
    target = _scratch(spark, "documents")
    documents.write_documents(rows, target)
    return documents.path_places(spark, target)


def _long_lines(text: Column, lines: Column, canon_ext: Column) -> Column:
    return F.transform(
        F.filter(lines, lambda s: F.length(tx.trim(s)) > 60),
        lambda s: F.struct(
            F.left(tx.trim(s), F.lit(20)).alias("content"), F.lit("long").alias("style"),
            F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("indent"),
        ),
    )


@query
def own_extractor(spark, sf_dir):
    md.register_extractor("long_lines", _long_lines)
    return md.extract_with(code_files(spark, sf_dir), "long_lines")


def _chosen(sections: md.Sections) -> Query:
    return lambda spark, sf_dir: md.metadata_lines(code_files(spark, sf_dir), sections)


for _name, _wishes in {
    "types": {"types": True}, "todos": {"todos": True}, "imports": {"imports": True, "no_comments": True}, "default": {},
}.items():
    _fn = _chosen(md.select_sections(**_wishes))
    _fn.__name__ = f"metadata_choice_{_name}"
    query(_fn)
