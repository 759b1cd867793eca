"""What the physical plans must look like at scale."""

from __future__ import annotations

import re

import pytest

from srcatlas.operators import metadata as md, stats, tree
from srcatlas.operators.comments import extract_comments
from srcatlas.operators.imports import extract_imports, file_imports
from srcatlas.operators.signatures import extract_signatures
from srcatlas.operators.todos import extract_todos
from srcatlas.sinks.writers import write_table
from srcatlas.sources.tables import read_corpus

EVERY = md.Sections(True, True, True, True)


@pytest.fixture(scope="module")
def corpus(spark, make_files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "corpus")
    write_table(make_files([(f"r{i % 3}", f"a{i % 5}/b/f{i}.rs", f"//! Doc {i}\n// TODO: t\n") for i in range(60)]), path)
    return read_corpus(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


NARROW = {
    "todos": extract_todos,
    "comments": extract_comments,
    "signatures": extract_signatures,
    "imports": extract_imports,
    "file_imports": file_imports,
    "metadata": lambda f: md.metadata_lines(f, EVERY),
    "layout": lambda f: md.block_table(md.with_layout(md.with_section_lines(md.file_sections(f, EVERY)), True, width=40)),
}


@pytest.mark.parametrize("name", NARROW)
def test_extractors_are_narrow_and_native(corpus, name):
    text = plan(NARROW[name](corpus))
    assert "Exchange" not in text and "Python" not in text and "MapInPandas" not in text
    assert text.count("FileScan") == 1


def test_a_named_size_limit_is_pushed_down(spark, corpus):
    assert "LessThanOrEqual(size_bytes,1000000)" in formatted(spark, extract_todos(corpus, max_file_size=1_000_000))
    assert "size_bytes," not in formatted(spark, extract_todos(corpus)).split("PushedFilters")[1].split("\n")[0]


@pytest.mark.parametrize("name", NARROW)
def test_text_is_decoded_once(corpus, name):
    assert plan(NARROW[name](corpus)).count("tryValidateUTF8String") == 1


SHUFFLED = {
    "language_stats": stats.language_stats,
    "totals": stats.codebase_totals,
    "todos_by_marker": lambda f: stats.todos_by_marker(extract_todos(f)),
    "import_usage": lambda f: stats.import_usage(file_imports(f)),
    "rollup": stats.directory_rollup,
    "nodes": tree.list_nodes,
    "last": lambda f: tree.with_last_flag(tree.list_nodes(f)),
}


@pytest.mark.parametrize("name", SHUFFLED)
def test_contents_never_cross_an_exchange(spark, corpus, name):
    df = SHUFFLED[name](corpus)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for block in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", formatted(spark, df)):
        assert not re.search(r"\b(content|text|lines_array)#", block) or "marker" in block


def test_name_queries_do_not_read_contents(spark, corpus):
    for df in (tree.list_nodes(corpus), stats.language_stats(corpus, with_lines=False), stats.directory_rollup(corpus)):
        for schema in re.findall(r"ReadSchema: (\S+)", formatted(spark, df)):
            assert "content" not in schema


def test_large_rule_tables_are_not_broadcast_by_hint(corpus):
    from srcatlas.operators.skew import spread_join

    rows = corpus.select("repo", "path")
    joined = spread_join(rows, corpus.selectExpr("repo", "size_bytes AS v").distinct(), ["repo"], ["path"])
    hints = joined._jdf.queryExecution().analyzed().toString()
    assert hints.count("strategy=broadcast") == 2  # the bounded table of hot keys, on both sides


def test_top_files_take_ordered(corpus):
    assert "TakeOrderedAndProject" in plan(stats.top_files(corpus.select("repo", "path", "size_bytes"), "size_bytes", 5))


def jobs_while(spark, build):
    """Jobs that ran while something was built."""
    context = spark.sparkContext
    group = f"build-{build.__name__}"
    context.setJobGroup(group, "building")
    try:
        build()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_listings_and_reports_are_built_without_jobs(spark, corpus):
    from srcatlas.operators import ignore, reports

    rules = ignore.read_ignore_rules(corpus)

    def listing():
        return tree.list_nodes(corpus, rules=rules, max_depth=2)

    def report():
        lines = md.with_section_lines(tree.listed_files(md.file_sections(corpus, EVERY, every=True), rules=rules))
        return reports.text_report(listing(), lines, full=True)

    def drawing():
        return tree.drawn_nodes(listing())

    assert [jobs_while(spark, b) for b in (listing, report, drawing)] == [0, 0, 0]


def test_reports_read_contents_once_and_join_no_file_with_itself(spark, corpus):
    from srcatlas.operators import reports

    nodes = tree.list_nodes(corpus)
    sections = tree.listed_files(md.file_sections(corpus, EVERY, every=True))
    lines = md.with_section_lines(sections)
    for df in (reports.text_report(nodes, lines, full=True), reports.markdown_report(nodes, lines, full=True),
               reports.json_records(nodes, sections), reports.json_tree(nodes, sections)):
        assert sum("content" in schema for schema in re.findall(r"ReadSchema: (\S+)", formatted(spark, df))) == 1
    assert "Join" not in plan(reports.json_records(nodes, sections))
    assert "Exchange" not in plan(reports.json_records(nodes, sections))


def test_files_never_meet_rules_once_per_level(spark, corpus):
    from srcatlas.operators import ignore

    rules = ignore.read_ignore_rules(corpus)
    plain, _ = ignore.included(corpus.select(*tree.PLAIN_COLUMNS), rules)
    # Ancestors are spelled out for directories only: file rows keep their number up to the join.
    assert "size_bytes" not in "".join(re.findall(r"Generate[^\n]*", plan(plain)))
