"""Reports written as documents: order, places, replacement and broken tasks."""

from __future__ import annotations

import json

import pytest
from report_helpers import report_text

from srcatlas.operators import metadata as md, reports, tree
from srcatlas.sinks import documents


@pytest.fixture(scope="module")
def nodes_and_sections(spark, make_files):
    files = make_files([(f"r{i % 3}", f"d{i % 7}/e{i % 4}/ü {i}.rs", f"//! Doc {i} é\n// TODO: t{i}\n") for i in range(150)] + [
        ("r0", "d1.rs", "//! Next to a directory\n"), ("lone", "only.py", "x = 1\n")])
    nodes = tree.list_nodes(files)
    return nodes, md.file_sections(files, md.select_sections(), every=True)


def whole(spark, target, repo, path=""):
    return b"".join(documents.read_document(spark, target, repo, path)).decode()


def test_text_document_and_its_directories(spark, nodes_and_sections, tmp_path):
    nodes, sections = nodes_and_sections
    rows = reports.text_report(nodes, md.with_section_lines(tree.listed_files(sections)))
    target = str(tmp_path / "text")
    documents.write_documents(rows, target)
    for repo in ("r0", "r1", "r2", "lone"):
        assert whole(spark, target, repo) == report_text(rows, repo) + "\n"
    lines = report_text(rows, "r0").split("\n")
    part = whole(spark, target, "r0", "d1").rstrip("\n").split("\n")
    first = lines.index(part[0])
    assert lines[first : first + len(part)] == part and part[0].endswith(" d1")
    assert sum(".rs" in s for s in part) == sum(1 for i in range(150) if i % 3 == 0 and i % 7 == 1)
    assert "Next to a directory" in whole(spark, target, "r0", "d1.rs")
    assert whole(spark, target, "r0", "d") == "" == whole(spark, target, "nowhere")


def test_json_document_is_one_value(spark, nodes_and_sections, tmp_path):
    nodes, sections = nodes_and_sections
    rows = reports.json_tree(nodes, sections)
    target = str(tmp_path / "json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_documents(rows, target)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({name for name, _, _ in documents.document_ranges(spark, target, "r0")}) >= 1
    assert documents.places(spark, target).select("part").distinct().count() > 1
    found = json.loads(whole(spark, target, "r0"))
    assert found["type"] == "dir" and {c["name"] for c in found["children"]} == {f"d{i}" for i in range(7)} | {"d1.rs"}
    inner = json.loads(whole(spark, target, "r0", "d3/e3").lstrip(","))
    assert inner["path"] == "d3/e3" and all(c["path"].startswith("d3/e3/") for c in inner["children"])


def test_written_again_replaces_at_once(spark, nodes_and_sections, tmp_path):
    nodes, _ = nodes_and_sections
    target = str(tmp_path / "again")
    rows = reports.markdown_report(nodes)
    documents.write_documents(rows, target)
    before = whole(spark, target, "r1")
    broken = rows.selectExpr("repo", "path", "sort_key", "seq", "if(path = '' AND seq = 0, raise_error('lost'), text) AS text")
    with pytest.raises(Exception, match="lost"):
        documents.write_documents(broken, target)
    assert whole(spark, target, "r1") == before
    documents.write_documents(rows.where("repo <> 'r1'"), target)
    assert whole(spark, target, "r1") == "" and whole(spark, target, "r2") == report_text(rows, "r2") + "\n"


def test_many_batches_in_a_part(spark, tmp_path):
    """Rows of one path over several batches, null texts, and offsets beyond the first batch."""
    rows = spark.range(30_000).selectExpr(
        "'r' AS repo", "if(id < 25000, 'a', 'b') AS path",
        "array(named_struct('o', 0, 'p', if(id < 25000, 'a', 'b'))) AS sort_key", "CAST(id AS INT) AS seq",
        "if(id % 1000 = 7, NULL, concat('é', id)) AS text")
    target = str(tmp_path / "many")
    documents.write_documents(rows, target)
    want = ["" if i % 1000 == 7 else f"é{i}" for i in range(30_000)]
    assert whole(spark, target, "r", "b").split("\n")[:-1] == want[25_000:]
    places = {r.path: (r.first_byte, r.bytes) for r in documents.path_places(spark, target).collect()}
    size = len("".join(s + "\n" for s in want[:25_000]).encode())
    assert places["a"] == (0, size) and places["b"][0] == size


def test_no_rows_and_no_documents(spark, tmp_path):
    rows = spark.createDataFrame([], "repo string, path string, sort_key array<struct<o int, p string>>, seq int, text string")
    target = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        documents.places(spark, target)
    documents.write_documents(rows, target)
    assert documents.places(spark, target).count() == 0 and whole(spark, target, "r") == ""
