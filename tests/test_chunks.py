"""Files cut anywhere give what whole files give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from srcatlas.functions.text import count_lines
from srcatlas.operators import chunks
from srcatlas.operators.corpus import source_lines
from srcatlas.operators.imports import file_imports
from srcatlas.operators.todos import extract_todos

GO = """package main
import "fmt"
import (
\t"os"
\tlog "github.com/a/b/c/d"

\t"x/internal/y"
)
// TODO: first \r
var s = "no import"
import (
    "net/http"
import (
    "strings"
  )
"late"
// FIXME: wide é 日本 end
import (
  "bufio"
"""

CASES = {
    "a.go": GO,
    "crlf.go": GO.replace("\n", "\r\n"),
    "open.go": 'import (\n"os"',
    "m.py": "import os\r\nfrom .x import y\n# TODO: é ü\n\n\nimport numpy",
    "r.rs": "use std::io;\nuse serde::Serialize;\n// NOTE: one\r",
    "j.js": "import a from 'a';\nconst b = require('./b')\n\r\n",
    "empty.py": "",
    "line.py": "\n",
    "bad.py": b"# TODO: broken \xff\nimport os\n",
    "cut.py": b"import os\n# TODO: cut \xc3",
    "plain.txt": "TODO: x\n\n",
    "long.py": "# TODO: " + "long " * 300 + "\n# HACK: b\n",
}


def cuts(make_files, spark, seed, size):
    """Every case cut at random places, into pieces of up to ``size`` bytes."""
    rng, rows = random.Random(seed), []
    for path, text in CASES.items():
        data, at, seq = text.encode() if isinstance(text, str) else text, 0, 0
        while at < len(data) or not seq:
            step = rng.randint(0 if seq else 1, size)
            rows.append(("r", path, seq * 3, data[at : at + step]))
            at, seq = at + step, seq + 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "repo STRING, path STRING, seq BIGINT, content BINARY").repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def whole(make_files):
    return make_files(CASES)


@pytest.mark.parametrize(("seed", "size"), [(1, 3), (2, 9), (3, 60), (4, 100_000)])
def test_any_cutting(spark, make_files, whole, seed, size):
    cut = cuts(make_files, spark, seed, size)
    want = whole.select("repo", "path", count_lines(F.col("content")).alias("lines"))
    assert rows(chunks.chunk_line_counts(cut), "path", "lines") == rows(want, "path", "lines")
    assert rows(chunks.chunk_todos(cut), "path", "line", "marker", "text") == rows(extract_todos(whole), "path", "line", "marker", "text")
    assert rows(chunks.chunk_source_lines(cut), "path", "line", "content") == rows(source_lines(whole), "path", "line", "content")
    assert rows(chunks.chunk_imports(cut), "path", "imports") == rows(file_imports(whole), "path", "imports")


def test_cut_files(whole):
    cut = chunks.cut_files(whole, 7)
    again = cut.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", F.hex("content").alias("c")))).alias("a"))
    found = {r.path: "".join(c.c for c in r.a) for r in again.collect()}
    assert found == {p: (t.encode() if isinstance(t, str) else t).hex().upper() for p, t in CASES.items()}
    assert cut.agg(F.max(F.octet_length("content"))).first()[0] == 7


def test_contents_cross_no_exchange(spark, whole, tmp_path):
    whole.write.parquet(str(tmp_path / "files"))
    cut = chunks.cut_files(spark.read.parquet(str(tmp_path / "files")), 64)
    plan = chunks.chunk_line_counts(cut)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert "Exchange" in plan and "partial_sum(n" in before


def test_ranges_of_files(spark, whole, tmp_path):
    from srcatlas.sources.dirscan import list_entries
    from srcatlas.sources.ranges import read_chunks

    for path, text in CASES.items():
        (tmp_path / path).write_bytes(text.encode() if isinstance(text, str) else text)
    entries = list_entries(spark.createDataFrame([("r", str(tmp_path))], "repo string, root string"))
    cut = read_chunks(entries, 50)
    assert cut.where("path = 'long.py'").count() > 20
    want = whole.select("repo", "path", count_lines(F.col("content")).alias("lines"))
    assert rows(chunks.chunk_line_counts(cut), "path", "lines") == rows(want, "path", "lines")
    assert rows(chunks.chunk_todos(cut), "path", "line", "marker", "text") == rows(extract_todos(whole), "path", "line", "marker", "text")
