"""Every name arrives once, also where a query is stopped."""

from __future__ import annotations

import os

import pytest

from srcatlas.sources.arrivals import ArrivalReader, stream_arrivals
from srcatlas.streaming import commits, jobs


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "src"
    (src / ".hidden" / "_deep").mkdir(parents=True)
    (src / ".git").mkdir()
    for path, text in {".gitignore": "*.o\n", "_x.py": "# TODO: x\n", ".hidden/_deep/y.rs": "// TODO: y\n", "a b é.go": "", ".git/config": "no"}.items():
        (src / path).write_text(text)
    os.symlink(src / "_x.py", src / "link.py")
    os.symlink(src, src / "loop")
    return src


def test_every_name_and_only_once(spark, folder, tmp_path):
    seen = []

    def run(consume=lambda df, i: seen.extend((r.path, bytes(r.content).decode()) for r in df.collect())):
        files = stream_arrivals(spark, str(folder), "r", str(tmp_path / "log"))
        query = files.writeStream.foreachBatch(consume).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()

    run()
    assert sorted(seen) == [(".gitignore", "*.o\n"), (".hidden/_deep/y.rs", "// TODO: y\n"), ("_x.py", "# TODO: x\n"), ("a b é.go", "")]
    seen.clear()
    run()
    assert seen == []
    (folder / "new.py").write_text("1\n")
    (folder / "_x.py").write_text("# TODO: other\n")

    def stopped(df, i):
        df.collect()
        (folder / "later.py").write_text("2\n")
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        run(stopped)
    run()
    run()
    assert sorted(seen) == [("_x.py", "# TODO: other\n"), ("later.py", "2\n"), ("new.py", "1\n")]


def test_listings_are_replayed(folder, tmp_path):
    reader = ArrivalReader(str(folder), "r", str(tmp_path / "log"))
    assert reader.latestOffset() == {"listing": 1} == reader.latestOffset()
    (folder / "z.rs").write_text("z")
    # A listing that was written, but whose number was never given out, is found by the next reader.
    second = ArrivalReader(str(folder), "r", str(tmp_path / "log"))
    assert second.latestOffset() == {"listing": 2}
    third = ArrivalReader(str(folder), "r", str(tmp_path / "log"))
    assert third.latestOffset() == {"listing": 2}
    files = lambda a, b: sorted(f[0] for p in third.partitions({"listing": a}, {"listing": b}) for f in p.files)
    assert files(1, 2) == ["z.rs"] and len(files(0, 1)) == 4 and files(2, 2) == []
    os.remove(folder / "z.rs")
    assert [list(third.read(p)) for p in third.partitions({"listing": 1}, {"listing": 2})] == [[]]


def test_counts_over_arrivals(spark, folder, tmp_path):
    target = str(tmp_path / "out")

    def counts():
        files = stream_arrivals(spark, str(folder), "r", str(tmp_path / "log"))
        jobs.start_file_counts(files, target, target + "-cp", "ext").awaitTermination()
        return {r.ext: (r.files, r.lines) for r in commits.read_last(spark, target).collect()}

    assert counts() == {"": (1, 1), "py": (1, 1), "rs": (1, 1), "go": (1, 0)}
    (folder / "_x.py").write_text("1\n2\n3\n")
    assert counts() == {"": (1, 1), "py": (1, 3), "rs": (1, 1), "go": (1, 0)}
