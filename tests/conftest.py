from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from srcatlas.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "srcatlas-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Build a ``files`` table from {path: text or bytes} or (repo, path, content) rows."""
    import datetime as dt

    from srcatlas.schema import FILES

    def build(entries, repo="r", mtimes=None, links=(), dirs=()):
        rows = []
        items = entries.items() if isinstance(entries, dict) else entries
        for item in items:
            r, path, content = item if len(item) == 3 else (repo, *item)
            data = content.encode() if isinstance(content, str) else content
            mtime = (mtimes or {}).get(path, dt.datetime(2024, 1, 1))
            rows.append((r, path, len(data), mtime, path in links, False, data))
        for path in dirs:
            rows.append((repo, path, 0, None, False, True, None))
        return spark.createDataFrame(rows, FILES)

    return build
