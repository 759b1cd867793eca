"""Files as they arrive, by a stream reader that sees every name.

Each look at the folder is a listing of the files that are new or have another size or time than before; it is written to a log
before its number is given out as an offset. A batch reads what the log says for its offsets, so that a batch run again reads
the same files, and a query that was stopped goes on where its offsets say, without a loss or a repeat.

Names with a leading dot or underscore are files like all others; links are neither listed nor followed and ``.git`` is left out. A file
that goes between listing and reading is left out; one that changes is read as it is and listed again. As with
Spark's own file source the listing is made on the driver, which remembers the files seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from srcatlas.operators.filters import GIT_DIR
from srcatlas.schema import FILES
from srcatlas.sources.dirscan import _children
from srcatlas.sources.stores import file_system

FORMAT = "arriving_files"
#: Files and bytes that one task reads.
TASK_FILES = 500
TASK_BYTES = 64 << 20


class Listed(InputPartition):
    """Files of one task: (path, size, time in microseconds)."""

    def __init__(self, files: list[list]):
        self.files = files


class ArrivingFiles(DataSource):
    """Options: ``path`` of the folder, ``repo`` it is, ``log`` folder of the listings, one for each query."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return FILES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArrivalReader(self.options["path"], self.options["repo"], self.options["log"])


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, root: str, repo: str, log: str):
        self.root, self.repo, self.log = root, repo, log
        self.number = 0
        self.seen: dict[str, list] | None = None

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self.seen = {}
            self.number = len(self._numbers())
            for listing in self._listings(0, self.number):
                self.seen.update({path: [size, at] for path, size, at in listing})
        new = [[path, size, at] for path, size, at in self._walk() if self.seen.get(path) != [size, at]]
        if new:
            self._write(self.number + 1, new)
            self.number += 1
            self.seen.update({path: [size, at] for path, size, at in new})
        return {"listing": self.number}

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        out: list[Listed] = []
        held = TASK_BYTES
        for listing in self._listings(start["listing"], end["listing"]):
            for entry in listing:
                if held >= TASK_BYTES or len(out[-1].files) >= TASK_FILES:
                    out.append(Listed([]))
                    held = 0
                out[-1].files.append(entry)
                held += entry[1]
        return out

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FILES)
        store, base = file_system(self.root)
        for path, size, at in partition.files:
            try:
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    content = f.read()
            except FileNotFoundError:
                continue
            row = {"repo": self.repo, "path": path, "size_bytes": size, "is_symlink": False, "is_dir": False, "content": content}
            columns = [pa.array([at], pa.timestamp("us", "UTC")) if f.name == "mtime" else pa.array([row[f.name]], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def _walk(self) -> Iterator[tuple[str, int, int]]:
        todo = [""]
        while todo:
            for path, size, at, link, folder, error in _children(self.root, todo.pop()):
                if link or error or path.rpartition("/")[2] == GIT_DIR:
                    continue
                if folder:
                    todo.append(path)
                else:
                    yield path, size, at

    def _numbers(self) -> list[str]:
        store, base = file_system(self.log)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(i.base_name for i in found if i.base_name.endswith(".json"))

    def _listings(self, after: int, up_to: int) -> Iterator[list[list]]:
        store, base = file_system(self.log)
        for number in range(after + 1, up_to + 1):
            with store.open_input_stream(f"{base}/{number:020d}.json") as f:
                yield json.loads(f.read())

    def _write(self, number: int, listing: list[list]) -> None:
        store, base = file_system(self.log)
        store.create_dir(base)
        pending = f"{base}/{uuid.uuid4().hex}.pending"
        with store.open_output_stream(pending) as out:
            out.write(json.dumps(listing).encode())
        store.move(pending, f"{base}/{number:020d}.json")


def stream_arrivals(spark: SparkSession, path: str, repo: str, log: str) -> DataFrame:
    """A stream of the ``files`` rows of a folder, new and changed ones, as they arrive."""
    spark.dataSource.register(ArrivingFiles)
    return spark.readStream.format(FORMAT).option("path", path).option("repo", repo).option("log", log).load()
