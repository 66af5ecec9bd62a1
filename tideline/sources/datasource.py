"""A Python data source for ordered logs kept as JSON lines: batch, and stream by position.

    spark.dataSource.register(JsonLog)
    spark.readStream.format("tideline_log").option("path", folder).option("after", "17").load()

A line has stream_id, model_id, event_type, event_number, global_position, created_on (text)
and payload (text). Files are read by URI; positions are those of the lines, so a stream that
starts again goes on after the last one it committed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, model_id string, event_type string, event_number bigint, global_position bigint, created_on string, payload string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class FileRange(InputPartition):
    """A file, and the positions of it that are wanted: above `low`, up to `high`."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _files(uri: str) -> tuple[object, list[str]]:
    from pyarrow import fs as pafs

    fs, base = pafs.FileSystem.from_uri(uri)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".jsonl"))


def _read(uri: str, part: FileRange) -> Iterator[tuple]:
    from pyarrow import fs as pafs

    fs, _ = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(part.path) as f:
        rest = b""
        while block := f.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from _rows(lines, part)
        yield from _rows([rest], part)


def _rows(lines: list[bytes], part: FileRange) -> Iterator[tuple]:
    for line in lines:
        if line.strip():
            e = json.loads(line)
            if part.low < e["global_position"] <= part.high:
                yield tuple(e.get(n) for n in _NAMES)


class _Batch(DataSourceReader):
    def __init__(self, uri: str, after: int):
        self.uri, self.after = uri, after

    def partitions(self):
        return [FileRange(f, self.after, 1 << 62) for f in _files(self.uri)[1]]

    def read(self, partition):
        return _read(self.uri, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str, after: int):
        self.uri, self.after = uri, after

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        """Newest position: the last line of the newest file, since a log is written in order."""
        fs, files = _files(self.uri)
        for path in reversed(files):
            last = None
            with fs.open_input_stream(path) as f:
                for line in f.read().splitlines():
                    last = line if line.strip() else last
            if last is not None:
                return {"position": json.loads(last)["global_position"]}
        return {"position": self.after}

    def partitions(self, start: dict, end: dict):
        return [FileRange(f, start["position"], end["position"]) for f in _files(self.uri)[1]]

    def read(self, partition):
        return _read(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class JsonLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tideline_log"

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("after", "-1"))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._where())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._where())
