"""A streaming source of lines that follows growing files: offsets are bytes, rotation is told by a fingerprint."""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

PRINT = 256


def fingerprint(path: str, width: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(width)).hexdigest()


def advance(path: str, seen: dict | None, most: int) -> tuple[list[tuple[int, str]], dict]:
    """Complete lines after what was seen, with their byte offsets, and the new state of the file.

    A file that is shorter than what was read of it, or begins otherwise, was replaced and starts again at 0.
    """
    at, width, mark = (seen["at"], seen["width"], seen["mark"]) if seen else (0, 0, "")
    if os.path.getsize(path) < at or (width and fingerprint(path, width) != mark):
        at = 0
    out = []
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(most)
    end = data.rfind(b"\n") + 1
    if not end and len(data) == most:  # a line longer than all that may be read: taken as it is, else it would stop the file
        end = len(data)
    begin = at
    for line in data[:end].split(b"\n")[: None if end and data[end - 1 : end] != b"\n" else -1]:
        out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at = min(at + len(line) + 1, begin + end)
    width = min(PRINT, at)
    return out, {"from": begin, "at": at, "width": width, "mark": fingerprint(path, width) if width else ""}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern, self.most = options["path"], int(options.get("maxBytesPerFile", 1 << 24))
        self.from_end = options.get("start", "beginning") == "end"

    def files(self) -> list[str]:
        return sorted(p for p in glob.glob(self.pattern) if os.path.isfile(p))

    def initialOffset(self) -> dict:
        if not self.from_end:
            return {}
        found = {}
        for p in self.files():
            size = os.path.getsize(p)
            width = min(PRINT, size)
            found[p] = {"from": size, "at": size, "width": width, "mark": fingerprint(p, width) if width else ""}
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for p in self.files():
            lines, end[p] = advance(p, start.get(p), self.most)
            rows += [(p, at, line) for at, line in lines]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for p, last in end.items():
            # Where the reading began says whether the file had been replaced.
            begin = last["from"] if last != start.get(p) else last["at"]
            if os.path.exists(p):
                lines, _ = advance(p, {"at": begin, "width": 0, "mark": ""}, max(0, last["at"] - begin))
                yield from ((p, at, line) for at, line in lines)


class Tail(DataSource):
    """spark.dataSource.register(Tail); spark.readStream.format("tail").option("path", glob).load()"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "stream string, ord bigint, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)
