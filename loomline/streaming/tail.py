"""A stream over growing log files: whole lines by byte offsets, resumable, with truncated and replaced files read anew.

Register it with spark.dataSource.register(LogTail), then spark.readStream.format("log_tail").option("path", folder).load().
Options: path, a folder; glob, a pattern of file names ("*"); chunk, most bytes of a file for one task. Rows: file, at (the
line's first byte), line, reset (the file had shrunk or had been replaced since the last batch, and was begun anew).

An offset holds for each file how far whole lines go and a checksum of its first bytes. A line without its end is left for
later, even at the end of the file. A file that is shorter than its offset, or begins with other bytes, is another file. Files are
reached through pyarrow's file systems, from the driver and from tasks, so the folder has to be one that both see. A batch
that is run again after its file has been replaced reads what is there now. Files that vanish are forgotten.
"""

from __future__ import annotations

import zlib
from fnmatch import fnmatchcase

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD, BLOCK, CHUNK = 256, 1 << 16, 1 << 25
SCHEMA = "file string, at long, line string, reset boolean"


class Part(InputPartition):
    """Lines of a file that begin at bytes start to end."""

    def __init__(self, path: str, start: int, end: int, reset: bool):
        self.path, self.start, self.end, self.reset = path, start, end, reset


def _store(path: str):
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _lines_end(store, path: str, size: int) -> int:
    """The byte behind the last end of a line, 0 without one."""
    with store.open_input_file(path) as f:
        to = size
        while to > 0:
            start = max(0, to - BLOCK)
            f.seek(start)
            at = f.read(to - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            to = start
    return 0


def _checksum(store, path: str, n: int) -> int:
    with store.open_input_file(path) as f:
        return zlib.crc32(f.read(n))


class _Files:
    def __init__(self, options: dict):
        self.path, self.glob, self.chunk = options["path"], options.get("glob", "*"), int(options.get("chunk", CHUNK))

    def ends(self) -> dict:
        """The offset up to which whole lines are there now."""
        store, base = _store(self.path)
        found = store.get_file_info(arrow_fs.FileSelector(base, allow_not_found=True))
        out = {}
        for info in found:
            if info.type == arrow_fs.FileType.File and fnmatchcase(info.base_name, self.glob) and info.base_name[:1] not in "._":
                end = _lines_end(store, info.path, info.size)
                head = min(HEAD, end)
                out[info.base_name] = {"end": end, "head": head, "sum": _checksum(store, info.path, head)}
        return {"files": out}

    def parts(self, start: dict, end: dict) -> list[Part]:
        store, base = _store(self.path)
        before, out = start.get("files", {}), []
        for name, to in sorted(end["files"].items()):
            was = before.get(name, {"end": 0, "head": 0, "sum": 0})
            path = f"{base.rstrip('/')}/{name}"
            if store.get_file_info(path).type != arrow_fs.FileType.File:
                continue
            reset = to["end"] < was["end"] or (was["head"] > 0 and _checksum(store, path, was["head"]) != was["sum"])
            at = 0 if reset else was["end"]
            while at < to["end"]:
                out.append(Part(path, at, min(to["end"], at + self.chunk), reset))
                at += self.chunk
        return out

    def lines(self, part: Part):
        """A line belongs to the part in which it begins; what begins before is skipped, and the last line is read to its end."""
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as f:
            at, held = part.start, b""
            if at:
                f.seek(at - 1)
                at, held = at - 1, None  # a line begins here if the byte before ends one
            while True:
                block = f.read(BLOCK)
                if not block:
                    return
                if held is None:
                    cut = block.find(b"\n")
                    if cut < 0:
                        at += len(block)
                        if at >= part.end:
                            return
                        continue
                    at, block, held = at + cut + 1, block[cut + 1 :], b""
                    if at >= part.end:
                        return
                held += block
                *whole, held = held.split(b"\n")
                for line in whole:
                    if at >= part.end:
                        return
                    yield part.path.rsplit("/", 1)[-1], at, line.decode("utf-8", "replace"), part.reset
                    at += len(line) + 1
                if at >= part.end:
                    return


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return WholeReader(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return self.files.ends()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.files.parts(start, end)

    def read(self, partition: Part):
        return self.files.lines(partition)


class WholeReader(DataSourceReader):
    """All whole lines that are there, as a batch."""

    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[Part]:
        return self.files.parts({"files": {}}, self.files.ends())

    def read(self, partition: Part):
        return self.files.lines(partition)
