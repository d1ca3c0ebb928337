"""A streaming source of the lines that are appended to files, each once, with byte offsets as its state.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", folder).load()
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes before an offset that must still be there, and bytes that one task reads.
SEEN, SPLIT = 4096, 64 << 20


class Range(InputPartition):
    def __init__(self, file: str, first: str, start: int, end: int):
        self.file, self.first, self.start, self.end = file, first, start, end


class TailSource(DataSource):
    """Options: path (a folder or file of any filesystem that pyarrow knows), suffix (default: any), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, first string, pos bigint, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("split", SPLIT)))


class TailReader(DataSourceStreamReader):
    """Complete lines in the order in which they stand in a file: (file, first, pos, line).

    pos is the byte at which a line begins, which orders a file's lines; first is a digest of the file's first line. The offset
    of a file is the byte after its last line feed, so that a line without one waits until it is complete. If the bytes before the
    known offset are no longer there, or the first line is another, the file was replaced or cut, and is read from its beginning.
    A file that vanishes yields nothing. What a restart reads follows from the two offsets alone.
    """

    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, found = _files(self.path, self.suffix)
        out = {}
        for name, size in found:
            with fs.open_input_file(name) as f:
                at = _complete(f, size)
                if at:
                    out[name] = [at, _first(f), _before(f, at)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        fs, _ = _filesystem(self.path)
        out = []
        for name, (at, first, _) in sorted(end.items()):
            begin, known, seen = start.get(name, [0, first, ""])
            if begin and begin <= at:
                with fs.open_input_file(name) as f:
                    begin = begin if known == first and _before(f, begin) == seen else 0
            elif begin:
                begin = 0
            out += [Range(name, first, s, min(s + self.split, at)) for s in range(begin, at, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that begin within the range; the one at its end is read beyond it."""
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            pos = partition.start
            if pos:  # a line that began before belongs to the range before
                f.seek(pos - 1)
                pos += len(_line(f)) - 1
            f.seek(pos)
            rest, at = b"", pos
            while at < partition.end:
                chunk = f.read(1 << 20)
                if not chunk:
                    break
                rest += chunk
                while at < partition.end and (cut := rest.find(b"\n")) >= 0:
                    line, rest = rest[: cut + 1], rest[cut + 1 :]
                    yield partition.file, partition.first, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                    at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _files(path: str, suffix: str):
    from pyarrow import fs

    system, at = _filesystem(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    plain = [x for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not x.base_name.startswith((".", "_"))]
    return system, sorted((x.path, x.size) for x in plain)


def _line(f) -> bytes:
    """Bytes from here to the next line feed, which counts."""
    out = b""
    while chunk := f.read(1 << 16):
        cut = chunk.find(b"\n")
        if cut >= 0:
            return out + chunk[: cut + 1]
        out += chunk
    return out


def _complete(f, size: int) -> int:
    """The byte after the last line feed."""
    end = size
    while end:
        start = max(0, end - (1 << 16))
        f.seek(start)
        cut = f.read(end - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


def _first(f) -> str:
    f.seek(0)
    return hashlib.md5(_line(f)).hexdigest()


def _before(f, at: int) -> str:
    f.seek(max(0, at - SEEN))
    return hashlib.md5(f.read(min(at, SEEN))).hexdigest()
