"""Scan of a tar archive (plain or zstd) with nodes.jsonl and edges.jsonl, as a Python data source.

A plain archive is read in byte ranges, one of several zstd frames that tell their sizes in ranges of frames: the driver goes from
frame to frame and from member to member by their headers alone, tasks decompress their own frames and read lines on
across the border. An archive of one frame (what plain ``zstd`` writes), or of frames without sizes, is one task's work; its rows
can be stored once and are read in parallel from then on.
"""

from __future__ import annotations

import io
import tarfile
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.sources.package import ship

MEMBERS = ("nodes.jsonl", "edges.jsonl")
#: Unpacked bytes a task is meant to read.
SPLIT_BYTES = 64 << 20
ZSTD, SKIPPABLE = b"\x28\xb5\x2f\xfd", 0x184D2A50


def opened(path: str):
    """A readable file by any URI that Arrow knows (file, hdfs, s3, gs, ...) or by a path that every machine sees."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def frames(raw) -> list[tuple[int, int | None]]:
    """(where it begins, unpacked size or None) of each zstd frame, by headers of frames and blocks; no block is read."""
    out, at, end = [], 0, raw.size()
    while at < end:
        raw.seek(at)
        head = raw.read(18)
        magic = int.from_bytes(head[:4], "little")
        if magic & ~0xF == SKIPPABLE:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if head[:4] != ZSTD:
            raise ValueError(f"no zstd frame at byte {at}")
        flags = head[4]
        single, checked = flags >> 5 & 1, flags >> 2 & 1
        place = 5 + (not single) + (0, 1, 2, 4)[flags & 3]
        width = (1 if single else 0, 2, 4, 8)[flags >> 6]
        size = int.from_bytes(head[place : place + width], "little") + (256 if width == 2 else 0) if width else None
        out.append((at, size))
        at += place + width
        last = False
        while not last:
            raw.seek(at)
            block = int.from_bytes(raw.read(3), "little")
            last, kind = bool(block & 1), block >> 1 & 3
            at += 3 + (1 if kind == 1 else block >> 3)
        at += 4 * checked
    return out


class Unpacked(io.RawIOBase):
    """The unpacked bytes of a zstd file whose frames tell their sizes, with seek."""

    def __init__(self, raw, known: list[tuple[int, int]]):
        import zstandard

        self.raw, self.tool, self.places = raw, zstandard.ZstdDecompressor(), [p for p, _ in known]
        self.starts = [0]
        for _, size in known:
            self.starts.append(self.starts[-1] + size)
        self.at, self.flow, self.flow_at = 0, None, -1

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.starts[-1])[whence]
        return self.at

    def readinto(self, into) -> int:
        if self.at >= self.starts[-1]:
            return 0
        if self.flow is None or self.at < self.flow_at or self.at >= self.starts[bisect_right(self.starts, self.flow_at)]:
            i = bisect_right(self.starts, self.at) - 1
            self.raw.seek(self.places[i])
            self.flow, self.flow_at = self.tool.stream_reader(self.raw, read_across_frames=True, closefd=False), self.starts[i]
        while self.flow_at < self.at:
            self.flow_at += len(self.flow.read(min(1 << 20, self.at - self.flow_at)))
        got = self.flow.read(len(into))
        into[: len(got)] = got
        self.at = self.flow_at = self.flow_at + len(got)
        return len(got)


def layout(path: str, split_bytes: int = SPLIT_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], list[tuple[int, int]]] | None:
    """(members with their unpacked range, frames, ranges of unpacked bytes for the tasks), or None for an archive that cannot
    be split."""
    with opened(path) as raw:
        zipped = raw.read(4) == ZSTD
        known = frames(raw) if zipped else []
        if zipped and (len(known) < 2 or any(size is None for _, size in known)):
            return None
        raw.seek(0)
        plain = io.BufferedReader(Unpacked(raw, known), 1 << 16) if zipped else raw
        with tarfile.open(fileobj=plain, mode="r:") as tar:
            own = [(m.name, m.offset_data, m.offset_data + m.size) for m in tar if m.isfile() and m.name in MEMBERS]
        size = sum(s for _, s in known) if zipped else raw.size()
        borders, at = [0], 0
        for step in [s for _, s in known] if zipped else [split_bytes] * (size // split_bytes):
            at += step
            if at - borders[-1] >= split_bytes:
                borders.append(at)
        if borders[-1] < size:
            borders.append(size)
    ranges = [(a, b) for a, b in zip(borders, borders[1:]) if any(a < end and b > start for _, start, end in own)]
    return own, known, ranges


def lines_between(path: str, own: list[tuple[str, int, int]], known: list[tuple[int, int]], first: int, last: int) -> Iterator[tuple[str, str]]:
    """(member, line) of the non-blank lines that begin behind ``first``, up to ``last``: a line that begins right at the border
    belongs to what is before it, but a member's first line to where it lies."""
    with opened(path) as raw:
        plain = io.BufferedReader(Unpacked(raw, known) if known else raw, 1 << 20)
        for name, start, end in own:
            at = max(first, start)
            if at >= min(last, end):
                continue
            plain.seek(at)
            if at > start:
                at += len(plain.readline(end - at))
            while at < end and at <= last:
                line = plain.readline(end - at)
                at += len(line)
                text = line.decode("utf-8")
                if text.strip():
                    yield name, text.rstrip("\n")


def members(path: str) -> Iterator[tuple[str, str]]:
    """(member, line) of every non-blank line of the two members, unpacked from the beginning."""
    with opened(path) as raw:
        stream: object = raw
        zipped = raw.read(4) == ZSTD
        raw.seek(0)
        if zipped:
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for m in tar:
                if m.isfile() and m.name in MEMBERS:
                    for line in tar.extractfile(m):
                        text = line.decode("utf-8")
                        if text.strip():
                            yield m.name, text.rstrip("\n")


def write_archive(path: str, parts: dict[str, list[str]], level: int = 3, frame_bytes: int | None = None, zipped: bool = True) -> None:
    """A small archive; ``frame_bytes`` cuts it into frames of so many unpacked bytes."""
    import zstandard
    from pyarrow import fs

    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tar:
        for name, rows in parts.items():
            data = "".join(r + "\n" for r in rows).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    whole = buf.getvalue()
    step = frame_bytes or max(1, len(whole))
    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(name, compression=None) as f:
        for a in range(0, len(whole), step):
            f.write(zstandard.ZstdCompressor(level=level).compress(whole[a : a + step]) if zipped else whole[a : a + step])


@dataclass
class _Range(InputPartition):
    own: list[tuple[str, int, int]]
    known: list[tuple[int, int]]
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        found = layout(self.path, self.split_bytes)
        if found is None:
            return [InputPartition(0)]
        own, known, ranges = found
        return [_Range(own, known, a, b) for a, b in ranges] or [_Range(own, known, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        if isinstance(partition, _Range):
            yield from lines_between(self.path, partition.own, partition.known, partition.first, partition.last)
        else:
            yield from members(self.path)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_archive"

    def schema(self) -> str:
        return "member string, value string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
