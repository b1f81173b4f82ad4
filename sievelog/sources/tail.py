"""A streaming source that follows growing files: lines appended to a file arrive once.

The offset is a map of file to place: the bytes up to the last whole line, with a mark, the digest of the bytes just
before that place. A line without its line break waits for it. The map alone says what was read, so nothing else is kept:
what a trigger reads is the difference of two maps.

*Rotation.* A place belongs to the file in which the mark is found there. If the file of that name no longer has it (it
was renamed, or copied and truncated), the file that has it is read on from the place, and what now bears the name is read
from its start. A file whose content is gone before its lines were read is lost; that fails the query unless
``failOnDataLoss`` is false.

A trigger's bytes are cut into splits of ``splitBytes``, one task each, at any byte: a line belongs to the split it starts
in. A task first looks for the mark again, so a file that was rotated after planning fails the task and is found when the
query is restarted, and never mixes with the new content. Triggers are as large as what was appended.

Files are reached through the local or mounted file system, or any store that ``pyarrow.fs`` knows by its address; the
driver lists them and all executors read them.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MARK_BYTES = 256
CHUNK = 4 << 20
SPLIT = 32 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of an address or a plain path."""
    local = re.match(r"file:/+", path)
    if local:
        path = "/" + path[local.end() :]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> dict[str, int]:
    """Sizes of the files at ``path``: a file, a folder's files, or a pattern for names in one folder."""
    files, at = file_system(path)
    folder, name = posixpath.split(at)
    if any(c in name for c in "*?["):
        found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        found = files.get_file_info([at])
        if found[0].type == pafs.FileType.Directory:
            found = [f for f in files.get_file_info(pafs.FileSelector(at)) if f.base_name[0] not in "._"]
    return {f.path: f.size for f in found if f.type == pafs.FileType.File}


def last_break(file, size: int) -> int:
    """Bytes up to and with the last line break among the first ``size``."""
    end = size
    while end:
        start = max(0, end - CHUNK)
        at = file.read_at(end - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def mark(file, at: int) -> str:
    """Digest of the bytes before a place."""
    start = max(0, at - MARK_BYTES)
    return hashlib.sha256(file.read_at(at - start, start)).hexdigest()[:32]


@dataclass
class Split(InputPartition):
    """Lines of a file that start in ``start`` to ``end``; the file has the mark at ``until``."""

    path: str
    first: bool
    start: int
    end: int
    until: int
    mark: str


def lines_of_split(file, split: Split) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Places and texts of the lines that start in a split, in portions."""
    at = split.start if split.first else split.start - 1
    skipping, rest = not split.first, b""
    file.seek(at)
    while at < split.end:
        data = file.read(CHUNK)
        if not data:
            return
        rest += data
        if skipping:
            cut = rest.find(b"\n") + 1
            if not cut:
                at, rest = at + len(rest), b""
                continue
            at, rest, skipping = at + cut, rest[cut:], False
        whole = rest.rfind(b"\n")
        if whole < 0:
            continue
        lines, rest = rest[:whole].split(b"\n"), rest[whole + 1 :]
        places = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
        at = int(places[-1])
        inside = int(np.searchsorted(places[:-1], split.end))
        if inside:
            yield places[:inside], [x.removesuffix(b"\r") for x in lines[:inside]]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        given = {name.lower(): value for name, value in options.items()}
        self.path = given["path"]
        self.from_end = given.get("fromend", "false").lower() == "true"
        self.split_bytes = int(given.get("splitbytes", SPLIT))
        self.strict = given.get("failondataloss", "true").lower() == "true"

    def initialOffset(self) -> dict:
        return self._now() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._now()

    def _now(self) -> dict:
        files, _ = file_system(self.path)
        out = {}
        for path, size in sorted(listed(self.path).items()):
            try:
                with files.open_input_file(path) as file:
                    at = last_break(file, size)
                    out[path] = {"at": at, "mark": mark(file, at)}
            except FileNotFoundError:  # went between listing and opening
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Split]:
        sizes, held = listed(self.path), {}
        files, _ = file_system(self.path)

        def has(path: str, place: dict) -> bool:
            """Whether the file has the mark of a place."""
            if place["at"] > sizes.get(path, -1):
                return False
            if path not in held:
                held[path] = files.open_input_file(path)
            return mark(held[path], place["at"]) == place["mark"]

        def owner(path: str, place: dict, taken: set[str]) -> str | None:
            if has(path, place):
                return path
            return next((p for p in sorted(sizes) if p not in taken and place["at"] and has(p, place)), None)

        try:
            # what is to be read is where it now lies, which a replay may find elsewhere than the first run
            to: dict[str, dict] = {}
            for path, place in end.items():
                if has(path, place):
                    to[path] = place
            for path, place in end.items():
                if place["at"] and not has(path, place) and start.get(path) != place:
                    found = owner(path, place, set(to))
                    if found is not None:
                        to[found] = place
                    elif self.strict:
                        raise RuntimeError(f"lines of {path} up to byte {place['at']} are gone before they were read")
            done: dict[str, int] = {}
            moved = []
            for path, place in start.items():
                if path in to and place["at"] <= to[path]["at"] and has(path, place):
                    done[path] = place["at"]
                else:
                    moved.append(place)
            for place in moved:
                new = (p for p in to if p not in done and place["at"] and place["at"] <= to[p]["at"] and has(p, place))
                found = next(new, None)
                if found is not None:
                    done[found] = place["at"]
            out = []
            for path, place in to.items():
                first, until = done.get(path, 0), place["at"]
                for a in range(first, until, self.split_bytes):
                    out.append(Split(path, a == first, a, min(a + self.split_bytes, until), until, place["mark"]))
            return out
        finally:
            for file in held.values():
                file.close()

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.path)
        with files.open_input_file(partition.path) as file:
            if mark(file, partition.until) != partition.mark:
                raise RuntimeError(f"{partition.path} was replaced while it was read; restart the query")
            for places, lines in lines_of_split(file, partition):
                columns = [[partition.path] * len(lines), places, lines]
                kinds = [pa.string(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "at", "value"])


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(path)``, after :func:`sievelog.sources.readers.follow_files` registered it."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at bigint, value binary"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
