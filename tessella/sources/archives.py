"""A data source for zipped, headerless, delimited tables: read in bundles of archive members, line by line, in batch or as a stream."""

from __future__ import annotations

import datetime as dt
import fnmatch
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Fields of the schema that no member has: the archive's file name, and a line that could not be read.
ARCHIVE, CORRUPT = "_archive", "_corrupt_record"
#: Unpacked bytes that a partition reads, about; longest line; lines that a task hands on at once; archives opened at a time when planning.
BUNDLE_BYTES, LINE_BYTES, BATCH_LINES, PLANNERS = 128 << 20, 1 << 20, 4_096, 16


@dataclass
class Bundle(InputPartition):
    """Members, as (archive, member), that one task reads; a member of None stands for an archive that can't be opened."""

    members: list[tuple[str, str | None]]


def archives(path: str, after: str = "", upto: str | None = None) -> list[str]:
    """Archives of a folder, of a pattern in it, or the one at the path, by file name; of names after one and up to another."""
    files, place = fs.FileSystem.from_uri(path)
    folder, name = posixpath.split(place.rstrip("/"))
    if not set(name) & set("*?["):
        if files.get_file_info(place).type == fs.FileType.File:
            found = [place]
        else:
            folder, name = place, "*.zip"
            found = None
    else:
        found = None
    if found is None:
        infos = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = [i.path for i in infos if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, name)]
    return sorted((p for p in found if posixpath.basename(p) > after and (upto is None or posixpath.basename(p) <= upto)), key=lambda p: (posixpath.basename(p), p))


def bundles(path: str, places: list[str], size: int) -> list[Bundle]:
    """The members of all archives, in order, as many together as have that size; only the archives' directories are read."""
    files, _ = fs.FileSystem.from_uri(path)

    def members(place: str) -> list[tuple[str, str | None, int]]:
        try:
            with files.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                return [(place, m.filename, m.file_size) for m in z.infolist() if not m.is_dir()]
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter from seeking in files shorter than any archive
            return [(place, None, 0)]

    with ThreadPoolExecutor(PLANNERS) as pool:
        found = [m for part in pool.map(members, places) for m in part]
    out, held = [], 0
    for place, member, n in found:
        if not out or held + n > size:
            out.append(Bundle([]))
            held = 0
        out[-1].members.append((place, member))
        held += n
    return out


def lines(member: IO[bytes], most: int) -> Iterator[tuple[str, bool]]:
    """(line, whole) without its end; of one that is longer than most the beginning. At most one line is held."""
    while line := member.readline(most + 1):
        whole = len(line) <= most or line.endswith(b"\n")
        if not whole:
            while (rest := member.readline(most)) and not rest.endswith(b"\n"):
                pass
        yield line.rstrip(b"\r\n").decode("utf-8", "replace"), whole


def _flag(text: str) -> bool:
    return {"true": True, "1": True, "false": False, "0": False}[text.lower()]


CONVERT: dict[type, Callable] = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.ShortType: int, T.DoubleType: float, T.FloatType: float, T.BooleanType: _flag, T.DateType: dt.date.fromisoformat}
WHOLE = {T.LongType: 63, T.IntegerType: 31, T.ShortType: 15}


class Table:
    """How lines become rows of the schema. Empty fields are null; a line with too few fields or a value of another type is bad."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.sep, self.mode = options.get("sep", "\t"), options.get("mode", "PERMISSIVE" if CORRUPT in schema.names else "DROPMALFORMED").upper()
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"unknown mode {self.mode}")
        own = [f for f in schema.fields if f.name not in (ARCHIVE, CORRUPT)]
        places = [int(i) for i in options["columns"].split(",")] if "columns" in options else list(range(len(own)))
        if len(places) != len(own):
            raise ValueError(f"{len(places)} columns for {len(own)} fields")
        if unknown := [f.name for f in own if type(f.dataType) not in CONVERT]:
            raise ValueError(f"fields of types that a line can't hold: {unknown}")
        self.fields = [(f.name, i, CONVERT[type(f.dataType)], WHOLE.get(type(f.dataType))) for f, i in zip(own, places, strict=True)]
        self.width = max(places, default=-1) + 1
        self.most = int(options.get("maxlinebytes", LINE_BYTES))

    def values(self, line: str, whole: bool) -> dict | None:
        parts = line.split(self.sep)
        if not whole or len(parts) < self.width:
            return None
        row = {}
        for name, i, convert, bits in self.fields:
            try:
                row[name] = convert(parts[i]) if parts[i] != "" else None
            except (ValueError, KeyError):
                return None
            if bits and row[name] is not None and not -(1 << bits) <= row[name] < 1 << bits:
                return None
        return row

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        shape, rows = to_arrow_schema(self.schema), []
        for place, member in bundle.members:
            for line, whole in self._lines(files, place, member):
                if not line and whole:
                    continue
                row = self.values(line, whole)
                if row is None:
                    if self.mode == "FAILFAST":
                        raise ValueError(f"bad line in {member} of {place}: {line[:200]}")
                    if self.mode == "DROPMALFORMED":
                        continue
                    row = {CORRUPT: line}
                rows.append(row | {ARCHIVE: posixpath.basename(place)})
                if len(rows) >= BATCH_LINES:
                    yield batch(rows, shape)
                    rows = []
        if rows:
            yield batch(rows, shape)

    def _lines(self, files: fs.FileSystem, place: str, member: str | None) -> Iterator[tuple[str, bool]]:
        if member is None:
            yield "not an archive", False
            return
        try:
            with files.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open(member) as m:
                yield from lines(m, self.most)
        except (zipfile.BadZipFile, zlib.error, EOFError) as e:
            yield f"{member}: {e}", False


def batch(rows: list[dict], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in shape], schema=shape)


def plain(options: dict[str, str]) -> dict[str, str]:
    """Options by lower-case names, as Spark takes them in any case."""
    return {k.lower(): v for k, v in options.items()}


class ZippedTables(DataSource):
    """Format `zipped_tables`: members of zip archives as rows of the given schema.

    Options: path (an archive, a folder of them or a pattern, at any place that Arrow's file systems read), sep (a tab), columns (the
    places of the schema's fields in a line, from 0; the first ones), mode as for CSV (PERMISSIVE if the schema has
    `_corrupt_record`, which then holds a bad line, so counting it counts them; else DROPMALFORMED; or FAILFAST), after and upto (file names
    between which archives are read), bundleBytes, maxLineBytes. A field `_archive` holds the archive's file name. Only the
    named columns are parsed. Lines are unpacked as they are read, so a task holds a batch of them however large the member;
    a longer line than maxLineBytes, an archive that can't be opened and the rest of a damaged member are bad lines. As a stream the offset is the greatest file name that was
    read, so archives must come in the order of their names, as those named after a time do.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_tables"

    def schema(self) -> str:
        raise ValueError("give a schema: members have no header")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZippedReader(schema, plain(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ZippedStream(schema, plain(self.options))


class ZippedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.options, self.table = options, Table(schema, options)

    def partitions(self) -> list[Bundle]:
        found = archives(self.options["path"], self.options.get("after", ""), self.options.get("upto"))
        return bundles(self.options["path"], found, int(self.options.get("bundlebytes", BUNDLE_BYTES))) or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        return self.table.read(partition)


class ZippedStream(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.options, self.table = options, Table(schema, options)

    def initialOffset(self) -> dict:
        return {"name": self.options.get("after", "")}

    def latestOffset(self) -> dict:
        names = [posixpath.basename(p) for p in archives(self.options["path"], upto=self.options.get("upto"))]
        return {"name": max([self.options.get("after", ""), *names])}

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        found = archives(self.options["path"], start["name"], end["name"])
        return bundles(self.options["path"], found, int(self.options.get("bundlebytes", BUNDLE_BYTES)))

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        return self.table.read(partition)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedTables)
