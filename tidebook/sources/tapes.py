"""Vendor tapes as a Spark data source: a manifest says which files there are, for which root and date.

Spark reads ``spark.read.format("tidebook_tape")`` in partitions of (file, range of bytes). Filters on root and date reach the manifest, so files that
they leave out are never opened. As a stream, the source goes on where the manifest had ended: its offset is a number of entries.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition

#: Bytes of a partition unless the option ``bytes`` says otherwise; a compressed file is one partition.
PART_BYTES = 64 << 20
#: Rows of an Arrow batch.
BATCH = 20_000
_TESTS = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "In": lambda a, b: a in b}


@dataclass
class Range(InputPartition):
    """A file's rows that begin at bytes lo to hi - 1; hi is -1 for a file that is read as a whole."""

    root: str
    date: str
    file: str
    lo: int
    hi: int


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9]*://", uri) else (pafs.LocalFileSystem(), uri)


def entries(manifest: str) -> list[dict]:
    """The manifest's entries (root, date, file, bytes), JSON by line in the files of a folder, in order of the files' names."""
    fs, path = _store(manifest)
    files = sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
    out = []
    for f in files:
        with fs.open_input_stream(f.path) as s:
            out += [json.loads(x) for x in s.readall().decode().splitlines() if x.strip()]
    return out


class _Ranges:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict) -> None:
        self.manifest, self.columns = options["manifest"], int(options["columns"])
        self.bytes, self.kept = int(options.get("bytes", PART_BYTES)), []

    def ranges(self, found: list[dict]) -> list[Range]:
        out = []
        for e in found:
            if all(_TESTS[kind](e[name], value) for name, kind, value in self.kept):
                step = e["bytes"] if e["file"].endswith(".gz") else self.bytes
                out += [Range(e["root"], e["date"], e["file"], lo, -1 if e["file"].endswith(".gz") else min(lo + step, e["bytes"])) for lo in range(0, max(1, e["bytes"]), max(1, step))]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Rows below the header that begin in the range, with trimmed fields; what a row lacks is null, and empty rows are left out."""
        fs, path = _store(part.file)
        if part.hi < 0:
            text = fs.open_input_stream(path, compression="gzip").readall()
        else:
            with fs.open_input_file(path) as f:
                # A row that begins before the range is the range before's, one that begins in it is read to its end.
                f.seek(max(0, part.lo - 1))
                text = f.read(part.hi - max(0, part.lo - 1))
                while not text.endswith(b"\n") and (more := f.read(1 << 16)):
                    text += more[: more.index(b"\n") + 1] if b"\n" in more else more
                if part.lo:
                    text = text[text.index(b"\n") + 1 :] if b"\n" in text else b""
        lines = text.decode("utf-8", "replace").split("\n")
        rows = [[c.strip() or None for c in x.split(",")] for x in (lines if part.lo else lines[1:]) if x.strip()]
        for k in range(0, len(rows), BATCH):
            some = [(r + [None] * self.columns)[: self.columns] for r in rows[k : k + BATCH]]
            fixed = [pa.array([v] * len(some)) for v in (part.root, part.date, part.file, part.lo)]
            fields = [pa.array(c, pa.string()) for c in zip(*some)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(k, k + len(some)), pa.int64()), *fields], names=["root", "date", "file", "part", "line", *[f"c{i}" for i in range(self.columns)]])


class TapeReader(_Ranges, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f).__name__ in _TESTS and f.attribute in (("root",), ("date",)):
                self.kept.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return self.ranges(entries(self.manifest))


class TapeStream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": len(entries(self.manifest))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(entries(self.manifest)[start["entries"] : end["entries"]])


class TapeSource(DataSource):
    """Options: manifest (a folder), columns (fields of a row), bytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "tidebook_tape"

    def schema(self) -> str:
        return "root string, date string, file string, part long, line long, " + ", ".join(f"c{k} string" for k in range(int(self.options["columns"])))

    def reader(self, schema) -> TapeReader:
        return TapeReader(self.options)

    def streamReader(self, schema) -> TapeStream:
        return TapeStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TapeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tape(spark: SparkSession, manifest: str, columns: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of all tapes in a manifest: root, date, file, part, line and fields c0, c1, ... as ``feeds.lines`` has them. Filter on root and date."""
    register(spark)
    return spark.read.format("tidebook_tape").options(manifest=manifest, columns=columns, bytes=part_bytes).load()


def stream(spark: SparkSession, manifest: str, columns: int) -> DataFrame:
    """The same as a stream: each micro-batch has the entries that came since the last."""
    register(spark)
    return spark.readStream.format("tidebook_tape").options(manifest=manifest, columns=columns).load()


def list_tapes(spark: SparkSession, folder: str, manifest: str) -> None:
    """Adds the text files under folder/root=.../date=... to a manifest. Only names and sizes are looked at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select(F.col("root").cast("string"), F.col("date").cast("string"), F.col("path").alias("file"), F.col("length").alias("bytes"))
    files.coalesce(1).sortWithinPartitions("root", "date", "file").write.mode("append").json(manifest)  # a row a file
