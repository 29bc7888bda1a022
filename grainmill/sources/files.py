"""Data sources of files that executors read and write on their own: JSON lines in planned blocks, and a file for each row.

Executors reach the store through Arrow's file systems (local paths, hdfs, s3, gs, abfs), by the qualified path that Spark has for it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

PIECE = 1 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Arrow spells it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full.replace("s3a://", "s3://", 1)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:///"):
        return pafs.LocalFileSystem(), path[7:]  # as it is: names may hold characters that a URI escapes
    return pafs.FileSystem.from_uri(path)


def _kind(fs: pafs.FileSystem, path: str) -> pafs.FileType:
    return fs.get_file_info(path).type


def _drop(fs: pafs.FileSystem, path: str) -> None:
    kind = _kind(fs, path)
    if kind == pafs.FileType.Directory:
        fs.delete_dir(path)
    elif kind == pafs.FileType.File:
        fs.delete_file(path)


# --- a file for each row


class FileSet(DataSource):
    """``df.write.format("file_set").mode("overwrite").save(folder)``: a file for each row (name string, content string).

    Tasks write under a staging folder beside ``folder``, each file first under a name of its attempt; the commit puts the staged
    folder in the place of the old one, so a failed or repeated task leaves nothing. Of rows with one name any may win: make names
    unique. A null content is an empty file; a name that is no file name fails the write.
    """

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a set of files is replaced as a whole: use mode('overwrite')")
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("a set of files has the columns name and content")
        return FileSetWriter(self.options["path"].rstrip("/"))


class FileSetWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"{path}.staging-{uuid.uuid4()}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, staging = _open(self.staging)
        fs.create_dir(f"{staging}/files")
        own = f"{staging}/tries/{uuid.uuid4()}"
        fs.create_dir(own)
        for k, row in enumerate(iterator):
            if not row.name or "/" in row.name or "\x00" in row.name or row.name in (".", ".."):
                raise ValueError(f"the id of a task can't name a file: {row.name!r}")
            with fs.open_output_stream(f"{own}/{k}") as out:
                out.write((row.content or "").encode("utf-8"))
            fs.move(f"{own}/{k}", f"{staging}/files/{row.name}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        fs, staging = _open(self.staging)
        _, path = _open(self.path)
        fs.create_dir(f"{staging}/files")
        _drop(fs, path)
        fs.move(f"{staging}/files", path)
        fs.delete_dir(staging)

    def abort(self, messages: list) -> None:
        fs, staging = _open(self.staging)
        _drop(fs, staging)


def write_file_set(files: DataFrame, path: str) -> None:
    """A file for each (name, content) under ``path``, in place of what was there."""
    spark = files.sparkSession
    spark.dataSource.register(FileSet)
    files.select("name", "content").write.format("file_set").mode("overwrite").save(qualified(spark, path))


# --- one file of many rows


def _join_parts(folder: str, path: str, head: str, tail: str, skip: int) -> int:
    """One file of a head, all parts in order without the first ``skip`` bytes, and a tail; in pieces, staged and renamed."""
    fs, source = _open(folder)
    _, target = _open(path)
    parts = sorted((f.path for f in fs.get_file_info(pafs.FileSelector(source)) if f.base_name.startswith("part-")), key=lambda p: int(posixpath.basename(p).split("-")[1]))
    staged, size = f"{target}.staging-{uuid.uuid4()}", 0
    fs.create_dir(posixpath.dirname(target))
    with fs.open_output_stream(staged) as out:
        out.write(head.encode("utf-8"))
        for part in parts:
            with fs.open_input_stream(part) as held:
                while piece := held.read(PIECE):
                    rest, skip = piece[skip:], max(0, skip - len(piece))
                    out.write(rest)
                    size += len(rest)
        out.write(tail.encode("utf-8"))
    _drop(fs, posixpath.join(posixpath.dirname(target), f".{posixpath.basename(target)}.crc"))  # of an older file of this name
    fs.move(staged, target)
    return size


def write_joined(lines: DataFrame, order: list[str], path: str, head: str = "", tail: str = "", between: str = "") -> None:
    """One file of ``head``, the texts of the column ``line`` in the given order, each ended by a line feed, and ``tail``;
    ``between`` comes before each text but the first.

    Tasks sort and write their ranges as parts; one task of the cluster then copies the parts, a megabyte at a time. No row passes the
    driver. ``between`` must be one or more ASCII characters.
    """
    spark, staged = lines.sparkSession, f"{path}.parts-{uuid.uuid4()}"
    lines.orderBy(*order).select(F.concat(F.lit(between), F.coalesce("line", F.lit(""))).alias("line")).write.text(staged)
    source, target, skip = qualified(spark, staged), qualified(spark, path), len(between)

    def join(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.record_batch([pa.array([_join_parts(source, target, head, tail, skip)], pa.int64())], names=["n"])

    spark.range(1, numPartitions=1).mapInArrow(join, "n bigint").collect()  # one number
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- JSON lines in planned blocks


class JsonLines(DataSource):
    """``spark.read.format("json_lines").option("paths", json.dumps([...])).load()``: the lines of JSON files as (ord, path, at,
    category, raw).

    A path is a file, or a folder of ``*.jsonl`` files; files are read in blocks of ``blockBytes`` (64 MB), one for each task, and a
    line belongs to the block that it starts in. ``ord`` follows paths, file names and lines (it counts bytes), ``at`` is a line's
    first byte in its file. ``category`` is the text of that name in an object, else null; equality with it is tested by the reader,
    before lines are handed to Spark. Blank lines are passed over. Lines that aren't UTF-8 or JSON (also NaN, Infinity and repeated
    keys) fail the query with path and place, or go with ``quarantine`` to a file for each block in that folder, once the block is
    read to its end; an attempt that is repeated writes the same file again. Lines end with a line feed. A path that doesn't exist is
    passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return "ord bigint, path string, at bigint, category string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return JsonLinesReader(json.loads(self.options["paths"]), int(self.options.get("blockBytes", 64 << 20)), self.options.get("quarantine"))


class Block(InputPartition):
    def __init__(self, path: str, base: int, start: int, end: int):
        self.path, self.base, self.start, self.end = path, base, start, end


def _refuse(name: str):
    raise ValueError(f"no JSON: {name}")


def _once(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key comes twice")
    return found


class JsonLinesReader(DataSourceReader):
    def __init__(self, paths: list[str], block: int, quarantine: str | None):
        self.paths, self.block, self.quarantine, self.wanted = paths, block, quarantine, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("category",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Block]:
        blocks, base = [], 0
        for path in self.paths:
            fs, inner = _open(path)
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.NotFound:
                continue
            files = [info] if info.type == pafs.FileType.File else sorted((f for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and f.base_name.endswith(".jsonl")), key=lambda f: f.base_name)
            for f in files:
                full = path if f is info else f"{path.rstrip('/')}/{f.base_name}"
                blocks += [Block(full, base, at, min(at + self.block, f.size)) for at in range(0, f.size, self.block)]
                base += f.size
        return blocks or [Block("", 0, 0, 0)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        rows, size, broken = [], 0, []
        for at, line in _lines(part):
            try:
                text = line.decode("utf-8").strip()
                if not text:
                    continue
                value = json.loads(text, parse_constant=_refuse, object_pairs_hook=_once)
            except (ValueError, RecursionError) as e:
                if not self.quarantine:
                    raise ValueError(f"bad JSON in {part.path}, at byte {at}: {e}") from e
                broken.append(json.dumps({"path": part.path, "at": at, "raw": line.decode("utf-8", "replace"), "error": str(e)}, ensure_ascii=False))
                continue
            category = value.get("category") if isinstance(value, dict) else None
            category = category if isinstance(category, str) else None
            if self.wanted is not None and category not in self.wanted:
                continue
            rows.append((part.base + at, part.path, at, category, text))
            size += len(text)
            if len(rows) >= 4096 or size >= 8 * PIECE:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        if broken:
            fs, folder = _open(self.quarantine)
            fs.create_dir(folder)
            staged = f"{folder}/_{uuid.uuid4()}"
            with fs.open_output_stream(staged) as out:
                out.write(("\n".join(broken) + "\n").encode("utf-8"))
            fs.move(staged, f"{folder}/{part.base + part.start:020d}.jsonl")


def _lines(part: Block) -> Iterator[tuple[int, bytes]]:
    """The lines that start in a block, with their first bytes."""
    fs, path = _open(part.path)
    with fs.open_input_file(path) as held:
        at = part.start - 1 if part.start else 0
        held.seek(at)
        open_line, skipping = [], part.start > 0
        while piece := held.read(PIECE):
            first, *others = piece.split(b"\n")
            open_line.append(first)
            for following in others:
                line, open_line = b"".join(open_line), [following]
                if not skipping:
                    yield at, line
                skipping = False
                at += len(line) + 1
                if at >= part.end:
                    return
            if skipping and held.tell() > part.end:
                return  # a line that began before the block goes on behind it
        if not skipping and any(open_line):
            yield at, b"".join(open_line)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["ord", "path", "at", "category", "raw"])


def scan_json_lines(spark: SparkSession, paths: list[str], quarantine: str | None = None, block_bytes: int = 64 << 20) -> DataFrame:
    """``JsonLines`` of the given paths, with ``v``, the value of the line as VARIANT."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLines)
    reader = spark.read.format("json_lines").option("paths", json.dumps([qualified(spark, p) for p in paths])).option("blockBytes", block_bytes)
    if quarantine:
        reader = reader.option("quarantine", qualified(spark, quarantine))
    return reader.load().withColumn("v", F.parse_json("raw"))
