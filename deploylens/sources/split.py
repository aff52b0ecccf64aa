"""Archives of any size as a relation of entries: their directories first, contents after that and only where they count.

``archives.entries`` walks an archive in the task that holds its bytes. Here no task holds one. A frontier of archives is listed level by
level: a task reads the end of an archive and its central directory (64-bit ones too) by ranges, and gives a row for each entry worth one. Inner archives
found so are the next frontier, dealt anew over all tasks, until there is none. An entry goes by its way: the file, and for each archive on the
way the place of the next one in it. A stored inner archive is a range of the one around it; a deflated one is inflated into a
temporary file of the task, which keeps the last way open, as rows come in their order.

Which of several entries of one name counts is settled by names alone: those of a name are ranked by their place, and only the last is read. Where that
can't be parsed, the others of the name are read, and the last that can counts. Classes that are superseded are not parsed.

Contents are then read in ranges of places: neighbours in an archive share a task, and one archive's entries are read by many. Paths are those that
the tasks can open, or URIs of a store that pyarrow knows (file, s3, gs, hdfs, abfs); archives that only Spark can read come as binary files to ``archives.entries``.

Results have the rows of ``archives.entries``, but that a superseded row has no content, whether it would parse or not, and that ``visit_seq`` has gaps and goes over all inputs;
``close_seq`` is zero. Names that repeat in a directory each give a row, an empty archive none, an unreadable one a row with its error."""

from __future__ import annotations

import bz2
import os
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..scratch import Scratch, parallelism
from ..semantics import DEFAULT, Semantics
from . import archives
from .files import Part, opened

#: Packed bytes that one task reads, about.
TASK_BYTES = 64 << 20
BLOCK = 1 << 20
#: Bytes of contents that leave a task at once.
BATCH_BYTES = 32 << 20
STEP = "struct<header:long,packed:long,size:long,method:int,flags:int,crc:long>"
FRONTIER = f"input_id long, archive_name string, depth int, at array<long>, parent string, stored string, uri string, way array<{STEP}>"
#: what: jar (a name), broken (an archive), inner (an archive to open), content (an entry to read).
LISTED = f"input_id long, archive_name string, depth int, at array<long>, what string, entry_name string, kind string, error string, parent string, uri string, way array<{STEP}>, own {STEP}"
FAILURES = (zipfile.BadZipFile, OSError, ValueError, RuntimeError, EOFError, zlib.error, struct.error)

# bytes ---------------------------------------------------------------------------------------


def blocks(archive: Part, step: dict) -> Iterator[bytes]:
    """The content of an entry, a block at a time; an error if it is not what the directory says."""
    if step["flags"] & 1:
        raise RuntimeError("encrypted")
    archive.seek(step["header"])
    head = archive.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile("no entry where the directory has one")
    data = Part(archive.file, archive.base + step["header"] + 30 + sum(struct.unpack("<HH", head[26:30])), step["packed"])
    made = {0: lambda: None, 8: lambda: zlib.decompressobj(-15), 12: bz2.BZ2Decompressor}.get(step["method"])
    if made is None:
        raise RuntimeError(f"compression method {step['method']}")
    unpack, crc = made(), 0
    while block := data.read(BLOCK):
        out = block if unpack is None else unpack.decompress(block)
        crc = zlib.crc32(out, crc)
        if out:
            yield out
    if unpack is not None and hasattr(unpack, "flush") and (out := unpack.flush()):
        crc = zlib.crc32(out, crc)
        yield out
    if crc != step["crc"]:
        raise zipfile.BadZipFile("a wrong checksum")


def content(archive: Part, step: dict, limit: int) -> bytes:
    """The first ``limit`` bytes of an entry."""
    out, size = [], 0
    for block in blocks(archive, step):
        out.append(block[: limit - size])
        size += len(out[-1])
        if size >= limit and size < step["size"]:
            break
    return b"".join(out)


class Way:
    """Opens archives by their way; the last way stays open, as far as the next one shares it."""

    def __init__(self):
        self.steps: list = []
        self.open: list[Part] = []

    def to(self, uri: str, way: list[dict]) -> Part:
        steps = [uri, *way]
        same = 0
        while same < min(len(steps), len(self.steps)) and steps[same] == self.steps[same]:
            same += 1
        while len(self.open) > same:
            last = self.open.pop()
            if not self.open or last.file is not self.open[-1].file:
                last.file.close()
        self.steps = steps[: len(self.open)]
        for step in steps[same:]:
            self.open.append(opened(step) if isinstance(step, str) else self.inner(self.open[-1], step))
            self.steps.append(step)
        return self.open[-1]

    @staticmethod
    def inner(outer: Part, step: dict) -> Part:
        if step["method"] == 0 and not step["flags"] & 1:
            outer.seek(step["header"])
            head = outer.read(30)
            if len(head) < 30 or head[:4] != b"PK\3\4":
                raise zipfile.BadZipFile("no entry where the directory has one")
            return Part(outer.file, outer.base + step["header"] + 30 + sum(struct.unpack("<HH", head[26:30])), step["packed"])
        held = tempfile.SpooledTemporaryFile(max_size=archives.MEMORY_LIMIT)
        for block in blocks(outer, step):
            held.write(block)
        return Part(held, 0, held.tell())


# listing -------------------------------------------------------------------------------------


def listed(frontier: DataFrame, kinds: frozenset[str], semantics: Semantics) -> DataFrame:
    """Rows of ``LISTED`` for the archives of ``FRONTIER``: what each is, and its entries."""
    schema = to_arrow_schema(StructType.fromDDL(LISTED))
    most = semantics.max_depth

    def entries(row: dict, archive: Part) -> Iterator[dict]:
        with zipfile.ZipFile(archive) as z:
            infos = z.infolist()
        name, depth = row["archive_name"], row["depth"]
        own = {"input_id": row["input_id"], "uri": row["uri"], "error": None, "parent": None, "own": None}
        if depth:  # it can be read, so its name counts
            yield own | {"archive_name": row["parent"], "depth": depth - 1, "at": row["at"], "what": "jar", "entry_name": row["stored"], "kind": "jar", "way": None}
        if most is not None and depth > most:
            return
        for i, info in enumerate(infos):
            if info.is_dir():
                continue
            kind, base = archives._kind(info.filename), info.filename.rsplit("/", 1)[-1]
            stored = f"{name}!{archives._JAR_SRC.sub(r'\1', base)}"
            step = {"header": info.header_offset, "packed": info.compress_size, "size": info.file_size, "method": info.compress_type, "flags": info.flag_bits, "crc": info.CRC}
            one = own | {"archive_name": name, "depth": depth, "at": [*row["at"], i], "kind": kind, "way": row["way"], "own": step}
            if archives._opens(info.filename, kind, semantics):
                yield one | {"archive_name": f"{name}!{archives._JAR_SRC_ZIP.sub(r'\1', base)}", "depth": depth + 1, "what": "inner", "entry_name": stored, "parent": name}
            elif kind == "jar":
                yield one | {"what": "jar", "entry_name": stored, "way": None, "own": None}
            elif kind in kinds and kind in ("class", "java", "xml", "manifest"):
                yield one | {"what": "content", "entry_name": info.filename}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, out = Way(), []
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    made = entries(row, way.to(row["uri"], row["way"]))
                    for one in made:
                        out.append(one)
                        if len(out) >= 2000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                except FAILURES as e:
                    shown = row["stored"] if row["depth"] else row["archive_name"]
                    out.append({"input_id": row["input_id"], "archive_name": shown, "depth": row["depth"], "at": row["at"], "what": "broken", "entry_name": shown, "kind": "archive", "error": f"unreadable: {e}"})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return frontier.mapInArrow(each, LISTED)


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` dealt by ranges of places: neighbours stand together, and no input is one task's alone."""
    return rows.repartitionByRange(parts, "input_id", "at").sortWithinPartitions("input_id", "at")


def directories(located: DataFrame, scratch: Scratch, kinds: frozenset[str], semantics: Semantics) -> DataFrame:
    """All levels of ``LISTED`` of the archives in (input_id, archive_name, uri)."""
    n = parallelism(located.sparkSession)
    none = F.lit(None).cast("string")
    frontier = located.select("input_id", "archive_name", F.lit(0).alias("depth"), F.array().cast("array<long>").alias("at"), none.alias("parent"), none.alias("stored"), "uri", F.array().cast(f"array<{STEP}>").alias("way"))
    levels = None
    while True:
        level = scratch.written(listed(in_order(frontier, n), kinds, semantics), "level")
        rows = level.filter("what <> 'inner'")
        levels = rows if levels is None else levels.unionByName(rows)
        inner = level.filter("what = 'inner'")
        if inner.isEmpty():
            return levels
        frontier = inner.select("input_id", "archive_name", "depth", "at", "parent", F.col("entry_name").alias("stored"), "uri", F.array_append("way", F.col("own")).alias("way"))


# what counts ---------------------------------------------------------------------------------


def name_of(semantics: Semantics) -> Column:
    """Entries that share it take each other's place within an input."""
    java = F.col("kind").isin("class", "java")
    return F.when(java, F.concat_ws("\n", F.lit("class"), F.when(F.lit(semantics.class_key_archive), F.col("archive_name")), "entry_name")).when(F.col("kind") == "xml", F.concat_ws("\n", F.lit("xml"), "entry_name")).otherwise("manifest")


def place() -> Column:
    """What orders entries of one name: classes count when their archive ends, after those of the archives in it; files as they are met."""
    above = F.slice("at", 1, F.size("at") - 1)
    late = F.concat(above, F.array(F.lit(2**62)), F.array(F.element_at("at", -1)))
    return F.when(F.col("kind").isin("class", "java"), late).otherwise(F.col("at"))


def ranked(rows: DataFrame, semantics: Semantics) -> DataFrame:
    """``rows`` to be read with their name and rank in it, the last having 1. Inner manifests have no rank where only the outermost counts."""
    named = rows.withColumn("name", name_of(semantics))
    out = F.row_number().over(Window.partitionBy("input_id", "name", "never").orderBy(place().desc()))
    never = (F.col("kind") == "manifest") & (F.col("depth") > 0) & F.lit(semantics.outer_manifest)
    return named.withColumn("never", never).withColumn("rank", F.when(~F.col("never"), out)).drop("never")


READ = schemas.ENTRIES + ", name string, rank int"


def read(rows: DataFrame, semantics: Semantics, xml_limit: int) -> DataFrame:
    """The entries with their contents; descriptors as bytes, classes and sources parsed."""
    schema = to_arrow_schema(StructType.fromDDL(READ))

    def made(row: dict, way: Way) -> dict:
        out = {k: row[k] for k in ("input_id", "archive_name", "depth", "visit_seq", "entry_name", "kind", "name", "rank")} | {"close_seq": 0, "data": None, "parsed": None, "error": None, "superseded": False}
        try:
            data = content(way.to(row["uri"], row["way"]), row["own"], xml_limit if row["kind"] == "xml" else archives.ENTRY_LIMIT)
        except FAILURES as e:
            return out | {"error": f"unreadable: {e}"}
        if row["kind"] in ("xml", "manifest"):
            return out | {"data": data}
        parsed, error = archives.parsed_row(row["kind"], data, semantics)
        return out | {"parsed": parsed, "error": error}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, out, size = Way(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                out.append(made(row, way))
                size += len(out[-1]["data"] or b"")
                if len(out) >= 500 or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(each, READ)


def entries(located: DataFrame, kinds: frozenset[str] = archives.EVERY, semantics: Semantics = DEFAULT, xml_limit: int = archives.XML_LIMIT, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of the archives in (input_id, archive_name, uri)."""
    spark = located.sparkSession
    scratch, n = Scratch(spark), parallelism(spark)
    every = directories(located, scratch, kinds, semantics)
    to_read = ranked(every.filter("what = 'content'"), semantics)
    rest = every.filter("what <> 'content'").withColumns({"name": F.lit(None).cast("string"), "rank": F.lit(None).cast("int")})
    plan = in_order(to_read.unionByName(rest), n).withColumn("visit_seq", F.monotonically_increasing_id())
    plan = scratch.written(plan, "plan")
    first = plan.filter("rank = 1")
    tasks = lambda rows: max(n, int((rows.agg(F.sum("own.packed").alias("b")).first()["b"] or 0) // task_bytes))
    done = scratch.written(read(in_order(first, tasks(first)), semantics, xml_limit), "read")
    failed = done.filter("error IS NOT NULL").select("input_id", "name").distinct()
    late = scratch.written(plan.filter("rank > 1").join(failed, ["input_id", "name"], "left_semi"), "late")
    left = plan.filter("what = 'content' AND (rank IS NULL OR rank > 1)")
    if not late.isEmpty():
        again = scratch.written(read(in_order(late, tasks(late)), semantics, xml_limit), "read-late")
        last = again.filter("error IS NULL").groupBy("input_id", "name").agg(F.min("rank").alias("last"))
        again = again.join(last, ["input_id", "name"], "left").withColumn("superseded", F.col("error").isNull() & (F.col("rank") > F.col("last"))).drop("last")
        done = done.unionByName(again)
        left = left.join(late.select("visit_seq"), "visit_seq", "left_anti")
    shown = plan.filter("what <> 'content'").withColumn("superseded", F.lit(False)).unionByName(left.withColumn("superseded", F.lit(True)), allowMissingColumns=True)
    wanted = StructType.fromDDL(schemas.ENTRIES).fieldNames()
    shown = shown.withColumns({"data": F.lit(None).cast("binary"), "parsed": F.lit(None).cast(schemas.CLASS), "close_seq": F.lit(0).cast("long")})
    return done.select(*wanted).unionByName(shown.select(*wanted))


def files(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(input_id, archive_name, uri) of archive files, named as by ``archives.files``."""
    shown = [p if "://" in p else os.path.relpath(p) for p in inputs]
    rows = [(k, os.path.basename(p) if "://" in p or r.startswith("..") else r, p if "://" in p else os.path.abspath(p)) for k, (p, r) in enumerate(zip(inputs, shown, strict=True))]
    return spark.createDataFrame(rows, "input_id long, archive_name string, uri string")
