"""Archives and directories as rows of entries.

One task walks one archive: nested archives are opened where they stand, classes and sources are parsed on the spot, so no raw class bytes
leave the worker. ``visit_seq`` numbers entries as they are met, ``close_seq`` archives as they end. Of classes, descriptors and manifests
that share a name within an input the last counts; the walk marks the others as superseded, so nothing is shuffled to find them."""

from __future__ import annotations

import io
import os
import re
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import bytecode, java_source, paths
from ..scratch import parallelism
from ..semantics import DEFAULT, Semantics
from . import files as files_of

ENTRY_LIMIT, XML_LIMIT, MEMORY_LIMIT = 500 << 20, 10 << 20, 100 << 20
#: Entries up to this size are read at once.
SMALL = 1 << 20
_LOCAL = struct.Struct("<4s2xH18x2H")
_JAR_SRC = re.compile(r"(?i)(\.jar)\.src(?:\.zip)?\Z")
_JAR_SRC_ZIP = re.compile(r"(?i)(\.jar)\.src\.zip\Z")


def _kind(name: str) -> str:
    low = name.lower()
    if low == "meta-inf/manifest.mf":
        return "manifest"
    for end, kind in ((".class", "class"), (".java", "java"), (".xml", "xml"), (".jar", "jar"), (".war", "war"), (".zip", "zip")):
        if low.endswith(end):
            return "other" if kind == "xml" and "pom.xml" in low else kind
    return "other"


def _opens(name: str, kind: str, semantics: Semantics) -> bool:
    if semantics.any_inner_archive:
        return kind in ("jar", "war", "zip")
    return kind in ("jar", "war") and "lib/" in name.lower()


def parsed_row(kind: str, data: bytes, semantics: Semantics, light: bool = False) -> tuple[dict | None, str | None]:
    """A class or source parsed, or why not; a ``light`` row has no methods and no values of annotations."""
    try:
        if kind == "class":
            return bytecode.decode(data, light), None
        row = java_source.decode(data.decode("utf-8", "replace"), semantics.overload_annotations, light)
    except ValueError as e:
        return None, str(e)
    if light:
        row |= {"class_annotations": [{"type": a["type"], "elements": []} for a in row["class_annotations"]]}
    return row, None


def plain(whole: bytes | None, info: zipfile.ZipInfo) -> bytes | None:
    """The content of a small entry whose headers agree and whose checksum is right, without the steps of a stream; None where it is not that plain."""
    if whole is None or info.file_size > SMALL or info.flag_bits & ~0x80E or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None
    at = info.header_offset
    if at < 0 or at + 30 > len(whole):
        return None
    sign, flags, n, extra = _LOCAL.unpack_from(whole, at)
    start = at + 30 + n + extra
    end = start + info.compress_size
    limit = getattr(info, "_end_offset", None)
    if sign != b"PK\3\4" or flags != info.flag_bits or end > len(whole) or limit is not None and end > limit:
        return None
    if whole[at + 30 : at + 30 + n] != info.orig_filename.encode("utf-8" if flags & 0x800 else "cp437", "replace"):
        return None
    data = whole[start:end]
    if info.compress_type == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        try:
            data = inflate.decompress(data, info.file_size + 1)
        except zlib.error:
            return None
        if not inflate.eof:
            return None
    return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None


class Walk:
    """The entries of one archive, its inner archives included."""

    def __init__(self, input_id, kinds: frozenset[str], semantics: Semantics, xml_limit: int = XML_LIMIT, light: bool = False):
        self.input_id, self.kinds, self.semantics, self.xml_limit, self.light = input_id, kinds, semantics, xml_limit, light
        self.visits = self.closes = 0
        self.last: dict[tuple, dict] = {}

    def row(self, archive: str, depth: int, name: str, kind: str, **more) -> dict:
        self.visits += 1
        return {"input_id": self.input_id, "archive_name": archive, "depth": depth, "visit_seq": self.visits, "close_seq": 0, "entry_name": name, "kind": kind, "data": None, "parsed": None, "error": None, "superseded": False, **more}

    def counts(self, key: tuple, row: dict) -> dict:
        """``row``, which takes the place of an earlier one of its key."""
        if key in self.last:
            self.last[key]["superseded"] = True
        self.last[key] = row
        return row

    def all(self, source, name: str, depth: int = 0, data: bytes | None = None) -> list[dict]:
        """Rows of an archive, whose bytes are ``data`` where they are at hand; one that can't be read is a row with an error."""
        try:
            opened = zipfile.ZipFile(source)
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            return [self.row(name, depth, name, "archive", error=f"unreadable: {e}")]
        return list(self.entries(opened, name, depth, data))

    def entries(self, opened: zipfile.ZipFile, name: str, depth: int, whole: bytes | None = None) -> Iterator[dict]:
        most = self.semantics.max_depth
        if most is not None and depth > most:
            return
        later = []
        with opened:
            for info in opened.infolist():
                if info.is_dir():
                    continue
                kind, base = _kind(info.filename), info.filename.rsplit("/", 1)[-1]
                stored = f"{name}!{_JAR_SRC.sub(r'\1', base)}"
                if _opens(info.filename, kind, self.semantics):
                    data = plain(whole, info)
                    with tempfile.SpooledTemporaryFile(max_size=MEMORY_LIMIT) as held:
                        try:
                            if data is None:
                                with opened.open(info) as stream:
                                    while block := stream.read(1 << 20):
                                        held.write(block)
                                held.seek(0)
                            inner = zipfile.ZipFile(held if data is None else io.BytesIO(data))
                        except (zipfile.BadZipFile, OSError, ValueError, RuntimeError) as e:  # skipped, and no jar name
                            yield self.row(stored, depth + 1, stored, "archive", error=f"unreadable: {e}")
                            continue
                        yield self.row(name, depth, stored, "jar")
                        yield from self.entries(inner, f"{name}!{_JAR_SRC_ZIP.sub(r'\1', base)}", depth + 1, data)
                elif kind == "jar":
                    yield self.row(name, depth, stored, "jar")
                elif kind in self.kinds and kind in ("class", "java", "xml", "manifest"):
                    most = self.xml_limit if kind == "xml" else ENTRY_LIMIT
                    try:
                        data = plain(whole, info)
                        if data is None:
                            with opened.open(info) as stream:
                                data = stream.read(most)
                        data = data[:most]
                    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError) as e:
                        yield self.row(name, depth, info.filename, kind, error=f"unreadable: {e}")
                        continue
                    if kind == "xml":
                        yield self.counts(("xml", info.filename), self.row(name, depth, info.filename, kind, data=data))
                    elif kind == "manifest":
                        row = self.row(name, depth, info.filename, kind, data=data)
                        if depth and self.semantics.outer_manifest:
                            yield row | {"superseded": True}
                        else:
                            yield self.counts(("manifest",), row)
                    else:
                        row, error = parsed_row(kind, data, self.semantics, self.light)
                        later.append(self.row(name, depth, info.filename, kind, parsed=row, error=error))
        self.closes += 1
        for row in later:
            row["close_seq"] = self.closes
            if row["parsed"] is not None:
                self.counts(("class", name if self.semantics.class_key_archive else "", row["entry_name"]), row)
            yield row


EVERY = frozenset({"class", "java", "xml", "manifest", "jar"})


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches, of so many rows and bytes of contents at most. A batch of this schema costs as much as dozens of rows, so it is not ended with each archive."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row["data"] or b"")
        if len(held) == 500 or size > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _source_folders(name: str, folder: bool) -> Iterator[str]:
    """The ``.jar.src`` folders on a path, itself included where it is a folder."""
    if ".jar.src" in name.lower():
        parts = name.split("/")
        for k in range(1, len(parts) + folder):
            if parts[k - 1].lower().endswith(".jar.src"):
                yield "/".join(parts[:k])


def arrow_schema() -> pa.Schema:
    """The schema of entries, which only the driver can make."""
    return to_arrow_schema(StructType.fromDDL(schemas.ENTRIES))


def walked(archives: Iterable[tuple[int, str, bytes | pa.Buffer | None]], schema: pa.Schema, kinds: frozenset[str] = EVERY, semantics: Semantics = DEFAULT, xml_limit: int = XML_LIMIT, light: bool = False) -> Iterator[pa.RecordBatch]:
    """What ``entries`` gives, in batches, for (input_id, archive_name, content) within a task. Archives are taken one at a time."""

    def rows() -> Iterator[dict]:
        for number, name, content in archives:
            data = None
            source = io.BytesIO() if content is None else pa.BufferReader(content)
            if content is not None and len(content) <= SMALL:
                data = bytes(content)
                source = io.BytesIO(data)
            yield from Walk(number, kinds, semantics, xml_limit, light).all(source, name, data=data)

    return batched(rows(), schema)


def entries(archives: DataFrame, kinds: frozenset[str] = EVERY, semantics: Semantics = DEFAULT, xml_limit: int = XML_LIMIT, light: bool = False) -> DataFrame:
    """Rows of the archives in (input_id, archive_name, content). ``kinds`` says what to inflate and parse besides inner archives; ``light`` classes come
    without methods and values of annotations, which is all that framework marks need. An archive's rows are held until it ends, as a later entry may take the place of an earlier one."""
    schema = arrow_schema()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (tuple(batch.column(c)[n] for c in ("input_id", "archive_name", "content")) for batch in batches for n in range(batch.num_rows))
        found = ((number.as_py(), name.as_py(), content.as_buffer() if content.is_valid else None) for number, name, content in held)
        return walked(found, schema, kinds, semantics, xml_limit, light)

    return archives.mapInArrow(each, schemas.ENTRIES)


def files(spark: SparkSession, inputs: list[str], wanted: list[str] | None = None) -> DataFrame:
    """(input_id, archive_name, content) of archive files (of ``wanted`` among them, if given), read in one scan; names are relative to the working directory where below it."""
    shown = [os.path.relpath(p) for p in inputs]
    rows = [(k, os.path.basename(p) if r.startswith("..") else r, os.path.abspath(p)) for k, (p, r) in enumerate(zip(inputs, shown, strict=True))]
    named = spark.createDataFrame(rows, "input_id long, archive_name string, at string")
    found = spark.read.format("binaryFile").load([os.path.abspath(p) for p in dict.fromkeys(inputs if wanted is None else wanted)])
    return found.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("at"), "content").join(named, "at").select("input_id", "archive_name", "content")


def directory(spark: SparkSession, root: str, input_id: int, semantics: Semantics = DEFAULT) -> DataFrame:
    """Entries of a directory tree: it is listed first, and only files that are wanted are read. ``root`` is a path or a URI that tasks can open."""
    from . import listing

    uri = root if "://" in root else os.path.abspath(root)
    roots = spark.createDataFrame([(input_id, os.path.basename(os.path.normpath(root)), uri)], "input_id long, archive_name string, uri string")
    return trees(listing.tree(roots), semantics)


def trees(found: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """Entries of directory trees, given the files as (input_id, archive_name, name, content), name being relative to the tree, or as ``listing.tree`` has them.

    Files count in the order of a walk that takes each directory's names in order. Archives are one level down, go by their path, and are named even
    if unreadable; ``.jar.src`` directories are jar names (those without files too, where they are listed), and what lies in one belongs to the last on its path."""
    own = schemas.ENTRIES + ", path string"
    schema = to_arrow_schema(StructType.fromDDL(own))
    listed = "root" in found.columns
    held = found
    if listed:
        held = found.select("input_id", "archive_name", "name", "root", "folder").repartition(parallelism(found.sparkSession), "input_id", "name")

    def made(number: int, base: str, name: str, opened) -> list[dict]:
        kind, walk = _kind(name), Walk(number, EVERY, semantics)
        inner = kind in ("jar", "war", "zip")
        if not inner and kind not in ("xml", "manifest", "class", "java"):
            return []
        rows = [walk.row(base, 0, _JAR_SRC.sub(r"\1", name), "jar")] if inner else []
        shown = _JAR_SRC_ZIP.sub(r"\1", name)
        try:
            source = opened()
            try:
                if inner:
                    return rows + walk.all(source, shown, 1)
                data = source.read()
            finally:
                source.close()
        except OSError as e:
            failed = walk.row(shown, 1, shown, "archive") if inner else walk.row(base, 0, name, kind)
            return [*rows, failed | {"error": f"unreadable: {e}"}]
        if kind in ("xml", "manifest"):
            return [walk.row(base, 0, name, kind, data=data)]
        parsed, error = parsed_row(kind, data, semantics)
        return [walk.row(base, 0, name, kind, parsed=parsed, error=error, close_seq=1 << 40)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        told: set[tuple] = set()
        for batch in batches:
            for k in range(batch.num_rows):
                number, base, name = (batch.column(c)[k].as_py() for c in ("input_id", "archive_name", "name"))
                folder = listed and batch.column("folder")[k].as_py()
                for d in _source_folders(name, folder):
                    if (number, base, d) not in told:
                        if len(told) == 10_000:  # told again is no harm
                            told.clear()
                        told.add((number, base, d))
                        yield Walk(number, EVERY, semantics).row(base, 0, d, "folder") | {"visit_seq": 0, "path": d}
                if folder:
                    continue
                if listed:
                    root = batch.column("root")[k].as_py()
                    rows = made(number, base, name, lambda root=root, name=name: files_of.opened(files_of.below(root, name)))
                else:
                    content = batch.column("content")[k]
                    rows = made(number, base, name, lambda content=content: pa.BufferReader(content.as_buffer()) if content.is_valid else io.BytesIO())
                for r in rows:
                    yield r | {"path": name}

    rows = held.mapInArrow(lambda batches: batched(rows_of(batches), schema), own)
    inside = (F.col("depth") == 0) & F.col("kind").isin("class", "java") & (paths.source_archive(F.col("entry_name")) != "")
    rows = rows.withColumn("archive_name", F.when(inside, paths.source_archive(F.col("entry_name"))).otherwise(F.col("archive_name")))
    rows = rows.withColumn("entry_name", F.when(inside, paths.source_path(F.col("entry_name"))).otherwise(F.col("entry_name")))
    folder = F.col("kind") == "folder"
    counted = folder | (~F.col("superseded") & (F.col("data").isNotNull() | F.col("parsed").isNotNull()))
    by_class = F.concat_ws("\n", F.lit("class"), F.when(F.lit(semantics.class_key_archive), F.col("archive_name")), "entry_name")
    group = (
        F.when(~counted, F.concat_ws("\n", F.lit("row"), "path", F.col("visit_seq").cast("string"))).when(folder, F.concat_ws("\n", F.lit("folder"), "archive_name", "path"))
        .when(F.col("kind").isin("class", "java"), by_class).when(F.col("kind") == "xml", F.concat_ws("\n", F.lit("xml"), "entry_name")).otherwise("manifest")
    )
    # one pass over the rows: the last of a group counts, and all of those that are in none
    last = Window.partitionBy("input_id", "_group").orderBy((F.col("close_seq") == 1 << 40).desc(), F.split("path", "/").desc(), F.col("close_seq").desc(), F.col("visit_seq").desc())
    kept = rows.withColumn("_counted", counted).withColumn("_group", group).withColumn("_n", F.row_number().over(last)).filter(~F.col("_counted") | (F.col("_n") == 1))
    shown = {"entry_name": F.when(folder, paths.jar_name(F.col("entry_name"))).otherwise(F.col("entry_name")), "kind": F.when(folder, "jar").otherwise(F.col("kind"))}
    return kept.select(*(shown.get(c, F.col(c)).alias(c) for c in StructType.fromDDL(schemas.ENTRIES).names))


# what an input amounts to --------------------------------------------------------------------


def classes(found: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """Parsed classes, one for each path (the outer archive's) or each archive and path."""
    rows = found.filter("kind IN ('class', 'java') AND parsed IS NOT NULL AND NOT superseded")
    return rows.select("input_id", "archive_name", F.col("entry_name").alias("file_path"), F.col("kind").alias("origin"), "parsed.*")


def xml_files(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'xml' AND data IS NOT NULL AND NOT superseded").select("input_id", "entry_name", "visit_seq", F.col("data").cast("string").alias("xml"))


def manifests(found: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    return found.filter("kind = 'manifest' AND data IS NOT NULL AND NOT superseded").select("input_id", "visit_seq", F.col("data").cast("string").alias("manifest"))


def jar_names(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'jar'").select("input_id", "visit_seq", F.col("entry_name").alias("jar_name"))
