"""Archives that arrive in a directory, analysed as a stream.

Each micro-batch unpacks and parses its new archives in parallel. ``append`` keeps their entries. ``follow`` keeps what each archive gives by itself,
without what an earlier row of its batch comes before, so the relations over all archives are made from few rows and no entry is read again; ``compact`` puts the
batches together, as first rows of first rows are first rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans import analysis
from ..semantics import DEFAULT, Semantics
from ..sources import archives

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, directory: str, semantics: Semantics = DEFAULT) -> DataFrame:
    """A stream of entries. The number of an input is a 64-bit hash of its path, so that it needs no state."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{jar,war,zip}").load(directory)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return archives.entries(found.select(F.xxhash64("path").alias("input_id"), name.alias("archive_name"), "content"), semantics=semantics)


def append(entries: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the stream's entries to a Parquet directory, each exactly once."""
    writer = entries.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def so_far(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """(entries, inputs) of what has arrived, for ``plans.analysis.analyse``."""
    found = spark.read.schema(schemas.ENTRIES).parquet(table)
    return found, found.filter("depth = 0").groupBy("input_id").agg(F.min("archive_name").alias("archive_name"))


FACTS = ("routes", "classes", "components", "frameworks")


def follow(entries: DataFrame, table: str, checkpoint: str, semantics: Semantics = DEFAULT, once: bool = False) -> StreamingQuery:
    """Keeps the facts of the stream's archives, a folder a batch. A batch that is run again takes its own place."""

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist(StorageLevel.DISK_ONLY)
        inputs = held.filter("depth = 0").groupBy("input_id").agg(F.min("archive_name").alias("archive_name"))
        for name, found in analysis.firsts(analysis.facts(held, inputs, semantics)).items():
            found.write.mode("overwrite").parquet(f"{table}/{name}/batch={number}")
        held.unpersist()

    writer = entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def kept(spark: SparkSession, table: str) -> dict[str, DataFrame]:
    """The facts of all batches."""
    found = {name: spark.read.parquet(f"{table}/{name}").drop("batch") for name in FACTS}
    return found | {"frameworks": found["frameworks"].dropDuplicates(["input_id", "ord"]), "components": found["components"].dropDuplicates(["input_id", "name"])}


def relations(spark: SparkSession, table: str, semantics: Semantics = DEFAULT) -> analysis.Analysis:
    """The relations over all archives that have arrived."""
    return analysis.merged(kept(spark, table), None, semantics)


def compact(spark: SparkSession, table: str) -> None:
    """Puts the batches so far together in the place of the last of them. To be run while no batch is; one that fails half-way leaves rows twice, which count once."""
    for name, found in analysis.firsts(kept(spark, table)).items():
        done = spark.read.parquet(f"{table}/{name}").select("batch").distinct()
        numbers = sorted(r["batch"] for r in done.collect())
        if len(numbers) < 2:
            continue
        together = f"{table}/_together/{name}"
        found.write.mode("overwrite").parquet(together)
        spark.read.schema(found.schema).parquet(together).write.mode("overwrite").parquet(f"{table}/{name}/batch={numbers[-1]}")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        for n in numbers[:-1]:
            path = fs.Path(f"{table}/{name}/batch={n}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
