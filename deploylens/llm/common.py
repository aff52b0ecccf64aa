"""What the text operators share: reading tables, checkpoints, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a function over batches is given at once. Texts can be long, so batches are short.
BATCH_ROWS = 256
#: The contract's word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder, each computed once, that hold the steps of one job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.made = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", {}, 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        df.write.parquet(path)
        made = self.spark.read.parquet(path)
        self.paths[path] = made
        return made

    def spent(self, *tables: DataFrame) -> None:
        """Empties tables (all, if none is named) that nothing reads any more: an overwrite removes their files from any file system."""
        for path, df in list(self.paths.items()):
            if not tables or any(df is t for t in tables):
                self.spark.range(0).toDF("spent").write.mode("overwrite").parquet(path)  # createDataFrame would start further Python workers, which stay
                del self.paths[path]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once as a Parquet table in the shared folder, for wider rows than a checkpoint suits."""
    return Scratch(df.sparkSession).written(df, name)


#: What a Python worker keeps from task to task, by the module that it belongs to.
_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What this worker keeps for ``module``, until it gets a task of another one."""
    return _kept.setdefault(module, {})


def drop_others(module: str) -> None:
    """Workers outlive a job: what another module's tasks have left goes, so that it doesn't add to what this one's need."""
    if others := [m for m in _kept if m != module]:
        for m in others:
            del _kept[m]
        gc.collect()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``fn`` over Arrow batches of ``df``, of ``rows`` at most, inside the tasks that hold them; no shuffle."""
    module = fn.__module__

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(module)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                out = fn(whole.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(each, schema)


def groups_of(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[object, list]]:
    """(key, NumPy columns) of each run of rows with one integer ``key`` in sorted batches."""
    import numpy as np

    held, at = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for x, y in zip(edges, edges[1:], strict=False):
            if x == y:
                continue
            if held and keys[x] != at:
                yield at, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            at = keys[x]
            held.append([c[x:y] for c in cols])
    if held:
        yield at, [np.concatenate(c) for c in zip(*held, strict=True)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts, null as empty; bytes that are no UTF-8 become U+FFFD."""
    return [(x or b"").decode("utf-8", "replace") for x in batch.column(column).cast(pa.binary()).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The whole texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text: further columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
