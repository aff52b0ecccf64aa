"""The whole analysis: inputs to relations, views and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, index, marks, routes
from ..semantics import DEFAULT, Semantics
from ..sources import archives, sinks, split

ROUTE_ORDER = ["input_id", "neg", "pos"]
CLASS_ORDER = ["input_id", "neg", "file_path"]
#: Files of this size and more are not held whole by a task.
SPLIT_BYTES = 256 << 20


@dataclass
class Analysis:
    entries: DataFrame | None
    routes: DataFrame
    controllers: DataFrame
    classes: DataFrame
    frameworks: DataFrame
    components: DataFrame

    def views(self) -> dict[str, DataFrame]:
        """What the sinks write, by sheet."""
        return {
            "Routes": sinks.routes_view(index.sort_routes(self.routes)), "Controllers": sinks.controllers_view(index.sort_controllers(self.controllers)), "Classes": sinks.classes_view(index.sort_classes(self.classes)),
            "Framework": sinks.frameworks_view(self.frameworks.orderBy("input_id", "ord")), "Components": sinks.components_view(index.sort_components(self.components)),
        }

    def register(self) -> None:
        """Temporary views, for SQL over the analysis."""
        for name in ("entries", "routes", "controllers", "classes", "frameworks", "components"):
            if getattr(self, name) is not None:
                getattr(self, name).createOrReplaceTempView(name)

    def summary(self) -> DataFrame:
        return index.summary(self.routes, self.controllers, self.classes, self.components)


def context(entries: DataFrame, inputs: DataFrame, semantics: Semantics = DEFAULT) -> routes.Context:
    return routes.Context(archives.classes(entries, semantics), archives.xml_files(entries), archives.manifests(entries, semantics), inputs)


def facts(entries: DataFrame, inputs: DataFrame, semantics: Semantics = DEFAULT, extractors: tuple = routes.EXTRACTORS) -> dict[str, DataFrame]:
    """What each input gives by itself: routes and classes with their order, components, frameworks."""
    ctx = context(entries, inputs, semantics)
    found, classes = routes.extract(ctx, semantics, extractors)
    return {
        "routes": found.withColumn("neg", -F.col("prio")), "classes": classes.withColumn("neg", -F.col("prio")),
        "components": detect.components(archives.jar_names(entries), semantics), "frameworks": detect.frameworks_of(marks.of_entries(entries, semantics), inputs),
    }


def firsts(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts without those that others of theirs come before. What is left of two sets of facts can be put together and thinned again."""
    return found | {"routes": index.first_by(found["routes"], index.ROUTE_KEY, ROUTE_ORDER), "classes": index.dedup_classes(found["classes"], CLASS_ORDER)}


def merged(found: dict[str, DataFrame], entries: DataFrame | None, semantics: Semantics = DEFAULT) -> Analysis:
    """The relations over all inputs."""
    kept = index.dedup_routes(found["routes"], ROUTE_ORDER, semantics)
    classes = index.dedup_classes(found["classes"], CLASS_ORDER)
    return Analysis(entries, kept, index.controllers(kept, ROUTE_ORDER), classes, found["frameworks"], index.merge_components(found["components"], ["input_id", "name"]))


def analyse(entries: DataFrame, inputs: DataFrame, semantics: Semantics = DEFAULT, extractors: tuple = routes.EXTRACTORS) -> Analysis:
    """All relations of ``entries``; ``inputs`` is (input_id, archive_name). The caller persists ``entries`` if it asks for several."""
    return merged(facts(entries, inputs, semantics, extractors), entries, semantics)


def scan(spark: SparkSession, inputs: list[str], semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(entries, inputs) of paths: archive files first, then directories."""
    import os

    for p in inputs:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    ordered = sorted(inputs, key=os.path.isdir)
    plain = [p for p in ordered if not os.path.isdir(p)]
    found, names = None, []
    if plain:
        names = [os.path.basename(p) if os.path.relpath(p).startswith("..") else os.path.relpath(p) for p in plain]
        small = [p for p in plain if os.path.getsize(p) < SPLIT_BYTES]
        if small:
            found = archives.entries(archives.files(spark, plain, small), semantics=semantics)
        if len(small) < len(plain):
            large = split.files(spark, plain).filter(~F.col("uri").isin([os.path.abspath(p) for p in small]))
            rows = split.entries(large, semantics=semantics)
            found = rows if found is None else found.unionByName(rows)
    for k, path in enumerate(ordered[len(plain) :], len(plain)):
        rows = archives.directory(spark, path, k, semantics)
        found = rows if found is None else found.unionByName(rows)
        names.append(os.path.basename(os.path.normpath(path)))
    return found, spark.createDataFrame(list(enumerate(names)), "input_id long, archive_name string")


def run(spark: SparkSession, inputs: list[str], output: str | None = None, semantics: Semantics = DEFAULT) -> Analysis:
    """Scan, analyse, check that a framework is known, and write where asked: .xlsx, or a directory of Parquet or CSV."""
    from pyspark import StorageLevel

    found, names = scan(spark, inputs, semantics)
    found = found.persist(StorageLevel.DISK_ONLY)
    broken = found.filter("depth = 0 AND kind = 'archive' AND error IS NOT NULL").select("archive_name", "error").first()
    if broken:
        raise ValueError(f"{broken['archive_name']}: {broken['error']}")
    made = analyse(found, names, semantics)
    detect.supported(made.frameworks)
    made.register()
    if output and output.endswith(".xlsx"):
        sinks.write_xlsx(made.views(), output)
    elif output:
        (sinks.write_csv if output.endswith("csv") else sinks.write_parquet)(made.views(), output)
    return made
