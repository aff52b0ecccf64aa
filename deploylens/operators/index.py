"""Deduplication, merging and ordering of the relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..semantics import DEFAULT, Semantics

ROUTE_KEY = ["http_methods", "url", "class_name", "method_name", "framework"]


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A 64-bit hash of the key stands before it, so that the sorts compare numbers and look at
    the key itself where hashes agree; of each task's rows only the first of a key is shuffled."""
    key, n = free_name(rows, "_key"), free_name(rows, "_n")
    at = Window.partitionBy(key, *keys).orderBy(*order)
    ranked = rows.withColumn(key, F.xxhash64(*keys)).withColumn(n, F.row_number().over(at))
    return ranked.filter(F.col(n) == 1).select(*rows.columns)


def by_input(rows: DataFrame, found: DataFrame, on: str | list[str] = "input_id", how: str = "inner") -> DataFrame:
    """A join of relations that both grow with the inputs. Spark guesses their sizes from the bytes of the table or archives they come from, of which there
    are few for many rows, and would send one of them whole to the driver and to every executor; so they are told to be merged."""
    return rows.join(found.hint("merge"), on, how)


def free_name(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def dedup_routes(routes: DataFrame, order: list[str], semantics: Semantics = DEFAULT) -> DataFrame:
    """First route of each verbs, URL, class, method and framework; the URL is normalised after, or before, that."""
    normal = paths.normalize_url(F.col("url"))
    if semantics.normalised_route_key:
        return first_by(routes.withColumn("url", normal), ROUTE_KEY, order)
    return first_by(routes, ROUTE_KEY, order).withColumn("url", normal)


def dedup_classes(classes: DataFrame, order: list[str]) -> DataFrame:
    return first_by(classes, ["full_name", "archive_name"], order)


def controllers(routes: DataFrame, order: list[str]) -> DataFrame:
    """(file_path, class_name, framework): the first route of each class and framework says where it is."""
    inner = (F.col("archive_name") != "") & ~paths.is_root_archive(F.col("archive_name"))
    where = F.when(inner & (F.col("source_file") != ""), F.concat("archive_name", F.lit("!"), "source_file")).when(inner, F.col("archive_name")).otherwise(F.col("source_file"))
    first = first_by(routes.select(*dict.fromkeys(["class_name", "framework", "archive_name", "source_file", *order])), ["class_name", "framework"], order)
    return first.select(where.alias("file_path"), "class_name", "framework")


def merge_components(components: DataFrame, order: list[str]) -> DataFrame:
    """One row a name over all inputs: first type, first version that is one, jars in order without repeats."""
    jars = F.array_sort(F.collect_list(F.struct(*order, "jars")))
    version = F.min_by("version", F.when(F.col("version") != "", F.struct(*order)))
    found = components.groupBy("name").agg(F.min_by("type", F.struct(*order)).alias("type"), F.coalesce(version, F.lit("")).alias("version"), F.array_distinct(F.flatten(F.transform(jars, lambda x: x["jars"]))).alias("jars"))
    return found.select("name", "type", "version", F.array_join("jars", ", ").alias("source"), "jars")


def route_order() -> list:
    return ["url", F.array_join("http_methods", ","), "class_name", "framework", "method_name", "archive_name"]


def class_order() -> list:
    return ["package", "full_name", "archive_name"]


def component_order() -> list:
    return ["type", "name"]


def controller_order() -> list:
    return ["framework", "class_name"]


def sort_routes(routes: DataFrame) -> DataFrame:
    return routes.orderBy(*route_order())


def sort_classes(classes: DataFrame) -> DataFrame:
    return classes.orderBy(*class_order())


def sort_components(components: DataFrame) -> DataFrame:
    return components.orderBy(*component_order())


def sort_controllers(found: DataFrame) -> DataFrame:
    return found.orderBy(*controller_order())


def summary(routes: DataFrame, found: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """(relation, n)."""
    out = None
    for name, df in (("routes", routes), ("controllers", found), ("classes", classes), ("components", components)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionAll(one)
    return out
