"""URLs, names and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand between a library's name and ``.jar``. A fixed value.
VERSION = r"\d+\.\d+(?:\.\d+)?(?:[.\-_][\w.\-]+)?(?:-SNAPSHOT|\.RELEASE|\.Final|\.GA|\.SR\d*)?(?:-M\d+)?(?:-RC\d+)?(?:-alpha\d+)?(?:-beta\d+)?"


def join_path(base: Column, sub: Column) -> Column:
    """Base and sub path with one slash between; both empty: the root."""
    b, s = F.regexp_replace(base, "/+$", ""), F.regexp_replace(sub, "^/+", "")
    return F.when((b == "") & (s == ""), "/").when(b == "", F.concat(F.lit("/"), s)).when(s == "", F.concat(F.lit("/"), b)).otherwise(F.concat(F.lit("/"), b, F.lit("/"), s))


def normalize_url(url: Column) -> Column:
    """A leading slash, single slashes, and no trailing one but for the root."""
    u = F.regexp_replace(F.when(F.startswith(url, F.lit("/")), url).otherwise(F.concat(F.lit("/"), url)), "/+", "/")
    return F.when(u == "/", u).otherwise(F.regexp_replace(u, "/$", ""))


def servlet_pattern(pattern: Column) -> Column:
    p = F.trim(pattern)
    return F.when(p == "", "/").when(p.rlike(r"^[/*]"), p).otherwise(F.concat(F.lit("/"), p))


def single_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/{2,}", "/")


def dotted(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("."))


def package_of(name: Column) -> Column:
    """Text before the last dot, else empty."""
    return F.regexp_extract(name, r"^(.*)\.", 1)


def clean_version(version: Column) -> Column:
    """Without one release suffix."""
    return F.regexp_replace(version, r"(?i)(\.RELEASE|\.Final|\.GA|-SNAPSHOT|-RELEASE)\z", "")


def is_root_archive(name: Column) -> Column:
    return ~name.rlike("[!/]")


def basename(path: Column, nested: bool = False) -> Column:
    """After the last slash; with ``nested``, after the last ``!`` too."""
    return F.regexp_extract(path, "([^/!]*)$" if nested else "([^/]*)$", 1)


def simple_annotation(descriptor: Column) -> Column:
    return F.regexp_extract(descriptor, r"([^/.]*?);?$", 1)


def entry_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low == "meta-inf/manifest.mf", "manifest")
        .when(F.endswith(low, F.lit(".class")), "class")
        .when(F.endswith(low, F.lit(".java")), "java")
        .when(F.endswith(low, F.lit(".xml")) & ~F.contains(low, F.lit("pom.xml")), "xml")
        .when(F.endswith(low, F.lit(".jar")), "jar")
        .otherwise("other")
    )


def inner_archive(name: Column) -> Column:
    """jar, war or none: archives that are opened inside another, those with ``lib/`` in their path."""
    low = F.lower(name)
    under = F.contains(low, F.lit("lib/"))
    return F.when(under & F.endswith(low, F.lit(".jar")), "jar").when(under & F.endswith(low, F.lit(".war")), "war").otherwise("none")


def jar_name(path: Column) -> Column:
    """``x.jar.src`` and ``x.jar.src.zip`` as ``x.jar``."""
    return F.regexp_replace(path, r"(?i)(\.jar)\.src(\.zip)?\z", "$1")


def jar_display(path: Column) -> Column:
    """``x.jar.src.zip`` as ``x.jar``; ``x.jar.src`` stays."""
    return F.regexp_replace(path, r"(?i)(\.jar)\.src\.zip\z", "$1")


def source_archive(path: Column) -> Column:
    """The directory that ends in the last ``.jar.src``, else empty."""
    return F.regexp_extract(path, r"^(.*\.jar\.src)/(.*)\z", 1)


def source_path(path: Column) -> Column:
    """The path below that directory, else the whole path."""
    return F.when(source_archive(path) != "", F.regexp_extract(path, r"^(.*\.jar\.src)/(.*)\z", 2)).otherwise(path)


def java_version(major: Column) -> Column:
    """Java release of a class file's major version, for 45 to 68."""
    return F.when(major.between(45, 48), F.concat(F.lit("1."), (major - 44).cast("string"))).when(major.between(49, 68), (major - 44).cast("string")).otherwise("unknown")
