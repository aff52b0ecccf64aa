"""Registry of the package-analysis queries and their DuckDB oracles.

Artefacts are made from the rows of ``part`` inside each job, analysed, and compared with SQL over the same rows. ``brand`` is the
part's brand in lower case without its sign."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, synth
from .functions import bytecode, configs, java_source, paths
from .operators import detect, index, marks
from .operators import routes as R
from .plans import analysis
from .schemas import ANNOTATION, ENTRIES, METHOD
from .semantics import DEFAULT, documented, reference
from .sources import archives, files, listing, sinks, split

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
BRAND = "lower(replace(p_brand, '#', ''))"
P = f"(SELECT p_partkey AS k, {BRAND} AS brand, p_size AS size FROM part)"


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        _QUERIES[name or fn.__name__] = fn
        if sql is not None:
            _SQL[name or fn.__name__] = sql.replace("{P}", P)
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("k"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("brand"), F.col("p_size").cast("int").alias("size"))


def strings(spark: SparkSession, sf: str, **cols: str) -> DataFrame:
    """k and string columns given as SQL over k, brand and size."""
    return parts(spark, sf).select("k", *(F.expr(e).alias(n) for n, e in cols.items()))


# scalar functions ----------------------------------------------------------------------------

_URL = "repeat('/', CAST(k % 3 AS INT)) || brand || repeat('/', CAST(1 + k % 2 AS INT)) || 'x' || k || CASE WHEN k % 4 = 0 THEN '/' ELSE '' END"
_BASE = "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN 'api/' ELSE 'a/' || brand END"
_SUB = "CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '/x' || k ELSE 'y' || k END"
_PATTERN = "CASE k % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' *.do' WHEN 2 THEN 'x' || k ELSE '/y' || k END"
_VERSION = "size || '.' || (k % 10) || CASE k % 6 WHEN 0 THEN '.RELEASE' WHEN 1 THEN '.final' WHEN 2 THEN '-SNAPSHOT' WHEN 3 THEN '.GA' WHEN 4 THEN '-RELEASE' ELSE '.RELEASE.x' END"
_NAME = "CASE k % 9 WHEN 0 THEN 'META-INF/MANIFEST.MF' WHEN 1 THEN 'a/META-INF/MANIFEST.MF' WHEN 2 THEN 'a/B' || k || '.CLASS' WHEN 3 THEN 'src/C.java' WHEN 4 THEN 'x/pom.xml' WHEN 5 THEN 'x/web.XML' WHEN 6 THEN 'WEB-INF/lib/a.jar' WHEN 7 THEN 'mylib/b' || k || '.war' ELSE 'root.jar' END"
_SRC = "CASE k % 5 WHEN 0 THEN 'lib/a' || k || '.jar.src.zip' WHEN 1 THEN 'b.JAR.src' WHEN 2 THEN 'c.jar' WHEN 3 THEN 'x.jar.src/y' || k || '.jar.src/com/Z.java' ELSE 'p/q.java' END"


@query("SELECT k, CASE WHEN regexp_full_match(u, '/*') THEN '/' ELSE regexp_replace(regexp_replace('/' || u, '/+', '/', 'g'), '/$', '') END AS url FROM (SELECT k, " + _URL + " AS u FROM {P})")
def f_normalize_url(spark, sf):
    return strings(spark, sf, u=_URL).select("k", paths.normalize_url(F.col("u")).alias("url"))


@query("SELECT k, CASE WHEN rtrim(b, '/') = '' AND ltrim(s, '/') = '' THEN '/' WHEN rtrim(b, '/') = '' THEN '/' || ltrim(s, '/') WHEN ltrim(s, '/') = '' THEN '/' || rtrim(b, '/') ELSE '/' || rtrim(b, '/') || '/' || ltrim(s, '/') END AS url FROM (SELECT k, " + _BASE + " AS b, " + _SUB + " AS s FROM {P})")
def f_join_path(spark, sf):
    return strings(spark, sf, b=_BASE, s=_SUB).select("k", paths.join_path(F.col("b"), F.col("s")).alias("url"))


@query("SELECT k, CASE WHEN trim(p) = '' THEN '/' WHEN left(trim(p), 1) IN ('/', '*') THEN trim(p) ELSE '/' || trim(p) END AS pattern FROM (SELECT k, " + _PATTERN + " AS p FROM {P})")
def f_servlet_pattern(spark, sf):
    return strings(spark, sf, p=_PATTERN).select("k", paths.servlet_pattern(F.col("p")).alias("pattern"))


@query("SELECT k, CASE WHEN k % 5 = 0 THEN '' ELSE 'com.' || brand || '.c' || k END AS package FROM {P}")
def f_package(spark, sf):
    return strings(spark, sf, n="CASE WHEN k % 5 = 0 THEN 'Plain' || k ELSE 'com/' || brand || '/c' || k || '/Name' END").select("k", paths.package_of(paths.dotted(F.col("n"))).alias("package"))


@query("SELECT k, 'x' || k || '.jar' AS base, CASE WHEN k % 2 = 0 THEN 'a.war!x' || k || '.jar' ELSE 'x' || k || '.jar' END AS plain FROM {P}")
def f_basename(spark, sf):
    d = strings(spark, sf, n="CASE WHEN k % 2 = 0 THEN 'd/a.war!x' || k || '.jar' ELSE brand || '/x' || k || '.jar' END")
    return d.select("k", paths.basename(F.col("n"), True).alias("base"), paths.basename(F.col("n")).alias("plain"))


@query("SELECT k, k % 3 = 2 AS root FROM {P}")
def f_root_archive(spark, sf):
    return strings(spark, sf, n="CASE k % 3 WHEN 0 THEN 'a/b.jar' WHEN 1 THEN 'a.war!b.jar' ELSE 'a' || k || '.war' END").select("k", paths.is_root_archive(F.col("n")).alias("root"))


@query("SELECT k, size || '.' || (k % 10) || CASE WHEN k % 6 = 5 THEN '.RELEASE.x' ELSE '' END AS version FROM {P}")
def f_clean_version(spark, sf):
    return strings(spark, sf, v=_VERSION).select("k", paths.clean_version(F.col("v")).alias("version"))


@query("SELECT k, CASE WHEN 45 + k % 24 <= 48 THEN '1.' || (1 + k % 24) ELSE CAST(1 + k % 24 AS VARCHAR) END AS java FROM {P}")
def c_java_version(spark, sf):
    return parts(spark, sf).select("k", paths.java_version((45 + F.col("k") % 24).cast("int")).alias("java"))


@query("SELECT k, CASE k % 9 WHEN 0 THEN 'manifest' WHEN 2 THEN 'class' WHEN 3 THEN 'java' WHEN 5 THEN 'xml' WHEN 6 THEN 'jar' WHEN 8 THEN 'jar' ELSE 'other' END AS kind FROM {P}")
def s_entry_kind(spark, sf):
    return strings(spark, sf, n=_NAME).select("k", paths.entry_kind(F.col("n")).alias("kind"))


@query("SELECT k, CASE k % 9 WHEN 6 THEN 'jar' WHEN 7 THEN 'war' ELSE 'none' END AS opens FROM {P}")
def s_inner_pred(spark, sf):
    return strings(spark, sf, n=_NAME).select("k", paths.inner_archive(F.col("n")).alias("opens"))


@query("SELECT k, CASE k % 5 WHEN 0 THEN 'lib/a' || k || '.jar' WHEN 1 THEN 'b.JAR' WHEN 2 THEN 'c.jar' WHEN 3 THEN 'x.jar.src/y' || k || '.jar.src/com/Z.java' ELSE 'p/q.java' END AS jar, CASE k % 5 WHEN 0 THEN 'lib/a' || k || '.jar' WHEN 1 THEN 'b.JAR.src' WHEN 2 THEN 'c.jar' WHEN 3 THEN 'x.jar.src/y' || k || '.jar.src/com/Z.java' ELSE 'p/q.java' END AS shown FROM {P}")
def s_jar_name_norm(spark, sf):
    return strings(spark, sf, n=_SRC).select("k", paths.jar_name(F.col("n")).alias("jar"), paths.jar_display(F.col("n")).alias("shown"))


@query("SELECT k, CASE WHEN k % 5 = 3 THEN 'x.jar.src/y' || k || '.jar.src' ELSE '' END AS archive, CASE k % 5 WHEN 3 THEN 'com/Z.java' WHEN 0 THEN 'lib/a' || k || '.jar.src.zip' WHEN 1 THEN 'b.JAR.src' WHEN 2 THEN 'c.jar' ELSE 'p/q.java' END AS file FROM {P}")
def s_jarsrc_reroot(spark, sf):
    return strings(spark, sf, n=_SRC).select("k", paths.source_archive(F.col("n")).alias("archive"), paths.source_path(F.col("n")).alias("file"))


# archives ------------------------------------------------------------------------------------


def entries(spark: SparkSession, sf: str, semantics=DEFAULT, kinds=archives.EVERY, light: bool = False) -> DataFrame:
    """Entries of a war for each part, made and walked in one pass, so that no archive is handed from worker to worker."""
    schema = archives.arrow_schema()

    def each(batches):
        made = (x for part, data in synth.artefacts(batches, lambda r: synth.archive(r["k"], r["brand"], r["size"])) for x in zip(part.column("k").to_pylist(), data, strict=True))
        return archives.walked(((k, f"app{k}.war", data) for k, data in made), schema, kinds, semantics, light=light)

    return synth.dealt(parts(spark, sf)).mapInArrow(each, ENTRIES)


def held(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that several relations are made of, unpacked and parsed once. They wait on disk, as they would take the memory that joins and sorts over them need."""
    return entries(spark, sf).persist(StorageLevel.DISK_ONLY)


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).select(F.col("k").alias("input_id"), F.concat(F.lit("app"), "k", F.lit(".war")).alias("archive_name"))


#: What the catalogue must say, for the oracles alone: order, component, category, literal. Fixed values.
_CATALOG_SQL = """(SELECT * FROM (VALUES
  (0, 'Spring MVC', 'Framework', 'spring-webmvc'),
  (1, 'Spring Web', 'Framework', 'spring-web'),
  (2, 'Spring Boot', 'Framework', 'spring-boot'),
  (3, 'Spring Boot Starter', 'Framework', 'spring-boot-starter-web'),
  (4, 'Spring Cloud', 'Framework', 'spring-cloud'),
  (5, 'Struts2', 'Framework', 'struts2-core'),
  (6, 'JAX-RS', 'Framework', 'javax.ws.rs-api'),
  (7, 'JAX-RS', 'Framework', 'jakarta.ws.rs-api'),
  (8, 'MyBatis', 'ORM', 'mybatis'),
  (9, 'MyBatis Spring', 'ORM', 'mybatis-spring'),
  (10, 'MyBatis Plus', 'ORM', 'mybatis-plus'),
  (11, 'Hibernate', 'ORM', 'hibernate-core'),
  (12, 'JPA', 'ORM', 'hibernate-jpa'),
  (13, 'Druid', 'Database', 'druid'),
  (14, 'HikariCP', 'Database', 'HikariCP'),
  (15, 'C3P0', 'Database', 'c3p0'),
  (16, 'Shiro', 'Security', 'shiro-core'),
  (17, 'Shiro Web', 'Security', 'shiro-web'),
  (18, 'Spring Security', 'Security', 'spring-security-core'),
  (19, 'Spring Security Web', 'Security', 'spring-security-web'),
  (20, 'SaToken', 'Security', 'sa-token'),
  (21, 'Log4j2', 'Logging', 'log4j-core'),
  (22, 'Log4j', 'Logging', 'log4j'),
  (23, 'Logback', 'Logging', 'logback-classic'),
  (24, 'Logback Core', 'Logging', 'logback-core'),
  (25, 'SLF4J', 'Logging', 'slf4j-api'),
  (26, 'Dubbo', 'RPC', 'dubbo'),
  (27, 'gRPC', 'RPC', 'grpc-core'),
  (28, 'Tomcat', 'Container', 'tomcat-embed-core'),
  (29, 'Tomcat Jasper', 'Container', 'tomcat-jasper'),
  (30, 'Jetty', 'Container', 'jetty-server'),
  (31, 'Undertow', 'Container', 'undertow-core'),
  (32, 'Jackson', 'JSON', 'jackson-databind'),
  (33, 'Jackson Core', 'JSON', 'jackson-core'),
  (34, 'Jackson Annotations', 'JSON', 'jackson-annotations'),
  (35, 'Fastjson', 'JSON', 'fastjson'),
  (36, 'Fastjson2', 'JSON', 'fastjson2'),
  (37, 'Gson', 'JSON', 'gson'),
  (38, 'Thymeleaf', 'Template', 'thymeleaf'),
  (39, 'FreeMarker', 'Template', 'freemarker'),
  (40, 'Velocity', 'Template', 'velocity'),
  (41, 'Beetl', 'Template', 'beetl'),
  (42, 'HttpClient', 'HTTP', 'httpclient'),
  (43, 'OkHttp', 'HTTP', 'okhttp'),
  (44, 'JReap', 'Framework', 'jreap'),
  (45, 'RuoYi', 'Framework', 'ruoyi'),
  (46, 'Jeecg', 'Framework', 'jeecg'),
  (47, 'DHCC', 'Framework', 'dhcc'),
  (48, 'Eway Framework', 'Framework', 'eway'),
  (49, 'Commons IO', 'Utility', 'commons-io'),
  (50, 'Commons Lang', 'Utility', 'commons-lang'),
  (51, 'Commons Lang', 'Utility', 'commons-lang3'),
  (52, 'Commons BeanUtils', 'Utility', 'commons-beanutils'),
  (53, 'Commons Collections', 'Utility', 'commons-collections'),
  (54, 'Commons FileUpload', 'Utility', 'commons-fileupload'),
  (55, 'Guava', 'Utility', 'guava'),
  (56, 'Ehcache', 'Cache', 'ehcache'),
  (57, 'Redis', 'Cache', 'jedis'),
  (58, 'Lettuce', 'Cache', 'lettuce-core'),
  (59, 'CXF', 'Web Service', 'cxf'),
  (60, 'Axis2', 'Web Service', 'axis2'),
  (61, 'Swagger', 'API Doc', 'swagger'),
  (62, 'Knife4j', 'API Doc', 'knife4j'),
  (63, 'JUnit', 'Testing', 'junit'),
  (64, 'TestNG', 'Testing', 'testng')
) v(ord, component, category, literal))"""
_LITERALS_SQL = f"(SELECT literal, row_number() OVER (ORDER BY ord) - 1 AS i FROM {_CATALOG_SQL} WHERE literal <> 'commons-collections')"


JARS = f"(SELECT k, brand, size, literal, literal || '-' || size || '.' || (k % 4) || '.RELEASE.jar' AS jar FROM {P} p JOIN {_LITERALS_SQL} l ON p.k % 64 = l.i)"


@query(f"SELECT k AS input_id, 'app' || k || '.war!' || jar AS jar_name FROM {JARS} UNION ALL SELECT k, 'app' || k || '.war!jstl.jar' FROM {P} UNION ALL SELECT k, 'app' || k || '.war!' || jar || '!deep.jar' FROM {JARS} WHERE k % 2 = 1 UNION ALL SELECT k, 'app' || k || '.war!' || jar || '!deep.jar!deeper.jar' FROM {JARS} WHERE k % 2 = 1")
def s_archive_entries(spark, sf):
    return archives.jar_names(entries(spark, sf, kinds=frozenset({"jar"}))).select("input_id", "jar_name")


@query(f"SELECT k AS input_id, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n FROM (SELECT k, 0 AS depth, 3 + CAST(k % 7 = 0 AS INT) + CAST(k % 5 = 0 AS INT) AS n FROM {P} UNION ALL SELECT k, 1, 2 FROM {P} UNION ALL SELECT k, 2, 1 FROM {P} WHERE k % 2 = 1)")
def s_nested_archive(spark, sf):
    return entries(spark, sf, kinds=frozenset({"class", "java"}), light=True).filter("kind IN ('class', 'java')").groupBy("input_id", "depth").agg(F.count("*").alias("n"))


@query("SELECT k AS input_id, 'app' || k || '.war' AS archive_name, 'com/acme/DupOuter' AS this_class FROM {P}")
def s_keep_last(spark, sf):
    return archives.classes(entries(spark, sf, kinds=frozenset({"class", "java"}), light=True)).filter("file_path = 'com/acme/Dup.class'").select("input_id", "archive_name", "this_class")


@query("SELECT k AS input_id, 'Broken.class' AS entry_name FROM {P} WHERE k % 7 = 0")
def s_parse_errors(spark, sf):
    return entries(spark, sf, kinds=frozenset({"class"})).filter("kind = 'class' AND error IS NOT NULL").select("input_id", "entry_name")


@query("SELECT k AS input_id, 'bad-1.0.jar' AS jar FROM {P} WHERE k % 13 = 0")
def s_corrupt_inner(spark, sf):
    return entries(spark, sf, kinds=frozenset({"jar"})).filter("kind = 'archive'").select("input_id", F.regexp_extract("entry_name", "([^!]*)$", 1).alias("jar"))


@query("SELECT k AS input_id, CAST(k % 2 AS INTEGER) AS inner_wins FROM {P}")
def s_manifest_slot(spark, sf):
    return archives.manifests(entries(spark, sf, kinds=frozenset({"manifest"}))).select("input_id", F.startswith("manifest", F.lit("Inner")).cast("int").alias("inner_wins"))


@query("SELECT k AS input_id, kind, CAST(least(n, 60) AS INTEGER) AS n FROM (SELECT k, 'xml' AS kind, 40 + k % 50 AS n FROM {P})")
def s_xml_limit(spark, sf):
    """Descriptors are cut at the limit for them."""
    rows = synth.made(parts(spark, sf), lambda r: synth.zipped({"a.xml": b"x" * (40 + r["k"] % 50), "pom.xml": b"y"}))
    found = archives.entries(rows.select(F.col("k").alias("input_id"), F.lit("a.jar").alias("archive_name"), F.col("data").alias("content")), xml_limit=60)
    return found.select("input_id", "kind", F.length("data").alias("n"))


def tree(r: dict) -> dict[str, bytes]:
    """A directory: a class, a descriptor twice, archives good and bad, sources of an unpacked jar."""
    k = r["k"]
    inner = synth.zipped({"com/acme/Dup.class": bytecode.encode("com/acme/DupInner"), "conf/web.xml": b"<inner/>", "lib/spring-web-5.1.0.RELEASE.jar": synth.zipped({"com/acme/Deep.class": bytecode.encode(f"com/acme/Deep{k}")})})
    return {
        "com/acme/Dup.class": bytecode.encode("com/acme/DupOuter"), "b.jar.src.zip": inner, "bad.war": b"no zip", "conf/web.xml": b"<outer/>", "zconf/ok.xml": b"<ok/>",
        f"x/guava-{k}.1.jar.src/in/y.JAR.SRC/com/A.java": b"package com; class A {}", "META-INF/MANIFEST.MF": f"K: {k}\n".encode(), "pom.xml": b"<p/>",
    }


def dir_trees(spark: SparkSession, sf: str) -> DataFrame:
    import pyarrow as pa

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [(r["k"], n, d) for r in batch.slice(at, 500).to_pylist() for n, d in tree(r).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["input_id", "name", "content"])

    return synth.dealt(parts(spark, sf)).mapInArrow(each, "input_id long, name string, content binary").select("input_id", F.lit("app").alias("archive_name"), "name", "content")


@query("SELECT k AS input_id, kind, archive_name, name FROM {P} CROSS JOIN (VALUES ('jar', 'app', 'b.jar'), ('jar', 'b.jar', 'b.jar!spring-web-5.1.0.RELEASE.jar'), ('jar', 'app', 'bad.war'), ('archive', 'bad.war', 'bad.war'), ('jar', 'app', 'x/guava-@.1.jar'), ('jar', 'app', 'x/guava-@.1.jar.src/in/y.JAR'), ('manifest', 'app', 'META-INF/MANIFEST.MF'), ('class', 'app', 'com/acme/Dup.class'), ('class', 'b.jar!spring-web-5.1.0.RELEASE.jar', 'com/acme/Deep.class'), ('xml', 'app', 'conf/web.xml'), ('xml', 'app', 'zconf/ok.xml'), ('java', 'x/guava-@.1.jar.src', 'in/y.JAR.SRC/com/A.java')) v(kind, archive_name, name)".replace("archive_name, name FROM", "replace(archive_name, '@', CAST(k AS VARCHAR)) AS archive_name, replace(name, '@', CAST(k AS VARCHAR)) AS name FROM", 1))
def s_dir_scan(spark, sf):
    return archives.trees(dir_trees(spark, sf)).select("input_id", "kind", "archive_name", F.col("entry_name").alias("name"))


@query("SELECT k AS input_id, name, version FROM {P} CROSS JOIN (VALUES ('Guava', ''), ('Spring Web', '5.1.0')) v(n, v0), LATERAL (SELECT n AS name, CASE WHEN n = 'Guava' THEN k || '.1' ELSE v0 END AS version)")
def s_dir_components(spark, sf):
    """An unpacked source tree and a jar within an archive of a directory both give their component."""
    return detect.components(archives.jar_names(archives.trees(dir_trees(spark, sf)))).select("input_id", "name", "version")


BUNDLE = 64


def bundle(rows: list[dict]) -> bytes:
    """A war of so many parts: a controller each, and an inner jar, every other one stored, which holds a class of one name
    (broken for some), a resource, and for odd keys a jar of its own."""
    files: list[tuple[str, bytes | str, bool]] = []
    for r in rows:
        k = r["k"]
        inner = [("com/acme/Dup.class", b"\xca\xfe\xba\xbe\0\0\0\x34\0\x03\xff" if k % 5 == 0 else bytecode.encode(f"com/acme/Dup{k}"), False), (f"com/acme/rest/Res{k}.class", synth.jaxrs_class(k), True)]
        if k % 2:
            inner.append(("lib/deep.jar", synth.zipped({f"com/acme/Deep{k}.class": bytecode.encode(f"com/acme/Deep{k}")}), k % 3 == 0))
        files += [(f"WEB-INF/classes/com/acme/web/Part{k}.class", synth.spring_class(k, r["brand"]), False), (f"WEB-INF/lib/x{k}.jar", synth.packed(inner), k % 4 < 2)]
    return synth.packed(files)


def by_bundle(spark: SparkSession, sf: str, turn: int = 0, turns: int = 1):
    """Groups of so many rows, dealt over all tasks, however few bytes they are; of several turns, the groups of one."""
    rows = parts(spark, sf).withColumn("bundle", F.floor(F.col("k") / BUNDLE))
    if turns > 1:
        rows = rows.filter(F.pmod(F.xxhash64("bundle"), F.lit(turns)) == turn)
    return rows.repartition(scratch.parallelism(spark), "bundle").groupBy("bundle")


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """(input_id, archive_name, uri) of archives that tasks write from the table's rows, a bounded number of rows each."""
    import pandas as pd

    root = f"{scratch.shared_dir(spark)}/bundles-{scratch.uuid.uuid4().hex}"

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        number = int(rows["k"].iloc[0]) // BUNDLE
        uri = f"{root}/b{number}.war"
        files.put(uri, bundle(rows.to_dict("records")))
        return pd.DataFrame({"input_id": [number], "archive_name": [f"b{number}.war"], "uri": [uri]})

    made = by_bundle(spark, sf).applyInPandas(write, "input_id long, archive_name string, uri string")
    return scratch.Scratch(spark).written(made, "bundles")


@query(f"""WITH p AS (SELECT k, brand, k // {BUNDLE} AS b, 'b' || (k // {BUNDLE}) || '.war' AS w FROM {{P}}),
d AS (SELECT b, w, max(k) AS k FROM p WHERE k % 5 <> 0 GROUP BY b, w)
SELECT b AS input_id, 'class' AS kind, w AS archive_name, 'WEB-INF/classes/com/acme/web/Part' || k || '.class' AS name, 'com/acme/web/Part' || k AS this_class FROM p
UNION ALL SELECT b, 'jar', w, w || '!x' || k || '.jar', NULL FROM p
UNION ALL SELECT b, 'class', w || '!x' || k || '.jar', 'com/acme/rest/Res' || k || '.class', 'com/acme/rest/Res' || k FROM p
UNION ALL SELECT b, 'class', w || '!x' || k || '.jar', 'com/acme/Dup.class', 'com/acme/Dup' || k FROM d
UNION ALL SELECT b, 'jar', w || '!x' || k || '.jar', w || '!x' || k || '.jar!deep.jar', NULL FROM p WHERE k % 2 = 1
UNION ALL SELECT b, 'class', w || '!x' || k || '.jar!deep.jar', 'com/acme/Deep' || k || '.class', 'com/acme/Deep' || k FROM p WHERE k % 2 = 1""")
def s_split_archive(spark, sf):
    """What counts in archives whose entries are listed and read by ranges."""
    rows = split.entries(bundles(spark, sf)).filter("NOT superseded AND error IS NULL")
    return rows.select("input_id", "kind", "archive_name", F.col("entry_name").alias("name"), "parsed.this_class")


@query(f"SELECT k // {BUNDLE} AS input_id, count(*) AS n, CAST(sum(CAST(k % 2 = 1 AS INT)) AS BIGINT) AS deep FROM {{P}} GROUP BY 1")
def s_inner_frontier(spark, sf):
    """Inner archives found, level by level."""
    every = split.directories(bundles(spark, sf), scratch.Scratch(spark), frozenset({"jar"}), DEFAULT).filter("kind = 'jar'")
    return every.groupBy("input_id").agg(F.sum((F.col("depth") == 0).cast("long")).alias("n"), F.sum((F.col("depth") == 1).cast("long")).alias("deep"))


#: Rows whose trees stand at a time: each is some four files and folders and 17 KB of blocks, of which a file system has room for so many only.
TURN = 1_250_000


@query(f"""WITH p AS (SELECT k, k // {BUNDLE} AS b FROM {{P}})
SELECT b AS input_id, 'class' AS kind, 'tree' AS archive_name, 'com/acme/K' || k || '.class' AS name FROM p
UNION ALL SELECT b, 'jar', 'tree', 'src/s' || k || '.jar' FROM p
UNION ALL SELECT b, 'java', 'src/s' || k || '.jar.src', 'com/A' || k || '.java' FROM p WHERE k % 2 = 1""")
def s_listed_tree(spark, sf):
    """Trees that tasks write and tasks list: folders without files count, and what is no code is never opened. All trees take their turn; where there are
    several turns, those of one are removed when their rows are kept and before the next are written, so what stands on disk does not grow with the table."""
    import pandas as pd

    root = f"{scratch.shared_dir(spark)}/trees-{scratch.uuid.uuid4().hex}"

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["k"].iloc[0]) // BUNDLE
        at = f"{root}/t{number}"
        for k in rows["k"]:
            files.put(f"{at}/com/acme/K{k}.class", bytecode.encode(f"com/acme/K{k}"))
            files.put(f"{at}/media/{k}.bin", b"\0")
            if k % 2:
                files.put(f"{at}/src/s{k}.jar.src/com/A{k}.java", f"package com; class A{k} {{}}".encode())
            else:
                files.put_folder(f"{at}/src/s{k}.jar.src")
        return pd.DataFrame({"input_id": [number], "archive_name": ["tree"], "uri": [at]})

    def remove(rows) -> None:
        for r in rows:
            files.remove_folder(r["uri"])

    turns, tables, kept = max(1, -(-parts(spark, sf).count() // TURN)), scratch.Scratch(spark), None
    for turn in range(turns):
        roots = tables.written(by_bundle(spark, sf, turn, turns).applyInPandas(write, "input_id long, archive_name string, uri string"), "roots")
        found = archives.trees(listing.tree(roots, at_once=100)).select("input_id", "kind", "archive_name", F.col("entry_name").alias("name"))
        if turn < turns - 1:
            found = tables.written(found, "entries")
            roots.foreachPartition(remove)  # in the order they were written in, which file systems undo faster
        kept = found if kept is None else kept.unionByName(found)
    return kept


# class files ---------------------------------------------------------------------------------


def decoded(spark: SparkSession, sf: str, fn) -> DataFrame:
    """k and the class decoded from the bytes that ``fn`` makes of a row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from .schemas import CLASS_FIELDS

    ddl = f"k long, {CLASS_FIELDS}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def each(batches):
        for part, made in synth.artefacts(batches, fn):
            out = []
            for k, data in zip(part.column("k").to_pylist(), made, strict=True):
                try:
                    out.append({"k": k} | (bytecode.decode(data) if data[:4] == b"\xca\xfe\xba\xbe" else java_source.decode(data.decode())))
                except ValueError:
                    continue
            yield pa.RecordBatch.from_pylist(out, schema)

    return synth.dealt(parts(spark, sf)).mapInArrow(each, ddl)


def spring_classes(spark, sf) -> DataFrame:
    return decoded(spark, sf, lambda r: synth.spring_class(r["k"], r["brand"]))


def sources(spark, sf) -> DataFrame:
    return decoded(spark, sf, lambda r: synth.java_source(r["k"], r["brand"]).encode())


@query("SELECT k, 'com/acme/web/Part' || k AS this_class, 'java/lang/Object' AS super_class, CAST(45 + k % 24 AS INTEGER) AS major, 33 AS access FROM {P}")
def c_class_header(spark, sf):
    return spring_classes(spark, sf).select("k", "this_class", "super_class", "major", "access")


@query("SELECT k, m AS name FROM {P} CROSS JOIN (VALUES ('one'), ('many'), ('helper')) v(m)")
def c_methods(spark, sf):
    return spring_classes(spark, sf).select("k", F.explode("methods.name").alias("name"))


@query("SELECT k, name, params, result FROM {P} CROSS JOIN (VALUES ('one', 'String,int', 'List'), ('many', '', 'void'), ('helper', 'long[]', 'boolean')) v(name, params, result)")
def c_descriptor(spark, sf):
    return spring_classes(spark, sf).select("k", F.explode("methods").alias("m")).select("k", "m.name", F.array_join("m.param_types", ",").alias("params"), F.col("m.return_type").alias("result"))


@query("SELECT k, CASE WHEN k % 2 = 0 THEN 'Controller' ELSE 'RestController' END || ',RequestMapping' AS names FROM {P}", "c_ann_simple_name")
def c_ann_simple_name(spark, sf):
    return spring_classes(spark, sf).select("k", F.array_join(F.transform("class_annotations", lambda a: paths.simple_annotation(a["type"])), ",").alias("names"))


@query("SELECT k, CASE k % 6 WHEN 0 THEN 'RequestMapping' WHEN 3 THEN 'RequestMapping' WHEN 1 THEN 'GetMapping' WHEN 2 THEN 'PostMapping' WHEN 4 THEN 'DeleteMapping' ELSE 'PatchMapping' END AS name, CASE WHEN k % 6 = 3 THEN 2 ELSE 1 END AS n FROM {P}")
def c_annotations(spark, sf):
    a = spring_classes(spark, sf).select("k", F.col("methods")[0]["annotations"][0].alias("a"))
    return a.select("k", paths.simple_annotation(F.col("a.type")).alias("name"), F.size("a.elements").alias("n"))


@query("SELECT k, CASE WHEN k % 6 = 3 THEN 'PUT' ELSE '' END AS enums, CASE WHEN k % 6 IN (0, 3) THEN '/' || k ELSE CAST(k AS VARCHAR) END AS first, CASE WHEN k % 6 IN (0, 3) THEN 's' ELSE '[' END AS tag FROM {P}")
def c_accessors(spark, sf):
    e = spring_classes(spark, sf).select("k", F.col("methods")[0]["annotations"][0]["elements"].alias("e"))
    return e.select("k", F.array_join(F.flatten("e.as_enums"), ",").alias("enums"), F.col("e")[0]["as_string"].alias("first"), F.col("e")[0]["tag"].alias("tag"))


@query("SELECT k, 'La/Hidden' || (k % 3) || ';' AS type FROM {P}")
def c_invisible_fallback(spark, sf):
    d = decoded(spark, sf, lambda r: bytecode.encode(f"a/B{r['k']}", annotations=[(f"La/Hidden{r['k'] % 3};", {})], invisible=True))
    return d.select("k", F.col("class_annotations")[0]["type"].alias("type"))


_CUT = "(SELECT k, k % 18 AS cut FROM {P})"


@query(f"SELECT k, CASE WHEN cut < 11 THEN 'com/acme/Cut' || k ELSE '' END AS this_class, CASE WHEN cut < 9 THEN 'java/lang/Object' ELSE '' END AS super_class, CAST(CASE WHEN cut < 13 THEN 33 ELSE 0 END AS INTEGER) AS access FROM {_CUT} WHERE cut < 15")
def c_truncation(spark, sf):
    """A file cut within its last counts still parses, as what is missing reads as zero; one cut within a constant does not."""
    return decoded(spark, sf, lambda r: (lambda d: d[: len(d) - r["k"] % 18])(bytecode.encode(f"com/acme/Cut{r['k']}"))).select("k", "this_class", "super_class", "access")


# sources -------------------------------------------------------------------------------------


@query("SELECT k, 'com/acme/src/Src' || k AS this_class, 'HttpServlet' AS super_class, 'Runnable,java.io.Serializable' AS interfaces FROM {P}")
def j_source_class(spark, sf):
    return sources(spark, sf).select("k", "this_class", "super_class", F.array_join("interfaces", ",").alias("interfaces"))


@query("SELECT k, m AS name FROM {P} CROSS JOIN (VALUES ('go'), ('load'), ('load'), ('plain')) v(m)")
def j_methods(spark, sf):
    return sources(spark, sf).select("k", F.explode("methods").alias("m")).filter("m.return_type <> 'return'").select("k", "m.name")


@query("SELECT k, name, 'Lorg/springframework/web/bind/annotation/GetMapping;' AS type FROM {P} CROSS JOIN (VALUES ('load'), ('load')) v(name)")
def j_overload(spark, sf):
    return sources(spark, sf).select("k", F.explode("methods").alias("m")).filter("m.name = 'load'").select("k", "m.name", F.col("m.annotations")[0]["type"].alias("type"))


@query("SELECT k, 'Ljavax/servlet/annotation/WebServlet;,Ljava/lang/Deprecated;' AS types FROM {P}")
def j_annotations(spark, sf):
    return sources(spark, sf).select("k", F.array_join("class_annotations.type", ",").alias("types"))


@query("SELECT k, name, strs, enums FROM (SELECT k, 'urlPatterns' AS name, '/src/' || k || ',*.p' || (k % 5) AS strs, '' AS enums FROM {P} UNION ALL SELECT k, 'name', 's', '' FROM {P} UNION ALL SELECT k, 'value', '/q' || k, '' FROM {P} UNION ALL SELECT k, 'method', '', 'POST' FROM {P})")
def j_ann_values(spark, sf):
    both = sources(spark, sf).select("k", F.concat("class_annotations", F.col("methods")[0]["annotations"]).alias("a"))
    e = both.select("k", F.explode(F.flatten("a.elements")).alias("e"))
    return e.select("k", "e.name", F.array_join("e.as_strings", ",").alias("strs"), F.array_join("e.as_enums", ",").alias("enums"))


@query("SELECT k, CAST(length(t) AS INTEGER) AS n FROM (SELECT k, 'a \"//x\" ' || brand || '  b ' || k || chr(10) AS t FROM {P})")
def j_strip_comments(spark, sf):
    d = synth.made(parts(spark, sf), lambda r: java_source.without_comments(f'a "//x" {r["brand"]} /* {r["k"]} */b {r["k"]}// t\n').encode())
    return d.select("k", F.length(F.col("data").cast("string")).alias("n"))


@query("SELECT k, 'com/q' || (k % 3) || '/A' || k AS this_class, 'Lorg/p' || (k % 5) || '/Marker;' AS type FROM {P}")
def j_package_import(spark, sf):
    d = decoded(spark, sf, lambda r: f"package com.q{r['k'] % 3};\nimport x.Marker;\nimport static org.p{r['k'] % 5}.Marker;\nimport y.*;\n@Marker class A{r['k']} {{}}".encode())
    return d.select("k", "this_class", F.col("class_annotations")[0]["type"].alias("type"))


@query("SELECT k, CASE k % 5 WHEN 0 THEN 'Lorg/springframework/stereotype/Service;' WHEN 1 THEN 'Ljavax/ws/rs/GET;' WHEN 2 THEN 'La/b' || k || '/C;' WHEN 3 THEN 'Ljava/lang/Override;' ELSE '' END AS type FROM {P}")
def j_ann_resolve(spark, sf):
    d = decoded(spark, sf, lambda r: f"@{('Service', 'GET', 'a.b' + str(r['k']) + '.C', 'Override', 'Unheard')[r['k'] % 5]} class A {{}}".encode())
    return d.select("k", F.coalesce(F.try_element_at("class_annotations", F.lit(1))["type"], F.lit("")).alias("type"))


# descriptors ---------------------------------------------------------------------------------


def xml(spark: SparkSession, sf: str, fn, name: str) -> DataFrame:
    d = synth.made(parts(spark, sf), lambda r: fn(r["k"]).encode())
    return d.select(F.col("k").alias("input_id"), F.lit(name).alias("entry_name"), F.col("data").cast("string").alias("xml"))


@query("SELECT k AS input_id, name, pattern FROM (SELECT k, 's' || k AS name, 's/' || k AS pattern FROM {P} UNION ALL SELECT k, 'ghost', '*.g' FROM {P})")
def x_webxml(spark, sf):
    m = xml(spark, sf, synth.web_xml, "web.xml").select("input_id", F.explode(configs.web_xml(F.col("xml"))["servlet-mapping"]).alias("m"))
    return m.select("input_id", F.col("m.`servlet-name`").alias("name"), F.col("m.`url-pattern`").alias("pattern"))


@query("SELECT k AS input_id, 's' || k AS name, '/one,s/' || k AS patterns FROM {P} UNION ALL SELECT k, 'ghost', '*.g' FROM {P}")
def x_webxml_all(spark, sf):
    m = xml(spark, sf, synth.web_xml, "web.xml").select("input_id", F.explode(configs.web_xml(F.col("xml"), True)["servlet-mapping"]).alias("m"))
    return m.select("input_id", F.col("m.`servlet-name`").alias("name"), F.array_join("m.`url-pattern`", ",").alias("patterns"))


@query("SELECT k AS input_id, k % 5 = 0 AS struts FROM {P}")
def x_struts_filter(spark, sf):
    return xml(spark, sf, synth.web_xml, "web.xml").select("input_id", configs.has_struts_filter(configs.web_xml(F.col("xml"))).alias("struts"))


_NS = "CASE WHEN k % 2 = 0 THEN '/' ELSE '/n' || (k % 7) END"
_ACTIONS = f"SELECT k AS input_id, 'p' || k AS package, {_NS} AS namespace, 'a' || k || '_*' AS name, 'com.acme.act.Act' || k AS action_class, 'do' || (k % 3) AS method, CASE WHEN k % 2 = 0 THEN '' ELSE '/n' || (k % 7) END || '/a' || k || '_{{wildcard}}.action' AS url FROM {{P}} UNION ALL SELECT k, 'p' || k, {_NS}, 'b' || k, 'com.acme.act.Act' || k, 'execute', CASE WHEN k % 2 = 0 THEN '' ELSE '/n' || (k % 7) END || '/b' || k || '.action' FROM {{P}}"


@query(_ACTIONS)
def x_struts(spark, sf):
    rows = R.actions(xml(spark, sf, lambda k: synth.actions_xml(k, "struts"), "struts.xml"), configs.actions_xml(F.col("xml"), "struts"))
    return rows.select("input_id", "package", "namespace", "name", "action_class", "method", "url")


@query(_ACTIONS)
def x_xwork(spark, sf):
    rows = R.actions(xml(spark, sf, lambda k: synth.actions_xml(k, "xwork" if k % 2 else "struts"), "xwork.xml"), configs.xwork_xml(F.col("xml")))
    return rows.select("input_id", "package", "namespace", "name", "action_class", "method", "url")


@query("SELECT k, CASE k % 4 WHEN 0 THEN '/' WHEN 1 THEN '/' ELSE '/' || brand END || CASE WHEN k % 4 > 1 THEN '/' ELSE '' END || 'u' || k || '{wildcard}.action' AS url FROM {P}")
def x_action_url(spark, sf):
    d = strings(spark, sf, ns="CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN brand ELSE '/' || brand || '/' END", n="'u' || k || '*'")
    return d.select("k", configs.action_url(F.col("ns"), F.col("n")).alias("url"))


@query("SELECT k, '<a>' || brand || '</a>' AS xml, 'a' AS root FROM {P}")
def x_doctype(spark, sf):
    d = strings(spark, sf, x="'<!DOCTYPE a PUBLIC \"x\"><a>' || brand || '</a>'").select("k", configs.strip_doctype(F.col("x")).alias("xml"))
    return d.select("k", "xml", configs.root_name(F.col("xml")).alias("root"))


@query("SELECT k, k % 6 = 0 AS xwork, k % 6 IN (1, 2) AS struts, k % 6 IN (3, 4) AS web FROM {P}")
def x_file_class(spark, sf):
    n = F.col("n")
    d = strings(spark, sf, n="CASE k % 6 WHEN 0 THEN 'a/xwork-' || k || '.xml' WHEN 1 THEN 'struts.xml' WHEN 2 THEN 'x/Struts-a.XML' WHEN 3 THEN 'WEB-INF/web.xml' WHEN 4 THEN 'myweb.xml' ELSE 'xstruts.xml' END")
    return d.select("k", configs.is_xwork_file(n).alias("xwork"), configs.is_struts_file(n).alias("struts"), configs.is_web_file(n).alias("web"))


def heads(spark, sf) -> DataFrame:
    d = synth.made(parts(spark, sf), lambda r: synth.manifest(r["k"]).encode())
    return d.select("k", F.col("data").cast("string").alias("text"))


@query("SELECT k, '1.0' AS version, 'abcdef' || k AS long_key, 'b' || k AS twice, CASE WHEN k % 3 = 0 THEN 5 ELSE 3 END AS n FROM {P}")
def x_manifest(spark, sf):
    m = heads(spark, sf).select("k", configs.manifest_main(F.col("text")).alias("m"))
    return m.select("k", F.col("m")["Manifest-Version"].alias("version"), F.col("m")["Long-Key"].alias("long_key"), F.col("m")["Twice"].alias("twice"), F.size("m").alias("n"))


@query("SELECT k, 'com/acme/' AS section, 'Name,Sealed,Manifest-Version' AS keys FROM {P}")
def x_manifest_sections(spark, sf):
    s = heads(spark, sf).select("k", F.explode(configs.manifest_sections(F.col("text"))).alias("s"))
    return s.select("k", F.col("s.name").alias("section"), F.array_join("s.headers.key", ",").alias("keys"))


@query("SELECT k, k % 3 = 0 AS boot FROM {P}")
def x_bootinf(spark, sf):
    return heads(spark, sf).select("k", configs.is_boot(configs.manifest_main(F.col("text"))).alias("boot"))


@query("SELECT k, 'org.springframework.boot.autoconfigure.EnableAutoConfiguration' AS key, 'com.' || brand || '.A,com.B' || k AS vals, true AS auto FROM {P} WHERE k % 2 = 0 UNION ALL SELECT k, 'my.Key', 'com.' || brand || '.A,com.B' || k, false FROM {P} WHERE k % 2 = 1")
def x_spring_factories(spark, sf):
    key = "CASE WHEN k % 2 = 0 THEN 'org.springframework.boot.autoconfigure.EnableAutoConfiguration' ELSE 'my.Key' END"
    d = strings(spark, sf, t=f"concat_ws('\n', '# c=d', concat({key}, ' = com.', brand, '.A, ,com.B', k, char(92)), 'no sign')")
    f = d.select("k", configs.spring_factories(F.col("t")).alias("f"))
    return f.select("k", F.explode("f").alias("p"), configs.has_auto_config(F.col("f")).alias("auto")).select("k", "p.key", F.array_join("p.values", ",").alias("vals"), "auto")


@query("SELECT k, 'b' || k AS id, 'com.acme.' || brand AS class FROM {P} WHERE k % 3 <> 0")
def x_spring_beans(spark, sf):
    d = strings(spark, sf, x="CASE WHEN k % 3 = 0 THEN '<other/>' ELSE concat('<beans><bean id=\"b', k, '\" class=\"com.acme.', brand, '\"><property name=\"p\" value=\"v\"/></bean></beans>') END")
    b = d.select("k", F.explode(configs.spring_beans(F.col("x"))["bean"]).alias("b"))
    return b.select("k", F.col("b._id").alias("id"), F.col("b._class").alias("class"))


# extraction ----------------------------------------------------------------------------------


def none(spark: SparkSession, ddl: str) -> DataFrame:
    """A relation that plans see to be empty, so that nothing is made ready to be joined with it."""
    return spark.createDataFrame([], ddl).limit(0)


def alone(spark, sf, classes: DataFrame | None = None, files: DataFrame | None = None) -> R.Context:
    """A context of decoded classes and files without archives."""
    if classes is not None:
        classes = classes.withColumn("input_id", F.col("k")).withColumn("archive_name", F.concat(F.lit("app"), "k", F.lit(".war"))).withColumn("file_path", F.concat("this_class", F.lit(".class")))
    else:
        classes = none(spark, f"k long, this_class string, super_class string, class_annotations array<{ANNOTATION}>, methods array<{METHOD}>, input_id long, archive_name string, file_path string")
    heads_ = heads(spark, sf).select(F.col("k").alias("input_id"), F.col("text").alias("manifest"))
    return R.Context(classes, files if files is not None else none(spark, "input_id long, entry_name string, xml string"), heads_, inputs(spark, sf))


def shown(routes: DataFrame) -> DataFrame:
    return routes.select("input_id", paths.normalize_url(F.col("url")).alias("url"), F.array_join("http_methods", ",").alias("verbs"), "class_name", "method_name", "framework", "source_file")


def _spring_sql(framework: str, where: str = "true") -> str:
    tail = f"'com.acme.web.Part' || k AS class_name, {{m}} AS method_name, '{framework}' AS framework, 'com/acme/web/Part' || k || '.class' AS source_file FROM {{{{P}}}} WHERE {where}"
    verb = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' WHEN 3 THEN 'PUT' WHEN 4 THEN 'DELETE' ELSE 'PATCH' END"
    rows = [("'/' || brand || '/' || k", verb, "'one'"), ("'/' || brand || '/list'", "'GET'", "'many'"), ("'/' || brand || '/all'", "'GET'", "'many'")]
    return " UNION ALL ".join(f"SELECT k AS input_id, {u} AS url, {v} AS verbs, {tail.format(m=m)}" for u, v, m in rows).replace("{{P}}", "{P}").replace("{{P}}", "{P}")


@query(_spring_sql("Spring MVC"))
def e_spring_routes(spark, sf):
    return shown(R.spring(alone(spark, sf, spring_classes(spark, sf)))[0])


@query("SELECT k, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' WHEN 3 THEN 'PUT' WHEN 4 THEN 'DELETE' ELSE 'PATCH' END AS verbs, CASE WHEN k % 6 IN (0, 3) THEN '/' || k ELSE CAST(k AS VARCHAR) END AS paths FROM {P}")
def e_spring_methods(spark, sf):
    v = spring_classes(spark, sf).select("k", R.verbs_and_paths(F.col("methods")[0]["annotations"]).alias("v"))
    return v.select("k", F.array_join("v.verbs", ",").alias("verbs"), F.array_join("v.paths", ",").alias("paths"))


@query(_spring_sql("Spring Boot", "k % 3 = 0"))
def e_boot_dup(spark, sf):
    return shown(R.boot(alone(spark, sf, spring_classes(spark, sf)))[0])


_ACTION_ROUTES = "SELECT k AS input_id, CASE WHEN k % 2 = 0 THEN '' ELSE '/n' || (k % 7) END || '/a' || k || '_{wildcard}.action' AS url, '' AS verbs, 'com.acme.act.Act' || k AS class_name, 'do' || (k % 3) AS method_name, '@F' AS framework, 'com/acme/act/Act' || k || '.class' AS source_file FROM {P} UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN '' ELSE '/n' || (k % 7) END || '/b' || k || '.action', '', 'com.acme.act.Act' || k, 'execute', '@F', 'com/acme/act/Act' || k || '.class' FROM {P}"


@query(_ACTION_ROUTES.replace("@F", "Struts2"))
def e_struts_xml(spark, sf):
    return shown(R.struts(alone(spark, sf, files=xml(spark, sf, lambda k: synth.actions_xml(k, "struts"), "struts.xml")))[0])


@query("SELECT k AS input_id, '/ns/run' || k AS url, '' AS verbs, 'com.acme.act.Act' || k AS class_name, 'run' AS method_name, 'Struts2' AS framework, 'com/acme/act/Act' || k || '.class' AS source_file FROM {P}")
def e_struts_ann(spark, sf):
    return shown(R.struts(alone(spark, sf, decoded(spark, sf, lambda r: synth.struts_class(r["k"]))))[0])


@query(_ACTION_ROUTES.replace("@F", "WebWork"))
def e_webwork(spark, sf):
    return shown(R.webwork(alone(spark, sf, files=xml(spark, sf, lambda k: synth.actions_xml(k, "xwork"), "conf/xwork.xml")))[0])


@query("SELECT k AS input_id, '/res' || k || '/{id}/' || k AS url, 'GET' AS verbs, 'com.acme.rest.Res' || k AS class_name, 'get' AS method_name, 'JAX-RS' AS framework, 'com/acme/rest/Res' || k || '.class' AS source_file FROM {P} UNION ALL SELECT k, '/res' || k, 'DELETE', 'com.acme.rest.Res' || k, 'del', 'JAX-RS', 'com/acme/rest/Res' || k || '.class' FROM {P}")
def e_jaxrs(spark, sf):
    return shown(R.jaxrs(alone(spark, sf, decoded(spark, sf, lambda r: synth.jaxrs_class(r["k"]))))[0])


def web_routes(spark, sf, semantics=DEFAULT) -> DataFrame:
    return shown(R.servlet(alone(spark, sf, files=xml(spark, sf, synth.web_xml, "WEB-INF/web.xml")), semantics)[0])


@query("SELECT k AS input_id, '/s/' || k AS url, '' AS verbs, 'com.acme.web.S' || k AS class_name, '' AS method_name, 'Servlet' AS framework, 'com/acme/web/S' || k || '.class' AS source_file FROM {P} UNION ALL SELECT k, '/*.g', '', '', '', 'Servlet', '' FROM {P}")
def e_servlet_join(spark, sf):
    return web_routes(spark, sf).filter("class_name = '' OR class_name LIKE 'com.acme%'")


@query("SELECT k AS input_id, '/' AS url, '' AS verbs, 'lonely' AS class_name, '' AS method_name, 'Servlet' AS framework, 'lonely.class' AS source_file FROM {P} UNION ALL SELECT k, '/*', '', 'org.apache.struts2.dispatcher.FilterDispatcher', '', 'Servlet', 'org/apache/struts2/dispatcher/FilterDispatcher.class' FROM {P} WHERE k % 5 = 0")
def e_filter_join(spark, sf):
    return web_routes(spark, sf).filter("class_name <> '' AND class_name NOT LIKE 'com.acme%'")


@query("SELECT k AS input_id, u AS url, '' AS verbs, 'com.acme.src.Src' || k AS class_name, '' AS method_name, 'Servlet' AS framework, 'com/acme/src/Src' || k || '.class' AS source_file FROM (SELECT k, '/src/' || k AS u FROM {P} UNION ALL SELECT k, '/*.p' || (k % 5) FROM {P})")
def e_webservlet(spark, sf):
    return shown(R.servlet(alone(spark, sf, sources(spark, sf)))[0])


@query("SELECT k AS input_id, 'com.acme.web.Part' || k AS full_name, 'com.acme.web' AS package, 'java.lang.Object' AS super_class, CASE WHEN k % 2 = 0 THEN '@Controller,@RequestMapping' ELSE '@RestController,@RequestMapping' END AS annotations, CASE WHEN k % 2 = 0 THEN '@Controller' ELSE '@RestController' END AS spring_type FROM {P}")
def e_class_rows(spark, sf):
    c = R.spring(alone(spark, sf, spring_classes(spark, sf)))[1]
    return c.select("input_id", "full_name", "package", "super_class", F.array_join("annotations", ",").alias("annotations"), "spring_type")


@query("SELECT k, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'com/acme/web/Part' || k || '.class' ELSE 'gone/X' || k || '.class' END AS class_path FROM {P}")
def e_find_class(spark, sf):
    classes = alone(spark, sf, spring_classes(spark, sf)).classes
    names = strings(spark, sf, n="CASE k % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'com.acme.web.Part' || k ELSE 'gone.X' || k END").withColumn("input_id", F.col("k"))
    return R.find_class(names, classes, "n").select("k", "class_path")


@query("SELECT k, k % 2 = 0 AS controller, CASE WHEN k % 2 = 0 THEN '@Controller' ELSE '@RestController' END AS spring_type FROM {P}")
def p_spring_type(spark, sf):
    a = F.col("class_annotations")
    return spring_classes(spark, sf).select("k", R.present(a, [R.CONTROLLER]).alias("controller"), R.spring_type(a).alias("spring_type"))


@query("SELECT k, m AS name, m <> 'helper' AS mapped FROM {P} CROSS JOIN (VALUES ('one'), ('many'), ('helper')) v(m)")
def p_has_mapping(spark, sf):
    return spring_classes(spark, sf).select("k", F.explode("methods").alias("m")).select("k", "m.name", R.has_mapping(F.col("m.annotations")).alias("mapped"))


@query("SELECT k AS input_id, true AS spring, true AS rest, k % 3 = 0 AND k % 2 = 0 AS boot, k % 11 = 0 AS webwork, k % 4 = 0 OR k % 5 = 0 AS struts, true AS servlet FROM {P}")
def p_can_handle(spark, sf):
    """All gates, in one pass over light entries."""
    found = marks.of_entries(entries(spark, sf, light=True), filters=True)
    return found.select("input_id", *(gate.alias(name) for name, gate in marks.gates().items()))


@query("SELECT k AS input_id, k % 4 < 2 AS struts, k % 4 <> 3 AS servlet FROM {P}")
def p_struts_filter(spark, sf):
    """A Struts filter of WEB-INF/web.xml opens its gate; one of another descriptor only where there is none."""
    filtered = "<web-app><filter><filter-name>f</filter-name><filter-class>org.apache.struts2.dispatcher.FilterDispatcher</filter-class></filter></web-app>"
    files = parts(spark, sf).filter("k % 4 <> 3").select(
        F.col("k").alias("input_id"), F.when(F.col("k") % 4 == 0, "WEB-INF/web.xml").otherwise("conf/my-web.xml").alias("entry_name"),
        F.lit(filtered).alias("xml"),
    )
    plain = parts(spark, sf).filter("k % 4 = 2").select(F.col("k").alias("input_id"), F.lit("WEB-INF/web.xml").alias("entry_name"), F.lit("<web-app/>").alias("xml"))
    empty = none(spark, "input_id long, visit_seq long, jar_name string")
    ctx = alone(spark, sf, files=files.unionByName(plain))
    found = index.by_input(ctx.inputs.select("input_id"), marks.of_context(ctx, empty, filters=True), how="left")
    return found.select("input_id", *(marks.gates()[n].alias(n) for n in ("struts", "servlet")))


# detection -----------------------------------------------------------------------------------

_FOUND = f"(SELECT j.k, j.jar, c.component, c.category, size || '.' || (j.k % 4) AS version FROM {JARS} j JOIN {_CATALOG_SQL} c ON j.literal = c.literal)"


def jars(spark: SparkSession, sf: str) -> DataFrame:
    """One jar a part, its name as stored under a war for even keys."""
    names = parts(spark, sf)
    table = F.array(*map(F.lit, synth.LITERALS))
    jar = F.concat(F.element_at(table, (F.col("k") % len(synth.LITERALS) + 1).cast("int")), F.lit("-"), "size", F.lit("."), F.col("k") % 4, F.lit(".RELEASE.jar"))
    return names.select(F.col("k").alias("input_id"), F.lit(1).cast("long").alias("visit_seq"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("app.war!"), jar)).otherwise(F.concat(F.lit("lib/"), jar)).alias("jar_name"))


@query(f"SELECT CAST(p.k AS BIGINT) AS k, c.component, c.category FROM {P} p JOIN {_CATALOG_SQL} c ON p.k % 65 = c.ord")
def d_catalog(spark, sf):
    p = parts(spark, sf).withColumn("ord", (F.col("k") % len(detect.catalog_rows())).cast("int"))
    return p.join(F.broadcast(detect.catalog(spark)), "ord").select("k", "component", "category")


@query(f"SELECT k AS input_id, component AS name, category AS type, version, CASE WHEN k % 2 = 0 THEN 'app.war!' ELSE 'lib/' END || jar AS source FROM {_FOUND}")
def d_components(spark, sf):
    return detect.components(jars(spark, sf)).filter("type <> 'Utility' OR version <> ''").select("input_id", "name", "type", "version", F.array_join("jars", ", ").alias("source"))


@query(f"SELECT k AS input_id, component AS name, version FROM {_FOUND} WHERE k % 2 = 1")
def d_components_reference(spark, sf):
    return detect.components(jars(spark, sf), reference()).filter("version <> ''").select("input_id", "name", "version")


@query("SELECT k AS input_id, CASE k % 4 WHEN 0 THEN 'Servlet API' WHEN 1 THEN 'ASM' WHEN 2 THEN 'BouncyCastle PKIX' ELSE 'JavaMail' END AS name, 'Utility' AS type, '' AS version FROM {P} WHERE k % 5 <> 0")
def d_unversioned(spark, sf):
    d = strings(spark, sf, jar_name="CASE WHEN k % 5 = 0 THEN 'mailx.zip' ELSE CASE k % 4 WHEN 0 THEN 'x/servlet-api.jar' WHEN 1 THEN 'ASM-' || k || '.jar' WHEN 2 THEN 'bcpkix.jar' ELSE 'mail.JAR' END END")
    return detect.components(d.select(F.col("k").alias("input_id"), F.lit(0).cast("long").alias("visit_seq"), "jar_name")).select("input_id", "name", "type", "version")


@query(f"SELECT k AS input_id, component, version || '.RELEASE' AS version FROM {_FOUND} WHERE component IN ('Spring Boot', 'Spring MVC', 'Spring Web', 'Struts2', 'JAX-RS', 'Tomcat')")
def d_version_lookup(spark, sf):
    return detect.jar_versions(jars(spark, sf))


_BOOT = "k % 3 = 0 AND k % 2 = 0"


@query("SELECT k AS input_id, name, CAST(confidence AS INTEGER) AS confidence FROM (SELECT k, 'Spring Boot' AS name, 95 AS confidence FROM {P} WHERE " + _BOOT + " UNION ALL SELECT k, 'Spring MVC', 90 FROM {P} UNION ALL SELECT k, 'Struts2', 90 FROM {P} WHERE k % 4 = 0 UNION ALL SELECT k, 'WebWork', 85 FROM {P} WHERE k % 11 = 0 UNION ALL SELECT k, 'JAX-RS', 85 FROM {P} UNION ALL SELECT k, 'Servlet', 80 FROM {P})")
def d_frameworks(spark, sf):
    found = marks.of_entries(entries(spark, sf, light=True))
    return detect.frameworks_of(found, inputs(spark, sf)).select("input_id", "name", "confidence")


_V = "size || '.' || (k % 4) || '.RELEASE'"


@query(f"SELECT k AS input_id, name, version, evidence FROM (SELECT k, 'Spring MVC' AS name, CASE WHEN literal IN ('spring-webmvc', 'spring-web') THEN {_V} ELSE '' END AS version, '@Controller/@RestController annotations found' AS evidence FROM {JARS} UNION ALL SELECT k, 'JAX-RS', CASE WHEN literal IN ('javax.ws.rs-api', 'jakarta.ws.rs-api') THEN {_V} ELSE '' END, '@Path annotations found on resource classes' FROM {JARS} UNION ALL SELECT k, 'Servlet', CASE WHEN literal = 'tomcat-embed-core' THEN 'Tomcat ' || {_V} ELSE '' END, 'WEB-INF/web.xml; @WebServlet on com/acme/src/Src' || k FROM {JARS} UNION ALL SELECT k, 'WebWork', '2.x', CASE WHEN k % 5 = 0 THEN 'xwork-a.xml; ActionSupport subclass: com/acme/act/Act' || k ELSE 'xwork-a.xml' END FROM {JARS} WHERE k % 11 = 0)")
def d_framework_evidence(spark, sf):
    rows = detect.frameworks_of(marks.of_entries(entries(spark, sf, light=True)), inputs(spark, sf)).filter("name IN ('Spring MVC', 'JAX-RS', 'Servlet', 'WebWork')")
    return rows.select("input_id", "name", "version", F.array_join("evidence", "; ").alias("evidence"))


@query("SELECT k AS input_id, name, evidence FROM {P} CROSS JOIN (VALUES ('Eway Framework', 'com/eway/xwork-b.xml; Eway base class: com/eway/framework/Base'), ('WebWork', 'com/eway/xwork-b.xml; ActionSupport subclass: com/eway/framework/Base')) v(name, evidence)")
def d_eway(spark, sf):
    """A framework that is known by its classes and files."""
    classes = decoded(spark, sf, lambda r: bytecode.encode("com/eway/framework/Base", "com/opensymphony/xwork/ActionSupport"))
    files = parts(spark, sf).select(F.col("k").alias("input_id"), F.lit("com/eway/xwork-b.xml").alias("entry_name"), F.lit("<xwork/>").alias("xml"))
    empty = none(spark, "input_id long, visit_seq long, jar_name string")
    return detect.frameworks(alone(spark, sf, classes, files), empty).filter("name IN ('Eway Framework', 'WebWork')").select("input_id", "name", F.array_join("evidence", "; ").alias("evidence"))


@query("SELECT k AS input_id, 'struts-1.xml;struts-2.xml;struts-3.xml' AS evidence FROM {P}")
def d_evidence_topk(spark, sf):
    files = parts(spark, sf).select(F.col("k").alias("input_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select("input_id", F.concat(F.lit("struts-"), "i", F.lit(".xml")).alias("entry_name"), F.lit("<struts/>").alias("xml"))
    empty = none(spark, "input_id long, visit_seq long, jar_name string")
    return detect.frameworks(alone(spark, sf, files=files), empty).filter("name = 'Struts2'").select("input_id", F.array_join("evidence", ";").alias("evidence"))


@query("SELECT k AS input_id, CASE WHEN k % 3 = 0 THEN 'Spring Boot' ELSE 'Unknown' END AS name FROM {P}")
def d_gate(spark, sf):
    empty = none(spark, "input_id long, visit_seq long, jar_name string")
    return detect.frameworks(alone(spark, sf), empty).select("input_id", "name")


# index ---------------------------------------------------------------------------------------

_L = "SELECT l_orderkey, l_linenumber, repeat('/', CAST(1 + l_linenumber % 2 AS INT)) || 'p' || (l_partkey % 500) || '/' || l_returnflag AS url, l_linestatus AS verb, 'c.K' || (l_suppkey % 50) AS class_name, 'm' || (l_partkey % 3) AS method_name, CASE WHEN l_suppkey % 2 = 0 THEN 'Spring MVC' ELSE 'Servlet' END AS framework, 'f' || l_orderkey || '.class' AS source_file, CASE l_linenumber % 3 WHEN 0 THEN 'a.war' WHEN 1 THEN 'a.war!b.jar' ELSE '' END AS archive_name FROM lineitem"


def route_rows(spark: SparkSession, sf: str) -> DataFrame:
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("lineitem_routes")
    return spark.sql(_L.replace("FROM lineitem", "FROM lineitem_routes")).withColumn("http_methods", F.array("verb")).drop("verb")


_AT = ["l_orderkey", "l_linenumber"]


@query(f"SELECT regexp_replace('/' || url, '/+', '/', 'g') AS url, verb AS verbs, class_name, method_name, framework, source_file FROM ({_L}) QUALIFY row_number() OVER (PARTITION BY verb, url, class_name, method_name, framework ORDER BY l_orderkey, l_linenumber) = 1")
def i_route_dedup(spark, sf):
    return index.dedup_routes(route_rows(spark, sf), _AT).select("url", F.array_join("http_methods", ",").alias("verbs"), "class_name", "method_name", "framework", "source_file")


@query(f"SELECT regexp_replace('/' || url, '/+', '/', 'g') AS url, verb AS verbs, class_name, method_name, framework, arg_min(source_file, l_orderkey * 100 + l_linenumber) AS source_file FROM ({_L}) GROUP BY 1, 2, 3, 4, 5")
def i_route_dedup_normalised(spark, sf):
    return index.dedup_routes(route_rows(spark, sf), _AT, documented()).select("url", F.array_join("http_methods", ",").alias("verbs"), "class_name", "method_name", "framework", "source_file")


@query(f"SELECT class_name AS full_name, archive_name, source_file AS file_path FROM ({_L}) QUALIFY row_number() OVER (PARTITION BY class_name, archive_name ORDER BY l_orderkey, l_linenumber) = 1")
def i_class_dedup(spark, sf):
    rows = route_rows(spark, sf).select(F.col("class_name").alias("full_name"), "archive_name", F.col("source_file").alias("file_path"), *_AT)
    return index.dedup_classes(rows, _AT).select("full_name", "archive_name", "file_path")


@query(f"SELECT CASE WHEN archive_name = 'a.war!b.jar' THEN 'a.war!b.jar!' || source_file ELSE source_file END AS file_path, class_name, framework FROM ({_L}) QUALIFY row_number() OVER (PARTITION BY class_name, framework ORDER BY l_orderkey, l_linenumber) = 1")
def i_controllers(spark, sf):
    return index.controllers(route_rows(spark, sf), _AT)


@query(f"SELECT component AS name, category AS type, version, source FROM (SELECT component, arg_min(category, k) AS category, arg_min(version, k) AS version, string_agg('d' || k || '/' || jar, ', ' ORDER BY k) AS source FROM {_FOUND} GROUP BY component)")
def i_component_merge(spark, sf):
    j = jars(spark, sf).select("input_id", "visit_seq", F.concat(F.lit("d"), "input_id", F.lit("/"), F.regexp_extract("jar_name", "([^/!]*)$", 1)).alias("jar_name"))
    return index.merge_components(detect.components(j).filter("version <> ''"), ["input_id", "name"]).select("name", "type", "version", "source")


@query(f"SELECT 'routes' AS relation, count(*) AS n FROM (SELECT DISTINCT verb, url, class_name, method_name, framework FROM ({_L})) UNION ALL SELECT 'controllers', count(*) FROM (SELECT DISTINCT class_name, framework FROM ({_L})) UNION ALL SELECT 'classes', count(*) FROM (SELECT DISTINCT class_name, archive_name FROM ({_L})) UNION ALL SELECT 'components', count(DISTINCT component) FROM {_FOUND}")
def i_summary(spark, sf):
    rows = route_rows(spark, sf)
    deduped = index.dedup_routes(rows, _AT)
    classes = index.dedup_classes(rows.select(F.col("class_name").alias("full_name"), "archive_name", *_AT), _AT)
    parts_ = index.merge_components(detect.components(jars(spark, sf)).filter("version <> ''"), ["input_id", "name"])
    return index.summary(deduped, index.controllers(rows, _AT), classes, parts_)


def numbered(df: DataFrame, part: str, order: list) -> DataFrame:
    """Rows with their place in the order that the sinks write them in, within each value of ``part``, so that no task numbers all."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long"))


@query(f"SELECT url, verb AS verbs, class_name, row_number() OVER (PARTITION BY class_name ORDER BY url, verb, class_name, framework, method_name, archive_name) AS n FROM (SELECT DISTINCT url, verb, class_name, method_name, framework, archive_name FROM ({_L}))")
def o_routes(spark, sf):
    d = route_rows(spark, sf).select("url", "http_methods", "class_name", "method_name", "framework", "archive_name").distinct()
    return numbered(d, "class_name", index.route_order()).select("url", F.array_join("http_methods", ",").alias("verbs"), "class_name", "n")


@query("SELECT package, full_name, row_number() OVER (PARTITION BY package ORDER BY full_name, archive_name) AS n FROM (SELECT 'com.' || brand AS package, 'com.' || brand || '.C' || (k % 50) AS full_name, 'a' || k AS archive_name FROM {P})")
def o_classes(spark, sf):
    d = strings(spark, sf, package="'com.' || brand", full_name="'com.' || brand || '.C' || (k % 50)", archive_name="'a' || k")
    return numbered(d, "package", index.class_order()).select("package", "full_name", "n")


@query(f"SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY name) AS n FROM (SELECT DISTINCT category AS type, component AS name FROM {_FOUND})")
def o_components(spark, sf):
    d = index.merge_components(detect.components(jars(spark, sf)).filter("version <> ''"), ["input_id", "name"])
    return numbered(d, "type", index.component_order()).select("type", "name", "n")


@query(f"SELECT framework, class_name, row_number() OVER (PARTITION BY framework, left(class_name, 4) ORDER BY class_name) AS n FROM (SELECT DISTINCT class_name, framework FROM ({_L}))")
def o_controllers(spark, sf):
    d = index.controllers(route_rows(spark, sf), _AT).withColumn("part", F.concat("framework", F.substring("class_name", 1, 4)))
    return numbered(d, "part", index.controller_order()).select("framework", "class_name", "n")


# views ---------------------------------------------------------------------------------------


@query(f"SELECT regexp_replace('/' || url, '/+', '/', 'g') AS URL, verb AS HTTP_METHOD, framework AS FRAMEWORK, class_name AS CLASS_NAME, source_file AS CLASS_PATH, method_name AS METHOD_NAME, archive_name AS SOURCE_JAR FROM ({_L}) QUALIFY row_number() OVER (PARTITION BY verb, url, class_name, method_name, framework ORDER BY l_orderkey, l_linenumber) = 1")
def k_routes_view(spark, sf):
    return sinks.routes_view(index.dedup_routes(route_rows(spark, sf), _AT))


@query(_SQL["i_controllers"].replace("AS file_path", "AS FILE_PATH").replace("class_name, framework FROM", "class_name AS CLASS_NAME, framework AS FRAMEWORK FROM"))
def k_controllers_view(spark, sf):
    return sinks.controllers_view(index.controllers(route_rows(spark, sf), _AT))


@query("SELECT 'com.acme.web.Part' || k AS CLASS_NAME, 'com/acme/web/Part' || k || '.class' AS CLASS_PATH, 'app' || k || '.war' AS SOURCE_JAR FROM {P}")
def k_classes_view(spark, sf):
    return sinks.classes_view(R.spring(alone(spark, sf, spring_classes(spark, sf)))[1])


@query("SELECT 'Spring Boot' AS FRAMEWORK, '2.' || (k % 10) || '.0' AS VERSION, 95 AS CONFIDENCE, 'BOOT-INF directory found; MANIFEST.MF Spring-Boot headers' AS EVIDENCE FROM {P} WHERE k % 3 = 0")
def k_frameworks_view(spark, sf):
    empty = none(spark, "input_id long, visit_seq long, jar_name string")
    return sinks.frameworks_view(detect.frameworks(alone(spark, sf), empty).filter("name <> 'Unknown'"))


@query(_SQL["i_component_merge"].replace("component AS name, category AS type, version, source FROM", "component AS COMPONENT, category AS TYPE, version AS VERSION, source AS SOURCE FROM", 1))
def k_components_view(spark, sf):
    j = jars(spark, sf).select("input_id", "visit_seq", F.concat(F.lit("d"), "input_id", F.lit("/"), F.regexp_extract("jar_name", "([^/!]*)$", 1)).alias("jar_name"))
    return sinks.components_view(index.merge_components(detect.components(j).filter("version <> ''"), ["input_id", "name"]))


@query("SELECT framework, count(*) AS n FROM (SELECT 'Spring MVC' AS framework FROM {P} CROSS JOIN range(3) UNION ALL SELECT 'Spring Boot' FROM {P} CROSS JOIN range(3) WHERE " + _BOOT + " UNION ALL SELECT 'JAX-RS' FROM {P} CROSS JOIN range(2) UNION ALL SELECT 'Struts2' FROM {P} CROSS JOIN range(2) WHERE k % 4 = 0 UNION ALL SELECT 'Struts2' FROM {P} WHERE k % 5 = 0 UNION ALL SELECT 'WebWork' FROM {P} CROSS JOIN range(2) WHERE k % 11 = 0 UNION ALL SELECT 'Servlet' FROM {P} CROSS JOIN range(3) UNION ALL SELECT DISTINCT 'Servlet' FROM {P} UNION ALL SELECT DISTINCT 'Servlet' FROM {P} UNION ALL SELECT DISTINCT 'Servlet' FROM {P} WHERE k % 5 = 0) GROUP BY framework")
def e2e_full(spark, sf):
    made = analysis.analyse(held(spark, sf), inputs(spark, sf))
    return made.routes.groupBy("framework").agg(F.count("*").alias("n"))
