import os
import zipfile

import pytest
from pyspark.sql import functions as F

from deploylens import synth
from deploylens.__main__ import main
from deploylens.operators import detect, index
from deploylens.operators.detect import UnsupportedInput
from deploylens.plans import analysis
from deploylens.semantics import DEFAULT, documented, reference
from deploylens.sources import archives, sinks
from deploylens.streaming import watch


@pytest.fixture(scope="module")
def war(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "app60.war"
    path.write_bytes(synth.archive(60, "b", 3))
    return str(path)


def test_a_war_from_scan_to_sinks(spark, war, tmp_path):
    made = analysis.run(spark, [war], str(tmp_path / "out.xlsx"))
    assert {r["name"] for r in made.frameworks.collect()} == {"Spring Boot", "Spring MVC", "Struts2", "JAX-RS", "Servlet"}
    assert spark.sql("SELECT count(*) AS n FROM routes WHERE framework = 'Spring MVC'").first()["n"] == 3
    with zipfile.ZipFile(tmp_path / "out.xlsx") as z:
        assert b"Routes" in z.read("xl/workbook.xml") and b"autoFilter" in z.read("xl/worksheets/sheet1.xml")
    sinks.write_parquet(made.views(), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/Routes")).columns == list(sinks.SHEETS["Routes"])


def test_depth_limit_and_inner_archives(spark):
    deep = synth.zipped({"lib/b.jar": synth.zipped({"lib/c.jar": synth.zipped({"lib/d.jar": synth.zipped({"X.java": "class X {}"})})}), "other.war": synth.zipped({"a.txt": "x"})})
    df = spark.createDataFrame([(0, "a.war", deep)], "input_id int, archive_name string, content binary")
    seen = lambda s: {r["entry_name"] for r in archives.entries(df, semantics=s).collect()}
    assert "X.java" not in seen(DEFAULT) and "a.war!b.jar!c.jar!d.jar" in seen(DEFAULT)
    assert "X.java" in seen(documented()) and "a.war!other.war" in seen(documented())


def test_directories_and_source_archives(spark, tmp_path):
    root = tmp_path / "app"
    (root / "x.jar.src/com").mkdir(parents=True)
    (root / "x.jar.src/com/A.java").write_text('package com; @Path("/a") class A { @GET public void g() {} }')
    (root / "bad.jar").write_bytes(b"no zip")
    (root / "WEB-INF").mkdir()
    (root / "WEB-INF/web.xml").write_text(synth.web_xml(1))
    made = analysis.analyse(*analysis.scan(spark, [str(root)]))
    files = {(r["archive_name"], r["file_path"]) for r in made.classes.collect()}
    assert files == {("x.jar.src", "com/A.java")}
    assert {r["entry_name"] for r in archives.jar_names(made.entries).collect() for r in [{"entry_name": r["jar_name"]}]} == {"bad.jar", "x.jar"}
    assert {r["framework"] for r in made.routes.collect()} == {"JAX-RS", "Servlet"}


def test_unreadable_and_missing_inputs(spark, tmp_path):
    bad = tmp_path / "bad.jar"
    bad.write_bytes(b"no zip")
    with pytest.raises(ValueError):
        analysis.run(spark, [str(bad)])
    with pytest.raises(FileNotFoundError):
        analysis.run(spark, [str(tmp_path / "none.jar")])
    empty = tmp_path / "empty.jar"
    empty.write_bytes(synth.zipped({"a.txt": "x"}))
    with pytest.raises(UnsupportedInput):
        analysis.run(spark, [str(empty)])


def test_command_line(spark, war, tmp_path, capsys):
    assert main([]) == 1
    assert main(["-output", str(tmp_path / "o.xlsx"), war]) == 0
    assert "routes: " in capsys.readouterr().out and os.path.exists(tmp_path / "o.xlsx")


def test_switches(spark):
    jars = spark.createDataFrame([(0, 1, "a.war!spring-web-5.1.0.jar"), (0, 2, "lib/commons-collections-3.2.1.jar"), (0, 3, "x-5.jar")], "input_id int, visit_seq long, jar_name string")
    names = lambda s: {r["name"] for r in detect.components(jars, s).collect()}
    assert names(reference()) == set() and names(DEFAULT) == {"Spring Web"} and names(documented()) == {"Spring Web", "Commons Collections"}
    rows = spark.createDataFrame([(1, "/a/", "C"), (2, "//a", "C")], "n int, url string, class_name string").withColumn("http_methods", F.array().cast("array<string>")).withColumn("method_name", F.lit("")).withColumn("framework", F.lit("f"))
    assert index.dedup_routes(rows, ["n"]).count() == 2 and index.dedup_routes(rows, ["n"], documented()).count() == 1


def test_boot_supersedes(spark, war):
    found, names = analysis.scan(spark, [war])
    kinds = {r["framework"] for r in analysis.analyse(found, names, documented()).routes.collect()}
    assert "Spring Boot" in kinds and "Spring MVC" not in kinds


def test_stream_equals_batch(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for k in (1, 2):
        (drop / f"app{k}.war").write_bytes(synth.archive(k, "b", 2))
    for _ in range(2):  # the second run finds nothing new
        q = watch.append(watch.arriving(spark, str(drop)), str(tmp_path / "t"), str(tmp_path / "c"), once=True)
        q.awaitTermination()
    streamed = analysis.analyse(*watch.so_far(spark, str(tmp_path / "t"))).routes.count()
    assert streamed == analysis.analyse(*analysis.scan(spark, [str(drop / "app1.war"), str(drop / "app2.war")])).routes.count() > 0


def test_long_xml_is_cut_at_its_limit():
    import io

    data = synth.zipped({"a.xml": b"<" + b"a" * (archives.XML_LIMIT + 5), "b.txt": b"x"})
    rows = archives.Walk(0, archives.EVERY, DEFAULT).all(io.BytesIO(data), "x.jar")
    assert [(r["kind"], len(r["data"])) for r in rows] == [("xml", archives.XML_LIMIT)]
    assert archives.Walk(0, frozenset({"jar"}), DEFAULT).all(io.BytesIO(data), "x.jar") == []


def test_long_relations_go_on_in_further_sheets(spark, tmp_path):
    import re

    rows = spark.range(2500).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("COMPONENT"), F.lit("T<&>\x01").alias("TYPE"), F.lit(None).cast("string").alias("VERSION"), F.lit("s").alias("SOURCE")).orderBy("COMPONENT")
    empty = spark.createDataFrame([], "FRAMEWORK string, VERSION string, CONFIDENCE int, EVIDENCE string")
    path = tmp_path / "long.xlsx"
    sheets = sinks.write_xlsx({"Components": rows, "Framework": empty}, str(path), sheet_rows=1000)
    assert sheets.pop("Framework") == 0 and list(sheets)[:2] == ["Components", "Components 2"] and sum(sheets.values()) == 2500 and max(sheets.values()) <= 1000
    with zipfile.ZipFile(path) as z:
        assert re.findall('sheet name="([^"]+)"', z.read("xl/workbook.xml").decode()) == ["Framework", *sheets]
        made = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in range(2, len(sheets) + 2)]
        assert [len(re.findall(r">n\d+<", x)) for x in made] == list(sheets.values())
        assert [x for text in made for x in re.findall(r">(n\d+)<", text)] == [f"n{k:04}" for k in range(2500)] and "T&lt;&amp;&gt;<" in made[-1]
        assert f'autoFilter ref="A1:D{list(sheets.values())[-1] + 1}"' in made[-1]


def test_relations_of_a_stream_are_those_of_all(spark, tmp_path):
    """After each batch, what has been kept of the archives gives what an analysis of all of them gives; entries are not read again."""
    directory, table = tmp_path / "in", str(tmp_path / "facts")
    directory.mkdir()
    for numbers in ((60, 61), (77, 4, 60_060), ()):
        for k in numbers:
            (directory / f"app{k}.war").write_bytes(synth.archive(k, "b", 3))
        watch.follow(watch.arriving(spark, str(directory)), table, str(tmp_path / "check"), once=True).awaitTermination()
        found = watch.relations(spark, table)
        rows = spark.read.format("binaryFile").load(str(directory)).select(F.xxhash64("path").alias("input_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("archive_name"), "content")
        wanted = analysis.analyse(archives.entries(rows), rows.select("input_id", "archive_name"))
        for name in ("routes", "classes", "controllers", "frameworks", "components"):
            a, b = getattr(found, name), getattr(wanted, name)
            assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name
        watch.compact(spark, table)
    assert len([d for d in os.listdir(f"{table}/routes") if d.startswith("batch=")]) == 1
