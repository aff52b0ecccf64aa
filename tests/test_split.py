import os
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deploylens import synth
from deploylens.functions import bytecode
from deploylens.plans import analysis
from deploylens.semantics import DEFAULT, documented
from deploylens.sources import archives, split


def placed(spark, tmp_path, made):
    rows = []
    for k, (name, data) in enumerate(made.items()):
        (tmp_path / name).write_bytes(data)
        rows.append((k, name, str(tmp_path / name), data))
    df = spark.createDataFrame(rows, "input_id long, archive_name string, uri string, content binary")
    return df.select("input_id", "archive_name", "uri"), df.select("input_id", "archive_name", "content")


def seen(rows, counted=True):
    """What counts of each entry; a superseded one's content does not."""
    out = Counter()
    for r in rows.collect():
        error = (r["error"] or "").split(":")[0]
        if r["superseded"] or (not counted and error):
            continue
        out[r["input_id"], r["archive_name"], r["depth"], r["entry_name"], r["kind"], bytes(r["data"] or b""), r["parsed"] and r["parsed"]["this_class"], error] += 1
    return out


def mixed(*entries):
    """A zip of (name, data, stored) in this order, names repeating as they may."""
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, stored in entries:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def java(name):
    return bytecode.encode(name)


def test_rows_are_those_of_the_walk(spark, tmp_path):
    deep = mixed(("com/acme/Dup.class", java("com/acme/DupDeep"), False), ("lib/d.jar", mixed(("X.java", b"class X {}", True)), True), ("META-INF/MANIFEST.MF", b"Deep: 1\n", False))
    made = {f"app{k}.war": synth.archive(k, "b", 3) for k in (1, 55, 60, 91)} | {
        "ways.war": mixed(
            ("WEB-INF/lib/a.jar", mixed(("lib/deep.jar", deep, True), ("com/acme/Dup.class", java("com/acme/DupA"), True)), False), ("com/acme/Dup.class", java("com/acme/DupOuter"), True),
            ("WEB-INF/lib/b.jar", mixed(("lib/deep.jar", deep, False), ("conf/web.xml", b"<inner/>", True)), True), ("conf/web.xml", b"<outer/>", False), ("WEB-INF/lib/b.jar", b"no zip", True),
            ("WEB-INF/lib/empty.jar", mixed(), False), ("x/other.zip", deep, False), ("a/", b"", True), ("q.jar.src.zip", deep, True), ("META-INF/MANIFEST.MF", b"Outer: 1\n", False),
        ),
        "bad.jar": b"no zip",
        "empty.jar": mixed(),
    }
    uris, whole = placed(spark, tmp_path, made)
    for semantics in (DEFAULT, documented()):
        assert seen(split.entries(uris, semantics=semantics)) == seen(archives.entries(whole, semantics=semantics))
    few = frozenset({"xml", "jar"})
    assert seen(split.entries(uris, few)) == seen(archives.entries(whole, few))
    assert seen(split.entries(uris, xml_limit=20)) == seen(archives.entries(whole, xml_limit=20))
    assert split.entries(uris.filter("input_id < 0")).count() == 0


def test_the_last_that_parses_counts(spark, tmp_path):
    """Only the last of a name is read; where it doesn't parse, the last that does."""
    bad = b"\xca\xfe\xba\xbe\0\0\0\x34\0\x03\xff"
    inner = [mixed(("A.class", java(f"A{k}") if k < 3 else bad, False), ("B.class", java(f"B{k}"), False), ("C.class", bad, True)) for k in range(5)]
    war = mixed(*((f"lib/i{k}.jar", d, bool(k % 2)) for k, d in enumerate(inner)))
    uris, whole = placed(spark, tmp_path, {"a.war": war})
    rows = split.entries(uris)
    assert seen(rows) == seen(archives.entries(whole))
    read = {(r["archive_name"], r["entry_name"]): r for r in rows.collect()}
    assert read["a.war!i2.jar", "A.class"]["parsed"]["this_class"] == "A2" and not read["a.war!i2.jar", "A.class"]["superseded"]
    assert sum(r["parsed"] is not None for k, r in read.items() if k[1] == "B.class") == 1
    assert all(r["error"] for k, r in read.items() if k[1] == "C.class")


def test_damaged_entries(spark, tmp_path):
    """A wrong checksum, a cut file and an entry that is none are rows with errors, as in the walk."""
    good = mixed(("A.class", java("com/acme/Aaaa"), True), ("B.class", java("B"), True))
    wrong = good.replace(b"com/acme/Aaaa", b"com/acme/Abaa", 1)
    no_head = good.replace(b"PK\3\4", b"PK\3\5", 1)
    uris, whole = placed(spark, tmp_path, {"w.jar": wrong, "h.jar": no_head, "cut.jar": good[:-30], "none.jar": b""})
    assert seen(split.entries(uris)) == seen(archives.entries(whole))


def test_beyond_four_gigabytes(spark, tmp_path):
    """An archive behind five sparse gigabytes: 64-bit offsets, ranged reads; no binary file could hold it."""
    path = tmp_path / "big.war"
    with open(path, "wb") as f:
        f.truncate(5 << 30)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("com/acme/A.class", java("com/acme/A"))
        z.writestr("WEB-INF/lib/spring-web-5.1.0.jar", mixed(("B.class", java("B"), True)))
    assert os.path.getsize(path) > 5 << 30
    rows = split.entries(split.files(spark, [str(path)])).collect()
    assert {(r["entry_name"].rsplit("/", 1)[-1].rsplit("!", 1)[-1], r["parsed"] and r["parsed"]["this_class"]) for r in rows} == {("A.class", "com/acme/A"), ("spring-web-5.1.0.jar", None), ("B.class", "B")}
    found, _ = analysis.scan(spark, [str(path)])
    assert found.filter("parsed IS NOT NULL").count() == 2


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    war = mixed(*((f"WEB-INF/lib/i{k}.jar", mixed((f"c/K{k}.class", java(f"c/K{k}"), False)), bool(k % 2)) for k in range(500)), *((f"K{k}.class", java(f"K{k}"), False) for k in range(500)))
    uris, _ = placed(spark, tmp_path, {"a.war": war})
    rows = split.entries(uris).filter("parsed IS NOT NULL").withColumn("task", F.spark_partition_id())
    per = [r["n"] for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 1000 and len(per) >= 8 and max(per) <= 400


def test_unlimited_depth(spark, tmp_path):
    data = mixed(("Z.java", b"class Z {}", True))
    for k in range(12):
        data = mixed((f"lib/n{k}.jar", data, bool(k % 2)))
    uris, whole = placed(spark, tmp_path, {"deep.jar": data})
    rows = split.entries(uris, semantics=documented())
    assert rows.filter("entry_name = 'Z.java'").first()["depth"] == 12
    assert seen(rows) == seen(archives.entries(whole, semantics=documented()))


def test_analysis_is_the_same(spark, tmp_path, monkeypatch):
    uris, _ = placed(spark, tmp_path, {f"app{k}.war": synth.archive(k, "b", 3) for k in (60, 77)})
    inputs = [str(tmp_path / "app60.war"), str(tmp_path / "app77.war")]
    wanted = analysis.analyse(*analysis.scan(spark, inputs))
    monkeypatch.setattr(analysis, "SPLIT_BYTES", 0)
    found = analysis.analyse(*analysis.scan(spark, inputs))
    for name in ("routes", "classes", "controllers", "frameworks", "components"):
        a, b = getattr(wanted, name), getattr(found, name)
        drop = [c for c in ("pos",) if c in a.columns]
        assert sorted(map(str, a.drop(*drop).collect())) == sorted(map(str, b.drop(*drop).collect())), name


@pytest.mark.parametrize("path", ["file:{}", "file://{}", "{}"])
def test_paths_and_uris(spark, tmp_path, path):
    (tmp_path / "a b.jar").write_bytes(mixed(("A.class", java("A"), True)))
    uri = path.format(str(tmp_path / "a b.jar").replace(" ", "%20" if path != "{}" else " "))
    df = spark.createDataFrame([(0, "a b.jar", uri)], "input_id long, archive_name string, uri string")
    assert split.entries(df).filter("parsed IS NOT NULL").count() == 1
