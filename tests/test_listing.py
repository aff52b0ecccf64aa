import os
from urllib.parse import unquote, urlsplit

from pyspark.sql import functions as F

from deploylens import queries, synth
from deploylens.functions import bytecode
from deploylens.operators import detect
from deploylens.sources import archives, listing


def test_a_tree_is_listed_and_little_of_it_read(spark, tmp_path):
    """A file that no reader could hold, a pipe that would block whoever opens it, a loop of links, folders without files, odd names."""
    root = tmp_path / "my app"
    (root / "com/acme").mkdir(parents=True)
    (root / "com/acme/A.class").write_bytes(bytecode.encode("com/acme/A"))
    (root / "lib/guava-1.0.jar.src").mkdir(parents=True)
    (root / "lib/x y+z%20.jar").write_bytes(synth.zipped({"B.class": bytecode.encode("B"), "lib/c.jar": synth.zipped({"C.class": bytecode.encode("C")})}))
    (root / "empty/deep/er").mkdir(parents=True)
    (root / "again").symlink_to(root, target_is_directory=True)
    with open(root / "film.mp4", "wb") as f:
        f.truncate(60 << 30)
    os.mkfifo(root / "pipe.bin")
    rows = archives.directory(spark, str(root), 3).collect()
    assert {(r["kind"], r["archive_name"], r["entry_name"]) for r in rows} == {
        ("class", "my app", "com/acme/A.class"), ("jar", "my app", "lib/guava-1.0.jar"), ("jar", "my app", "lib/x y+z%20.jar"),
        ("class", "lib/x y+z%20.jar", "B.class"), ("jar", "lib/x y+z%20.jar", "lib/x y+z%20.jar!c.jar"), ("class", "lib/x y+z%20.jar!c.jar", "C.class"),
    }
    assert {r["input_id"] for r in rows} == {3}


def test_folders_are_handed_on(spark, tmp_path):
    for a in range(6):
        for b in range(5):
            (tmp_path / f"d{a}/e{b}").mkdir(parents=True)
            (tmp_path / f"d{a}/e{b}/f.txt").write_text("x" * a)
    roots = spark.createDataFrame([(0, "t", str(tmp_path)), (1, "t", tmp_path.as_uri())], "input_id long, archive_name string, uri string")
    for at_once in (1, 7, 10_000):
        found = listing.tree(roots, at_once)
        assert found.filter("NOT folder").agg(F.count("*"), F.sum("size")).first()[:] == (60, 2 * 5 * 15)
        assert found.filter("folder").count() == 2 * 36
    assert listing.tree(roots.filter("input_id < 0")).count() == 0


def test_a_tree_is_read_once_and_by_all_tasks(spark, tmp_path):
    """Neither rows nor components of trees go over the files a second time, and a table in one file is dealt."""
    import re

    from deploylens import queries

    found = archives.trees(queries.dir_trees(spark, "/root/testdata/sf0.001"))
    for df in (found, detect.components(archives.jar_names(found))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("MapInArrow", plan)) == 2  # the files are made, and read
    assert queries.dir_trees(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8


def test_components_known_and_loose_of_one_name(spark):
    """A version goes before a prefix, whichever jar comes first; of prefixes the first jar stays."""
    jars = spark.createDataFrame([(1, 1, "asm-util.jar"), (1, 2, "asm.jar"), (1, 3, "guava-1.2.jar"), (1, 4, "guava-1.3.GA.jar"), (1, 5, "x.war"), (2, 1, "guava-7.0.jar")], "input_id long, visit_seq long, jar_name string")
    rows = {(r["input_id"], r["name"]): (r["type"], r["version"], r["jars"]) for r in detect.components(jars).collect()}
    assert rows == {(1, "ASM"): ("Utility", "", ["asm-util.jar"]), (1, "Guava"): ("Utility", "1.2", ["guava-1.2.jar", "guava-1.3.GA.jar"]), (2, "Guava"): ("Utility", "7.0", ["guava-7.0.jar"])}


def test_trees_stand_in_turns(spark, monkeypatch):
    """Files and folders that stand at a time don't grow with the table, and no row is lost."""
    sf, seen, tree = "/root/testdata/sf0.001", [], listing.tree

    def watched(roots, at_once):
        assert not any(os.path.exists(x) for uris in seen for x in uris)  # of earlier turns
        seen.append([unquote(urlsplit(r["uri"]).path) for r in roots.collect()])
        assert all(os.path.isdir(x) for x in seen[-1])
        return tree(roots, at_once)

    monkeypatch.setattr(listing, "tree", watched)
    whole = sorted(queries.s_listed_tree(spark, sf).collect())
    monkeypatch.setattr(queries, "TURN", 70)
    seen.clear()
    assert sorted(queries.s_listed_tree(spark, sf).collect()) == whole
    bundles = -(-queries.parts(spark, sf).count() // queries.BUNDLE)
    assert len(seen) == 3 and sum(map(len, seen)) == bundles and max(map(len, seen)) < bundles
