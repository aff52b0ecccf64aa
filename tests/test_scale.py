"""Work that must not grow with anything but the rows."""

import io
import warnings
import zipfile

import pytest

from deploylens import queries, synth
from deploylens.functions import java_source
from deploylens.semantics import DEFAULT
from deploylens.sources import archives


def test_frameworks_are_shown_once_each(spark):
    """Evidence and versions are made in the rows that show them, not for every framework before those are picked."""
    plan = queries.d_framework_evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    picked = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(picked) == 1 and "notes" not in picked[0] and "versions" not in picked[0]


@pytest.mark.parametrize("name", ["e2e_full", "d_framework_evidence", "d_frameworks", "e_boot_dup", "e_filter_join", "e_find_class", "e_servlet_join", "e_struts_ann", "e_struts_xml", "e_webservlet", "e_webwork"])
def test_no_relation_of_inputs_is_sent_whole(spark, name):
    """Spark takes rows made of a small table for few, and what grows with it must still not go to the driver and to every executor."""
    assert "Broadcast" not in queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_entries_that_are_held_take_no_memory(spark):
    rows = queries.held(spark, "/root/testdata/sf0.001")
    assert rows.storageLevel.useDisk and not rows.storageLevel.useMemory
    rows.unpersist()


def test_nothing_is_joined_with_no_files(spark):
    """Where there are no descriptors, classes are decoded once and not looked up for them."""
    plan = queries.e_webservlet(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def written(files: list) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, data, stored in files:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def test_archives_are_those_of_the_library():
    files = [("a.txt", "x" * 500, False), ("d/é.bin", bytes(range(256)), True), ("a.txt", b"", False), ("b/c.class", b"\xca\xfe", True)]
    for some in ([], files[:1], files):
        assert synth.packed(some) == written(some)


@pytest.mark.parametrize("light", [False, True])
def test_small_entries_are_read_as_streams_are(light):
    """Whole archives, and such with any byte changed or cut off: the same rows with the bytes at hand and without."""
    every = frozenset({"class", "java", "xml", "manifest", "jar"})

    def rows(data: bytes, held: bytes | None):
        try:
            return archives.Walk(1, every, DEFAULT, light=light).all(io.BytesIO(data), "a.war", data=held)
        except Exception as e:
            return repr(e)

    whole = synth.archive(385, "brand12", 7)
    assert len(rows(whole, whole)) > 8
    bad = [whole[:n] + bytes([whole[n] ^ x]) + whole[n + 1 :] for n in range(0, len(whole), 3) for x in (1, 0x48)]
    for data in [whole, synth.archive(26, "é", 3), b"PK" + whole, whole + b"tail", whole[:-9], *bad]:
        assert rows(data, data) == rows(data, None)


def test_an_entry_of_many_bytes_is_still_read():
    data = synth.packed([("a.xml", b"<a>" + b" " * archives.SMALL + b"</a>", False)])
    assert len(archives.Walk(1, frozenset({"xml"}), DEFAULT).all(io.BytesIO(data), "a.jar", data=data)[0]["data"]) == archives.SMALL + 7


def test_a_light_source_has_no_methods():
    full, light = java_source.decode(synth.java_source(4, "b")), java_source.decode(synth.java_source(4, "b"), light=True)
    assert full["methods"] and light == full | {"methods": []}


def test_versions_by_one_expression(spark):
    """Against a regular expression for each catalogue entry, the first that matches."""
    import dataclasses
    import re

    from pyspark.sql import functions as F

    from deploylens.functions import paths
    from deploylens.operators import detect

    tails = ["-1.2.jar", "-1.2.3.RELEASE.jar", "-1.jar", "-1.2", "1.2.jar", "4-4.1.jar", "-x-1.2.jar", "-1.2-3.4.jar", "-1.2.JAR", "-1.2.jar\n", ".jar", "-1.0_b-SNAPSHOT.jar"]
    names = [h + t for _, _, _, literal in detect.catalog_rows() for h in (literal, literal.upper(), f"a{literal}", literal.replace("k", "K"), literal.replace("s", "ſ")) for t in tails] + ["", "-1.2.jar"]
    jars = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    for fixed in (False, True):
        semantics = dataclasses.replace(DEFAULT, fixed_commons_collections=fixed)
        rows = {r["name"]: r["hit"] for r in jars.select("name", detect.versioned(F.col("name"), semantics).alias("hit")).collect()}
        assert rows.pop(None) is None
        for name, hit in rows.items():
            want = None
            for k, n, c, literal in detect.catalog_rows():
                middle = "-" if literal != detect.NO_DASH else "4?-" if fixed else ""
                m = re.match(rf"(?i)\A{re.escape(literal)}{middle}({paths.VERSION})\.jar\Z", name.replace("K", "k"), re.ASCII)
                if m and want is None:
                    want = (k, n, c, m[1])
            assert (hit and tuple(hit)) == want, name


def test_a_manifest_is_split_once(spark):
    """Its headers are made once for all that is asked of them."""
    from pyspark.sql import functions as F

    from deploylens.functions import configs
    from deploylens.operators import marks

    rows = spark.createDataFrame([("A: 1\r\nB: 2\r\nA: 3\r\nSpring-Boot-Version: 2.1\r\n",), (None,)], "m string")
    bits, version = marks._boot(configs.manifest_main(F.col("m")))
    found = rows.select(bits.alias("bits"), version.alias("version"), configs.manifest_main(F.col("m")).alias("main"))
    assert found._jdf.queryExecution().analyzed().toString().count("Name:.*") == 3  # one a column
    assert {r["version"]: r["main"] for r in found.collect()}["2.1"] == {"A": "3", "B": "2", "Spring-Boot-Version": "2.1"}


def test_bundles_are_dealt(spark):
    """Few bytes give much work, so adaptive execution must not put them together."""
    assert queries.by_bundle(spark, "/root/testdata/sf0.001")._df.rdd.getNumPartitions() == 8


def test_artefacts_are_made_and_decoded_in_slices(spark):
    """What a task holds does not grow with its rows, and a slice's end loses none."""
    rows = spark.range(synth.AT_ONCE * 2 + 7).withColumnRenamed("id", "k").coalesce(1)
    assert synth.made(rows.repartition(1), lambda r: b"x" * (r["k"] % 7)).selectExpr("count(distinct k) n", "sum(length(data)) s").first()[:] == (1007, sum(k % 7 for k in range(1007)))


@pytest.mark.parametrize("name", ["c_class_header", "j_ann_values", "k_classes_view", "s_corrupt_inner"])
def test_artefacts_are_made_and_read_in_one_pass(spark, name):
    """No worker is given what another has made: contents would come to it by as many rows as a batch of Spark's has."""
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_archives_are_walked_one_at_a_time(spark):
    taken = []

    def some():
        for k in range(5000):
            taken.append(k)
            yield k, f"app{k}.war", synth.archive(k, "brand", 1) if k % 3 else None

    first = next(archives.walked(some(), archives.arrow_schema(), frozenset({"jar"})))
    assert first.num_rows == 500 and len(taken) < 500
