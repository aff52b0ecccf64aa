import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deploylens import synth
from deploylens.functions import bytecode, configs, java_source, paths

NAME = st.text(st.characters(min_codepoint=97, max_codepoint=122), min_size=1, max_size=8)


@given(NAME, st.lists(st.tuples(NAME, st.dictionaries(NAME, st.lists(st.text(max_size=8), max_size=3), max_size=3)), max_size=3))
@settings(max_examples=60, deadline=None)
def test_encoding_then_decoding_gives_the_same(name, marks):
    made = bytecode.decode(bytecode.encode(f"a/{name}", annotations=[(f"L{k};", v) for k, v in marks]))
    assert made["this_class"] == f"a/{name}"
    assert [a["type"] for a in made["class_annotations"]] == [f"L{k};" for k, _ in marks]
    for a, (_, wanted) in zip(made["class_annotations"], marks, strict=True):
        assert {e["name"]: e["as_strings"] for e in a["elements"]} == {k: [s for s in v if s] for k, v in wanted.items()}


@given(st.integers(0, 700))
@settings(max_examples=80, deadline=None)
def test_truncation_is_a_row_or_a_value_error(n):
    try:
        bytecode.decode(synth.spring_class(5, "b")[:n])
    except ValueError:
        pass


def test_descriptor():
    assert bytecode.type_names("(Ljava/lang/String;I)Ljava/util/List;") == (["String", "int"], "List")
    assert bytecode.type_names("([[JLa/B;)V") == (["long[][]", "B"], "void")
    assert bytecode.type_names("odd") == ([], "odd")


def test_counts_past_the_end_read_as_zero_and_bytes_are_an_error():
    assert bytecode.Cursor(b"\1").u2() == 0
    with pytest.raises(ValueError):
        bytecode.Cursor(b"\1").take(2)


def test_visible_annotations_hide_invisible_ones():
    pool = bytecode.Pool(bytecode.Cursor(b"\0\2\1\0\3La;"))
    one = b"\0\1\0\1\0\0"
    both = [("RuntimeInvisibleAnnotations", one), ("RuntimeVisibleAnnotations", b"\0\0")]
    assert bytecode.annotations(both, pool) == []
    assert bytecode.annotations(both[:1], pool) == [{"type": "La;", "elements": []}]


def test_source_without_a_class_is_unknown():
    made = java_source.decode("package a; void f(int x) {}")
    assert made["this_class"] == "a/Unknown" and made["super_class"] == "java/lang/Object" and made["class_annotations"] == []


def test_many_annotations_take_no_time():
    began = time.time()
    java_source.decode("class A {" + "@B\n" * 400 + "public void x(" + " word" * 2000)
    assert time.time() - began < 5


def test_long_return_types_keep_their_annotations():
    kinds = ", ".join(f"Kind{k}" for k in range(30))
    source = f'class A {{ @GetMapping("/x") @Deprecated public static Map<A, List<{kinds}>> f(@Valid String a, final int[] b) {{ return new B(1); }} <T> T[] g(){{}} }}'
    f, _, g = java_source.decode(source)["methods"]
    assert (f["name"], f["return_type"], f["param_types"], len(f["annotations"])) == ("f", "Map", ["String", "int[]"], 2)
    assert [e["as_strings"] for e in f["annotations"][0]["elements"]] == [["/x"]]
    assert (g["name"], g["return_type"]) == ("g", "T")


def test_headers():
    names = lambda s: (lambda d: (d["this_class"], d["super_class"], d["interfaces"], [a["type"] for a in d["class_annotations"]]))(java_source.decode(s))
    assert names('@Path("/a")\n@Service public final class A extends b.C<D> implements E, f.G {}') == ("A", "b/C", ["E", "f.G"], ["Ljavax/ws/rs/Path;", "Lorg/springframework/stereotype/Service;"])
    assert names("class A<T> { class B {} }")[0] == "B"  # a header with type parameters is no plain one
    assert names("@interface M { } ")[0] == "M" and names("interface I;")[0] == "I"
    assert names("@Service sealed class A {}")[3] == []
    calls = [(m["name"], m["return_type"]) for m in java_source.decode("class A { void f() { throw new X(1); g(); return h(2); } int k(int a){} }")["methods"]]
    assert calls == [("f", "void"), ("X", "throw new"), ("h", "return"), ("k", "int")]


def test_annotation_values():
    kinds = lambda s: [(e["name"], e["tag"], e["as_strings"], e["as_enums"]) for e in java_source.elements(s)]
    assert kinds('("/a")') == [("value", "s", ["/a"], [])]
    assert kinds('(value = {"/a", "/b"}, method = R.GET)') == [("value", "[", ["/a", "/b"], []), ("method", "e", [], ["GET"])]
    assert kinds("(Consts.PATH)") == [("value", "e", [], ["PATH"])]
    assert kinds("") == []


def test_overloads_share_annotations_by_name_unless_told():
    source = 'class A { @GetMapping("/x") public void f() {} public void f(int a) {} }'
    assert [len(m["annotations"]) for m in java_source.decode(source)["methods"]] == [1, 1]
    assert [len(m["annotations"]) for m in java_source.decode(source, True)["methods"]] == [1, 0]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_golden_names(spark):
    name = F.col("n")
    assert one(spark, paths.jar_name(name), n="spring-webmvc-5.1.18.RELEASE.jar.src.zip") == "spring-webmvc-5.1.18.RELEASE.jar"
    assert one(spark, paths.jar_name(name), n="spring-webmvc-5.1.18.RELEASE.jar.src") == "spring-webmvc-5.1.18.RELEASE.jar"
    assert one(spark, paths.jar_display(name), n="spring-webmvc.jar.src.zip") == "spring-webmvc.jar"
    assert one(spark, paths.simple_annotation(name), n="Lorg/springframework/web/bind/annotation/RequestMapping;") == "RequestMapping"
    assert one(spark, configs.action_url(F.lit("/"), name), n="user_*") == "/user_{wildcard}.action"


def test_malformed_xml_is_null(spark):
    for bad in ("<web-app><servlet>", "no xml", "<web-app>&nope;</web-app>", "<other/>"):
        assert one(spark, configs.web_xml(F.col("n")).isNull(), n=bad)


def test_normalising_twice_changes_nothing(spark):
    for url in ("", "/", "//a//b/", "a", "/a/"):
        once = one(spark, paths.normalize_url(F.col("n")), n=url)
        assert one(spark, paths.normalize_url(F.col("n")), n=once) == once
