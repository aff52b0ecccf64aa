"""What tells the frameworks of an input, as flags of its entries that are merged by or.

Each class, file and manifest gives a number with a bit for each thing it is a mark of, and its name where that serves as
evidence. One aggregation merges them to a row an input: what has been merged may be merged again, so each task sends one row for an
input, with the few names that are evidence, whatever the number of classes and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import configs
from ..semantics import DEFAULT, Semantics
from . import detect
from . import routes as R

_NAMES = (
    "mvc", "rest", "servlet_class", "struts_class", "action_support", "webwork_class", "webwork_marker", "eway_class", "eway_base",
    "struts_file", "xwork_file", "eway_file", "eway_default", "web_file", "main_web_file", "main_filter", "other_filter", "boot",
)
BIT = {name: 1 << k for k, name in enumerate(_NAMES)}
#: Marks whose bearers are named as evidence.
EVIDENCE = sum(BIT[n] for n in ("servlet_class", "action_support", "eway_base", "struts_file", "xwork_file", "eway_file", "eway_default", "web_file"))
NOTE = "struct<bits:long,name:string>"
VERSION = "struct<visit_seq:long,jar_name:string,component:string,version:string>"


def _sum(**marks: Column) -> Column:
    return sum((F.when(c, F.lit(BIT[n])).otherwise(0) for n, c in marks.items()), F.lit(0)).cast("long")


def of_class(cls: Column, parent: Column, annotations: Column) -> Column:
    """Bits of a class."""
    return _sum(
        mvc=R.present(annotations, [R.CONTROLLER, R.REST]), rest=R.present(annotations, R.PATHS), servlet_class=R.present(annotations, R.SERVLETS),
        struts_class=R.present(annotations, [R.ACTION, R.ACTIONS, R.NAMESPACE]), action_support=F.contains(parent, F.lit("ActionSupport")),
        webwork_class=cls.rlike("com/opensymphony/(webwork|xwork)"), webwork_marker=R.present(annotations, R.WEBWORK_MARKERS),
        eway_class=F.contains(cls, F.lit(detect.EWAY)), eway_base=F.contains(cls, F.lit(f"{detect.EWAY}/framework")),
    )


def of_file(name: Column, xml: Column | None = None) -> Column:
    """Bits of a descriptor; filters are looked for where its text is given."""
    xwork, main = configs.is_xwork_file(name), name == "WEB-INF/web.xml"
    web, marks = configs.is_web_file(name), {}
    if xml is not None:
        named = sum((F.contains(xml, F.lit(c)).cast("int") for c in configs.STRUTS_FILTERS), F.lit(0)) > 0
        has = F.when(web & named, configs.has_struts_filter(configs.web_xml(xml)))  # few files are parsed
        marks = {"main_filter": main & has, "other_filter": web & has}
    return _sum(
        struts_file=configs.is_struts_file(name), xwork_file=xwork, eway_file=xwork & F.contains(name, F.lit(detect.EWAY)),
        eway_default=F.endswith(F.lower(name), F.lit("webwork-default.xml")), web_file=web, main_web_file=main, **marks,
    )


def _note(bits: Column, name: Column) -> Column:
    return F.when(bits.bitwiseAND(F.lit(EVIDENCE)) != 0, F.struct(bits.alias("bits"), name.alias("name")))


def _boot(main: Column) -> tuple[Column, Column]:
    once = F.transform(F.array(main), lambda m: F.struct(_sum(boot=configs.is_boot(m)).alias("bits"), F.coalesce(m["Spring-Boot-Version"], F.lit("")).alias("version")))[0]
    return once["bits"], once["version"]


def _version(jar: Column, visit: Column, semantics: Semantics) -> Column:
    hit = detect.version_hit(jar, semantics)
    return F.when(hit["component"].isin(*detect.VERSION_COMPONENTS), F.struct(visit.alias("visit_seq"), jar.alias("jar_name"), hit["component"].alias("component"), hit["version"].alias("version")))


def merged(rows: DataFrame) -> DataFrame:
    """A row an input of (input_id, bits, note, boot_version, version)."""
    return rows.groupBy("input_id").agg(F.bit_or("bits").alias("bits"), F.collect_list("note").alias("notes"), F.collect_list("boot_version").alias("boots"), F.collect_list("version").alias("versions")).select(
        "input_id", "bits", "notes", F.coalesce(F.try_element_at("boots", F.lit(1)), F.lit("")).alias("boot_version"), "versions"
    )


def of_entries(entries: DataFrame, semantics: Semantics = DEFAULT, filters: bool = False) -> DataFrame:
    """Marks of each input, in one pass over its entries."""
    kind, name = F.col("kind"), F.col("entry_name")
    java, text = kind.isin("class", "java") & F.col("parsed").isNotNull(), F.col("data").cast("string")
    by_class = of_class(F.col("parsed.this_class"), F.col("parsed.super_class"), F.col("parsed.class_annotations"))
    by_file = of_file(name, text if filters else None)
    head_bits, head_version = _boot(configs.manifest_main(text))
    is_file, is_head = (kind == "xml") & F.col("data").isNotNull(), (kind == "manifest") & F.col("data").isNotNull()
    bits = F.when(java, by_class).when(is_file, by_file).when(is_head, head_bits).otherwise(0).cast("long")
    rows = entries.filter("NOT superseded").select("input_id", bits.alias("bits"), F.when(java, F.col("parsed.this_class")).otherwise(name).alias("name"), F.when(is_head, head_version).alias("boot_version"), F.when(kind == "jar", _version(name, F.col("visit_seq"), semantics)).alias("version"))
    return merged(rows.select("input_id", "bits", _note(F.col("bits"), F.col("name")).alias("note"), "boot_version", "version"))


def of_context(ctx: R.Context, jars: DataFrame, semantics: Semantics = DEFAULT, filters: bool = False) -> DataFrame:
    """The same of relations that stand for themselves."""
    none = {"note": F.lit(None).cast(NOTE), "boot_version": F.lit(None).cast("string"), "version": F.lit(None).cast(VERSION)}

    def rows(df: DataFrame, bits: Column, **more: Column) -> DataFrame:
        return df.select("input_id", bits.cast("long").alias("bits"), *((more.get(k, v)).alias(k) for k, v in none.items()))

    c = ctx.classes.withColumn("_bits", of_class(F.col("this_class"), F.col("super_class"), F.col("class_annotations")))
    f = ctx.xml_files.withColumn("_bits", of_file(F.col("entry_name"), F.col("xml") if filters else None))
    head_bits, head_version = _boot(configs.manifest_main(F.col("manifest")))
    every = rows(c, F.col("_bits"), note=_note(F.col("_bits"), F.col("this_class"))).unionByName(rows(f, F.col("_bits"), note=_note(F.col("_bits"), F.col("entry_name"))))
    every = every.unionByName(rows(ctx.manifests, head_bits, boot_version=head_version)).unionByName(rows(jars, F.lit(0), version=_version(F.col("jar_name"), F.col("visit_seq"), semantics)))
    return merged(every)


def has(*names: str) -> Column:
    """Whether a row of marks has any of these."""
    return F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.lit(sum(BIT[n] for n in names))) != 0


def named(mark: str, most: int | None = None) -> Column:
    """Names of the bearers of a mark, in order, each once; the first few, if asked."""
    notes = F.coalesce(F.col("notes"), F.array().cast(f"array<{NOTE}>"))
    found = F.array_sort(F.array_distinct(F.transform(F.filter(notes, lambda n: n["bits"].bitwiseAND(F.lit(BIT[mark])) != 0), lambda n: n["name"])))
    return found if most is None else F.slice(found, 1, most)


def version_of(*components: str) -> Column:
    """The version by the first jar of the first of these components that has one."""
    held = F.array_sort(F.coalesce(F.col("versions"), F.array().cast(f"array<{VERSION}>")))
    first = lambda n: F.try_element_at(F.filter(held, lambda v: v["component"] == n), F.lit(1))["version"]
    return F.coalesce(*map(first, components), F.lit(""))


def gates() -> dict[str, Column]:
    """By framework: whether its extractor has anything to do with an input of these marks. The filters of WEB-INF/web.xml count, or those of others where there is none."""
    filtered = F.when(has("main_web_file"), has("main_filter")).otherwise(has("other_filter"))
    return {
        "spring": has("mvc"), "boot": has("boot"), "struts": has("struts_file", "struts_class", "action_support") | filtered,
        "webwork": has("xwork_file", "webwork_class", "webwork_marker"), "rest": has("rest"), "servlet": has("web_file", "servlet_class"),
    }
