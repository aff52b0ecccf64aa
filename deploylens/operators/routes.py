"""Routes and class facts from parsed classes and configuration files: explode, cross, look up.

Every extractor takes DataFrames and gives (routes, classes); ``prio`` and ``pos`` order what is found first."""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import configs, paths
from ..semantics import DEFAULT, Semantics
from .index import by_input

_SPRING = "Lorg/springframework/web/bind/annotation/"
CONTROLLER, REST = "Lorg/springframework/stereotype/Controller;", f"{_SPRING}RestController;"
MAPPING = f"{_SPRING}RequestMapping;"
SHORTCUTS = {f"{_SPRING}{v.title()}Mapping;": v for v in ("GET", "POST", "PUT", "DELETE", "PATCH")}
VERBS = {f"L{ee}/ws/rs/{v};": v for ee in ("javax", "jakarta") for v in ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")}
PATHS = [f"L{ee}/ws/rs/Path;" for ee in ("javax", "jakarta")]
SERVLETS = [f"L{ee}/servlet/annotation/WebServlet;" for ee in ("javax", "jakarta")]
_STRUTS = "Lorg/apache/struts2/convention/annotation/"
ACTION, ACTIONS, NAMESPACE = f"{_STRUTS}Action;", f"{_STRUTS}Actions;", f"{_STRUTS}Namespace;"
WEBWORK_MARKERS = [f"Lcom/opensymphony/{x};" for x in ("webwork/ServletActionContext", "webwork/ActionSupport", "xwork/ActionSupport")]
ORDER = ["prio", "pos"]
EMPTY = "array<string>"


class Context(NamedTuple):
    """What extractors read: classes, xml_files, manifests, inputs (input_id, archive_name)."""

    classes: DataFrame
    xml_files: DataFrame
    manifests: DataFrame
    inputs: DataFrame


class RouteExtractor(Protocol):
    def __call__(self, ctx: Context, semantics: Semantics) -> tuple[DataFrame, DataFrame | None]: ...


def element(annotation: Column, name: str) -> Column:
    """The first element of that name, or null."""
    return F.try_element_at(F.filter(annotation["elements"], lambda e: e["name"] == name), F.lit(1))


def strings(annotation: Column, name: str) -> Column:
    return F.transform(F.coalesce(element(annotation, name)["as_strings"], F.array().cast(EMPTY)), lambda s: F.trim(s))


def values(annotation: Column, *names: str) -> Column:
    return F.concat(*(strings(annotation, n) for n in names))


def present(annotations: Column, kinds: list[str]) -> Column:
    return F.exists(annotations, lambda a: a["type"].isin(*kinds))


def first_value(annotations: Column, kinds: list[str], name: str = "value") -> Column:
    """First non-empty value among annotations of the kinds, else empty."""
    found = F.transform(F.filter(annotations, lambda a: a["type"].isin(*kinds)), lambda a: F.trim(F.coalesce(element(a, name)["as_string"], F.lit(""))))
    return F.coalesce(F.try_element_at(F.filter(found, lambda s: s != ""), F.lit(1)), F.lit(""))


def spring_type(annotations: Column) -> Column:
    found = F.try_element_at(F.filter(annotations, lambda a: a["type"].isin(CONTROLLER, REST)), F.lit(1))["type"]
    return F.when(found == CONTROLLER, "@Controller").when(found == REST, "@RestController")


def base_paths(annotations: Column) -> Column:
    found = F.flatten(F.transform(F.filter(annotations, lambda a: a["type"] == MAPPING), lambda a: values(a, "value", "path")))
    bare = F.transform(found, lambda p: F.when(p == "/", "").otherwise(p))
    return F.when(F.size(bare) > 0, bare).otherwise(F.array(F.lit("")))


def verbs_and_paths(annotations: Column) -> Column:
    """A fold in annotation order: RequestMapping adds verbs and paths, a shortcut sets its verb and adds paths or an empty one."""
    none = F.array().cast(EMPTY)
    verb = F.create_map(*(F.lit(x) for kv in SHORTCUTS.items() for x in kv))

    def step(acc: Column, a: Column) -> Column:
        own = F.filter(values(a, "value", "path"), lambda p: p != "")
        enums = F.coalesce(element(a, "method")["as_enums"], none)
        short = F.try_element_at(verb, a["type"])
        verbs = F.when(a["type"] == MAPPING, F.concat(acc["verbs"], enums)).when(short.isNotNull(), F.array(short)).otherwise(acc["verbs"])
        more = F.when(a["type"] == MAPPING, own).when(short.isNotNull(), F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("")))).otherwise(none)
        return F.struct(verbs.alias("verbs"), F.concat(acc["paths"], more).alias("paths"))

    folded = F.aggregate(annotations, F.struct(none.alias("verbs"), none.alias("paths")), step)
    return F.struct(folded["verbs"].alias("verbs"), F.when(F.size(folded["paths"]) > 0, folded["paths"]).otherwise(F.array(F.lit(""))).alias("paths"))


def has_mapping(annotations: Column) -> Column:
    return present(annotations, [MAPPING, *SHORTCUTS])


def class_rows(classes: DataFrame, kind: Column, prio: int) -> DataFrame:
    full = paths.dotted(F.col("this_class"))
    names = F.transform("class_annotations", lambda a: F.concat(F.lit("@"), paths.simple_annotation(a["type"])))
    return classes.select("input_id", F.lit(prio).alias("prio"), full.alias("full_name"), paths.package_of(full).alias("package"), "file_path", paths.dotted(F.col("super_class")).alias("super_class"), names.alias("annotations"), kind.alias("spring_type"), "archive_name")


def route(prio: int, framework: str, source: str, url: Column, verbs: Column, cls: Column, method: Column, file: Column, archive: Column, pos: Column) -> list[Column]:
    made = {"url": url, "http_methods": verbs, "class_name": cls, "method_name": method, "framework": F.lit(framework), "source_type": F.lit(source), "source_file": file, "archive_name": archive}
    return [F.col("input_id"), F.lit(prio).alias("prio"), pos.alias("pos"), *(F.coalesce(c, F.array().cast(EMPTY) if k == "http_methods" else F.lit("")).alias(k) for k, c in made.items())]


def spring(ctx: Context, semantics: Semantics = DEFAULT, prio: int = 90, framework: str = "Spring MVC") -> tuple[DataFrame, DataFrame]:
    """Controllers' base paths crossed with their methods' paths; no verb means all."""
    found = ctx.classes.filter(present(F.col("class_annotations"), [CONTROLLER, REST]))
    m = found.select("input_id", "archive_name", "file_path", "this_class", base_paths(F.col("class_annotations")).alias("bases"), F.posexplode("methods").alias("i", "m")).filter(has_mapping(F.col("m.annotations")))
    m = m.withColumn("vp", verbs_and_paths(F.col("m.annotations")))
    m = m.select("*", F.posexplode("bases").alias("j", "base")).select("*", F.posexplode("vp.paths").alias("k", "sub"))
    pos = F.struct(F.col("file_path").alias("file"), F.col("archive_name").alias("archive"), F.col("i"), F.col("j"), F.col("k"))
    rows = m.select(*route(prio, framework, "ANNOTATION", paths.join_path(F.col("base"), F.col("sub")), F.col("vp.verbs"), paths.dotted(F.col("this_class")), F.col("m.name"), F.col("file_path"), F.col("archive_name"), pos))
    return rows, class_rows(found, spring_type(F.col("class_annotations")), prio)


def boot_inputs(ctx: Context) -> DataFrame:
    """input_id of the inputs whose manifest has the headers of Spring Boot."""
    return ctx.manifests.filter(configs.is_boot(configs.manifest_main(F.col("manifest")))).select("input_id")


def boot(ctx: Context, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Spring routes again under Spring Boot, for inputs whose manifest has its headers."""
    flagged = boot_inputs(ctx)
    rows, classes = spring(ctx, semantics, 100, "Spring Boot")
    return by_input(rows, flagged, how="left_semi"), by_input(classes, flagged, how="left_semi")


def boot_and_spring(ctx: Context, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """What ``boot`` and ``spring`` find, from one pass over the classes: each row once for each framework of its input."""
    flagged = boot_inputs(ctx).distinct().withColumn("boot", F.lit(True))
    rows, classes = spring(ctx, semantics)
    kind = lambda prio, name: F.struct(F.lit(prio).alias("prio"), F.lit(name).alias("framework"))
    under_boot = [kind(100, "Spring Boot")] + ([] if semantics.boot_supersedes_mvc else [kind(90, "Spring MVC")])
    found = by_input(rows, flagged, how="left").withColumn("as", F.explode(F.when(F.col("boot"), F.array(*under_boot)).otherwise(F.array(kind(90, "Spring MVC")))))
    found = found.withColumn("prio", F.col("as.prio")).withColumn("framework", F.col("as.framework")).select(*rows.columns)
    again = by_input(classes, flagged, how="left").withColumn("prio", F.explode(F.when(F.col("boot"), F.array(F.lit(100), F.lit(90))).otherwise(F.array(F.lit(90)))))
    return found, again.select(*classes.columns)


def jaxrs(ctx: Context, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    found = ctx.classes.withColumn("base", first_value(F.col("class_annotations"), PATHS)).filter("base <> ''")
    m = found.select("input_id", "archive_name", "file_path", "this_class", "base", F.posexplode("methods").alias("i", "m"))
    verb = F.try_element_at(F.create_map(*(F.lit(x) for kv in VERBS.items() for x in kv)), F.try_element_at(F.filter("m.annotations", lambda a: a["type"].isin(*VERBS)), F.lit(1))["type"])
    m = m.withColumn("verb", verb).filter("verb IS NOT NULL")
    pos = F.struct(F.col("file_path").alias("file"), F.col("archive_name").alias("archive"), F.col("i"), F.lit(0).alias("j"), F.lit(0).alias("k"))
    rows = m.select(*route(70, "JAX-RS", "ANNOTATION", paths.join_path(F.col("base"), first_value(F.col("m.annotations"), PATHS)), F.array("verb"), paths.dotted(F.col("this_class")), F.col("m.name"), F.col("file_path"), F.col("archive_name"), pos))
    return rows, class_rows(found, F.lit(""), 70)


def find_class(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """``rows`` with class_path: the file of the class named in ``column``, else the path its name implies; empty for none."""
    index = classes.groupBy("input_id", F.col("this_class").alias("_slash")).agg(F.min("file_path").alias("_file"))
    slash = F.replace(F.trim(F.coalesce(F.col(column), F.lit(""))), F.lit("."), F.lit("/"))
    joined = by_input(rows.withColumn("_slash", slash), index, ["input_id", "_slash"], "left")
    return joined.withColumn("class_path", F.when(F.col("_slash") == "", "").otherwise(F.coalesce("_file", F.concat("_slash", F.lit(".class"))))).drop("_slash", "_file")


def actions(xml: DataFrame, parsed: Column) -> DataFrame:
    """(input_id, entry_name, package, namespace, name, class, method, url) of the actions of parsed files."""
    p = xml.withColumn("_x", parsed).filter("_x IS NOT NULL").select("input_id", "entry_name", F.posexplode("_x.package").alias("i", "p"))
    a = p.select("input_id", "entry_name", "i", F.col("p._name").alias("package"), F.col("p._namespace").alias("ns"), F.posexplode("p.action").alias("j", "a"))
    return a.select("input_id", "entry_name", "i", "j", "package", configs.namespace(F.col("ns")).alias("namespace"), F.coalesce("a._name", F.lit("")).alias("name"), F.coalesce("a._class", F.lit("")).alias("action_class"), configs.action_method(F.col("a._method")).alias("method"), configs.action_url(F.col("ns"), F.col("a._name")).alias("url"))


def _action_routes(ctx: Context, found: DataFrame, prio: int, framework: str, second: int = 0) -> DataFrame:
    placed = by_input(find_class(found, ctx.classes, "action_class"), ctx.inputs)
    pos = F.struct(F.col("entry_name").alias("file"), F.lit("").alias("archive"), (F.col("i") + second).alias("i"), F.col("j"), F.lit(0).alias("k"))
    return placed.select(*route(prio, framework, "XML", F.col("url"), F.array().cast(EMPTY), F.col("action_class"), F.col("method"), F.col("class_path"), F.col("archive_name"), pos))


def struts(ctx: Context, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    xml = ctx.xml_files.filter(configs.is_struts_file(F.col("entry_name")))
    from_xml = _action_routes(ctx, actions(xml, configs.actions_xml(F.col("xml"), "struts")), 80, "Struts2")
    found = ctx.classes.filter(present(F.col("class_annotations"), [ACTION, ACTIONS]))
    m = found.withColumn("ns", first_value(F.col("class_annotations"), [NAMESPACE])).select("input_id", "archive_name", "file_path", "this_class", "ns", F.posexplode("methods").alias("i", "m"))
    m = m.select("*", F.posexplode(F.filter("m.annotations", lambda a: a["type"] == ACTION)).alias("j", "a"))
    pos = F.struct(F.col("file_path").alias("file"), F.col("archive_name").alias("archive"), (F.col("i") + 1_000_000).alias("i"), F.col("j"), F.lit(0).alias("k"))
    own = F.trim(F.coalesce(element(F.col("a"), "value")["as_string"], F.lit("")))
    marked = m.select(*route(80, "Struts2", "ANNOTATION", paths.join_path(F.col("ns"), own), F.array().cast(EMPTY), paths.dotted(F.col("this_class")), F.col("m.name"), F.col("file_path"), F.col("archive_name"), pos))
    return from_xml.unionByName(marked), class_rows(found, F.lit(""), 80)


def uses_webwork(ctx: Context) -> DataFrame:
    """input_id of the inputs that have xwork files or WebWork classes."""
    by_xml = ctx.xml_files.filter(configs.is_xwork_file(F.col("entry_name"))).select("input_id")
    by_class = ctx.classes.filter(F.col("this_class").rlike("com/opensymphony/(webwork|xwork)") | present(F.col("class_annotations"), WEBWORK_MARKERS)).select("input_id")
    return by_xml.union(by_class).distinct()


def webwork(ctx: Context, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    flagged = uses_webwork(ctx)
    name = F.col("entry_name")
    rows = _action_routes(ctx, actions(ctx.xml_files.filter(configs.is_xwork_file(name)), configs.xwork_xml(F.col("xml"))), 75, "WebWork")
    if semantics.struts_as_webwork:
        again = ctx.xml_files.filter(configs.is_struts_file(name) & ~configs.is_xwork_file(name))
        rows = rows.unionByName(_action_routes(ctx, actions(again, configs.actions_xml(F.col("xml"), "struts")), 75, "WebWork", 1_000_000))
    own = by_input(ctx.classes.filter(F.col("this_class").rlike("com/opensymphony/webwork|com/opensymphony/xwork|com/eway")).drop("archive_name"), ctx.inputs)
    return by_input(rows, flagged, how="left_semi"), by_input(class_rows(own, F.lit(""), 75), flagged, how="left_semi")


def _mappings(w: Column, mapping: str, names: str, key: str, value: str, fallback: bool, second: int, every: bool) -> Column:
    """(i, j, pattern, cls) of the mappings of a descriptor: each looks up the last class given to its name, in the same row."""
    named = F.transform(F.coalesce(w[names], F.array()), lambda d: F.struct(F.trim(d[key]).alias("key"), F.trim(d[value]).alias("found")))

    def one(m: Column, i: Column) -> Column:
        own = F.trim(F.coalesce(m[key], F.lit("")))
        found = F.try_element_at(F.filter(named, lambda d: d["key"] == own), F.lit(-1))["found"]
        cls = F.coalesce(F.nullif(found, F.lit("")), own) if fallback else F.coalesce(found, F.lit(""))
        patterns = F.when(F.size(m["url-pattern"]) > 0, m["url-pattern"]).otherwise(F.array(F.lit(""))) if every else F.array(m["url-pattern"])
        return F.transform(patterns, lambda p, j: F.struct((i + second).alias("i"), j.alias("j"), F.coalesce(p, F.lit("")).alias("pattern"), cls.alias("cls")))

    return F.flatten(F.transform(F.coalesce(w[mapping], F.array()), one))


def servlet(ctx: Context, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    every = semantics.all_url_patterns
    web = ctx.xml_files.filter(configs.is_web_file(F.col("entry_name"))).select("input_id", "entry_name", configs.web_xml(F.col("xml"), every).alias("w"))
    w = F.col("w")
    both = F.concat(_mappings(w, "servlet-mapping", "servlet", "servlet-name", "servlet-class", False, 0, every), _mappings(w, "filter-mapping", "filter", "filter-name", "filter-class", True, 1_000_000, every))
    mapped = web.select("input_id", "entry_name", F.explode(both).alias("m")).select("input_id", "entry_name", "m.*")
    placed = by_input(find_class(mapped, ctx.classes, "cls"), ctx.inputs)
    pos = F.struct(F.col("entry_name").alias("file"), F.lit("").alias("archive"), F.col("i"), F.col("j"), F.lit(0).alias("k"))
    rows = placed.select(*route(60, "Servlet", "XML", paths.servlet_pattern(F.col("pattern")), F.array().cast(EMPTY), F.col("cls"), F.lit(""), F.col("class_path"), F.col("archive_name"), pos))
    found = ctx.classes.withColumn("ann", F.try_element_at(F.filter("class_annotations", lambda a: a["type"].isin(*SERVLETS)), F.lit(1))).filter("ann IS NOT NULL")
    m = found.select("input_id", "archive_name", "file_path", "this_class", F.posexplode(F.filter(values(F.col("ann"), "value", "urlPatterns"), lambda p: p != "")).alias("i", "pattern"))
    pos = F.struct(F.col("file_path").alias("file"), F.col("archive_name").alias("archive"), (F.col("i") + 2_000_000).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"))
    marked = m.select(*route(60, "Servlet", "ANNOTATION", paths.servlet_pattern(F.col("pattern")), F.array().cast(EMPTY), paths.dotted(F.col("this_class")), F.lit(""), F.col("file_path"), F.col("archive_name"), pos))
    return rows.unionByName(marked), class_rows(found.drop("ann"), F.lit(""), 60)


EXTRACTORS: tuple[RouteExtractor, ...] = (boot_and_spring, struts, webwork, jaxrs, servlet)


def extract(ctx: Context, semantics: Semantics = DEFAULT, extractors: tuple[RouteExtractor, ...] = EXTRACTORS) -> tuple[DataFrame, DataFrame]:
    """The union of all extractors' routes and classes; every class of the inputs comes last."""
    routes, classes = None, None
    for fn in extractors:
        r, c = fn(ctx, semantics)
        routes = r if routes is None else routes.unionByName(r)
        if c is not None:
            classes = c if classes is None else classes.unionByName(c)
    every = class_rows(ctx.classes, F.coalesce(spring_type(F.col("class_annotations")), F.lit("")), 0)
    return routes, (every if classes is None else classes.unionByName(every))
