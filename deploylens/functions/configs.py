"""web.xml, struts and xwork files, and manifests, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A list element with the same tag twice: arrays keep all, scalars the last.
_WEB = """
`servlet` array<struct<`servlet-name`:string,`servlet-class`:string>>,
`servlet-mapping` array<struct<`servlet-name`:string,`url-pattern`:{pattern}>>,
`filter` array<struct<`filter-name`:string,`filter-class`:string>>,
`filter-mapping` array<struct<`filter-name`:string,`url-pattern`:{pattern}>>,
`listener` array<struct<`listener-class`:string>>,
`context-param` array<struct<`param-name`:string,`param-value`:string>>,
_corrupt string
"""
_ACTIONS = """
`package` array<struct<_name:string,_namespace:string,_extends:string,_abstract:string,
  `action`:array<struct<_name:string,_class:string,_method:string,`result`:array<struct<_name:string,_type:string,_VALUE:string>>>>>>,
`constant` array<struct<_name:string,_value:string>>,
`include` array<struct<_file:string>>,
_corrupt string
"""
#: Filter classes that mark a Struts application. Fixed values.
STRUTS_FILTERS = (
    "org.apache.struts2.dispatcher.FilterDispatcher",
    "org.apache.struts2.dispatcher.ng.filter.StrutsPrepareAndExecuteFilter",
    "org.apache.struts.dispatcher.FilterDispatcher",
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "attributePrefix": "_", "valueTag": "_VALUE"}


def strip_doctype(xml: Column) -> Column:
    """Without the first declaration up to its first closing bracket."""
    return F.regexp_replace(xml, r"(?s)^(.*?)<!DOCTYPE[^>]*>", "$1")


def root_name(xml: Column) -> Column:
    """Local name of the root element; never fails."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>|<![A-Z][^>]*>", "")
    return F.regexp_extract(bare, r"<(?:[\w.-]+:)?([\w.-]+)", 1)


def web_xml(xml: Column, all_patterns: bool = False) -> Column:
    """The parsed descriptor, null where the text is no well-formed web-app."""
    pattern = "array<string>" if all_patterns else "string"
    parsed = F.from_xml(xml, _WEB.format(pattern=pattern).replace("\n", " "), _OPTIONS)
    return F.when((root_name(xml) == "web-app") & parsed["_corrupt"].isNull(), parsed)


def actions_xml(xml: Column, root: str) -> Column:
    """The parsed file, null where it is not well formed or has another root."""
    parsed = F.from_xml(strip_doctype(xml), _ACTIONS.replace("\n", " "), _OPTIONS)
    return F.when((root_name(xml) == root) & parsed["_corrupt"].isNull(), parsed)


def xwork_xml(xml: Column) -> Column:
    """An xwork file with a package, else a struts file with one."""
    some = lambda x: F.when(F.size(x["package"]) > 0, x)
    return F.coalesce(some(actions_xml(xml, "xwork")), some(actions_xml(xml, "struts")))


def namespace(ns: Column) -> Column:
    n = F.coalesce(ns, F.lit(""))
    return F.when(n == "", "/").when(F.startswith(n, F.lit("/")), n).otherwise(F.concat(F.lit("/"), n))


def action_method(method: Column) -> Column:
    return F.coalesce(F.nullif(method, F.lit("")), F.lit("execute"))


def action_url(ns: Column, name: Column) -> Column:
    """Namespace, name with stars spelled out, and ``.action``."""
    shown = F.replace(F.coalesce(name, F.lit("")), F.lit("*"), F.lit("{wildcard}"))
    return F.regexp_replace(F.concat(namespace(ns), F.lit("/"), shown, F.lit(".action")), "/{2,}", "/")


def has_struts_filter(web: Column) -> Column:
    return F.coalesce(F.exists(web["filter"], lambda f: f["filter-class"].isin(*STRUTS_FILTERS)), F.lit(False))


def is_xwork_file(name: Column) -> Column:
    return F.lower(name).rlike(r"(?:^|/)xwork[^/]*\.xml$")


def is_struts_file(name: Column) -> Column:
    return F.lower(name).rlike(r"(?:^|/)struts[^/]*\.xml$")


def is_web_file(name: Column) -> Column:
    return F.lower(name).rlike(r"web\.xml$")


def _headers(block: Column) -> Column:
    joined = F.regexp_replace(block, r"\r?\n ", "")
    lines = F.filter(F.split(joined, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def manifest_main(text: Column) -> Column:
    """Main headers: those before the first Name:. Of a key that repeats, the last counts; blank values go."""
    pairs = _headers(F.regexp_replace(text, r"(?s)(?:^|\r?\n)Name:.*$", ""))
    # a lambda's variable stands for the headers, so that they are made once and not for each of them
    last = F.transform(F.array(pairs), lambda every: F.filter(every, lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(last[0])


def manifest_sections(text: Column, every: bool = False) -> Column:
    """(name, headers) of the named sections; without ``every``, all headers after the first Name: are in its section."""
    rest = F.regexp_extract(text, r"(?s)(?:^|\r?\n)(Name:.*)$", 1)
    parts = F.split(F.regexp_replace(rest, r"\r?\nName:", "\n\x01Name:"), "\n\x01") if every else F.array(rest)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^Name:([^\r\n]*)", 1)).alias("name"), _headers(p).alias("headers")))


def is_boot(main: Column) -> Column:
    """Whether either Spring Boot header is there."""
    return (F.coalesce(main["Spring-Boot-Classes"], F.lit("")) != "") | (F.coalesce(main["Spring-Boot-Lib"], F.lit("")) != "")


# Spring files --------------------------------------------------------------------------------

_BEANS = """
`bean` array<struct<_id:string,_class:string,_name:string,_scope:string,`property`:array<struct<_name:string,_value:string,_ref:string>>>>,
`context:component-scan` array<struct<`_base-package`:string>>,
`import` array<struct<_resource:string>>,
_corrupt string
"""
#: Keys of spring.factories that mark auto-configuration, and the launchers of executable archives. Fixed values.
AUTO_CONFIG = ("org.springframework.boot.autoconfigure.EnableAutoConfiguration", "org.springframework.context.ApplicationContextInitializer")
LAUNCHERS = tuple(f"org.springframework.boot.loader.{x}Launcher" for x in ("Jar", "War", "Properties"))


def spring_beans(xml: Column) -> Column:
    """The parsed beans file, null where it is none."""
    parsed = F.from_xml(strip_doctype(xml), _BEANS.replace("\n", " "), _OPTIONS)
    return F.when((root_name(xml) == "beans") & parsed["_corrupt"].isNull(), parsed)


def spring_factories(text: Column) -> Column:
    """(key, values) of the lines of a spring.factories file, line by line; comments and lines without a sign are skipped."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"\\+\z", ""))
    kept = F.filter(lines, lambda x: (F.instr(x, "=") > 0) & ~F.startswith(x, F.lit("#")))

    def pair(x: Column) -> Column:
        values = F.filter(F.transform(F.split(F.regexp_replace(x, "^[^=]*=", ""), ","), lambda v: F.trim(v)), lambda v: v != "")
        return F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), values.alias("values"))

    return F.transform(kept, pair)


def has_auto_config(factories: Column) -> Column:
    return F.exists(factories, lambda p: p["key"].isin(*AUTO_CONFIG))


def is_boot_launcher(name: Column) -> Column:
    return name.isin(*LAUNCHERS)
