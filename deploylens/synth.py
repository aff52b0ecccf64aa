"""Artefacts made from table rows inside the job: class files, sources, descriptors and archives, for round trips."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .functions import bytecode
from .operators import detect
from .operators import routes as R

VERBS = ("", "GET", "POST", "PUT", "DELETE", "PATCH")
LITERALS = [r[3] for r in detect.catalog_rows() if r[3] != detect.NO_DASH]


#: Rows whose artefacts a task holds at once.
AT_ONCE = 500


def dealt(rows: DataFrame) -> DataFrame:
    """A row is small and its artefact takes time, so a table in one file is dealt over all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def artefacts(batches: Iterator[pa.RecordBatch], fn: Callable[[dict], bytes]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """So many of a task's rows at once, with the artefact of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part, [fn(r) for r in part.to_pylist()]


def made(rows: DataFrame, fn: Callable[[dict], bytes], keep: str = "k long") -> DataFrame:
    """``rows`` with ``data``, the artefact of each."""
    names = [c.split()[0] for c in keep.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in artefacts(batches, fn):
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(data, pa.binary())], [*names, "data"])

    return dealt(rows).mapInArrow(each, f"{keep}, data binary")


def spring_class(k: int, brand: str) -> bytes:
    """A controller below its brand, with a method by its key's verb and a list method that has two paths."""
    kind = R.CONTROLLER if k % 2 == 0 else R.REST
    verb = VERBS[k % 6]
    if verb in ("", "PUT"):
        marks = {"value": f"/{k}"} | ({"method": [("e", "LRequestMethod;", verb)]} if verb else {})
        one = (R.MAPPING, marks)
    else:
        one = (next(d for d, v in R.SHORTCUTS.items() if v == verb), {"path": [f"{k}"]})
    many = (next(d for d, v in R.SHORTCUTS.items() if v == "GET"), {"value": ["list", "/all/"]})
    return bytecode.encode(f"com/acme/web/Part{k}", annotations=[(kind, {}), (R.MAPPING, {"value": [f"/{brand}/"]})], methods=[("one", "(Ljava/lang/String;I)Ljava/util/List;", [one]), ("many", "()V", [many]), ("helper", "([J)Z", [])], major=45 + k % 24)


def jaxrs_class(k: int) -> bytes:
    ee = "javax" if k % 2 else "jakarta"
    methods = [("get", "()V", [(f"L{ee}/ws/rs/GET;", {}), (f"L{ee}/ws/rs/Path;", {"value": f"{{id}}/{k}"})]), ("del", "()V", [(f"L{ee}/ws/rs/DELETE;", {})]), ("none", "()V", [(f"L{ee}/ws/rs/Path;", {"value": "x"})])]
    return bytecode.encode(f"com/acme/rest/Res{k}", annotations=[(f"L{ee}/ws/rs/Path;", {"value": f"res{k}"})], methods=methods)


def struts_class(k: int) -> bytes:
    return bytecode.encode(f"com/acme/act/Act{k}", "com/opensymphony/xwork2/ActionSupport", [(R.NAMESPACE, {"value": "/ns"}), (R.ACTION, {"value": "ignored"})], [("run", "()V", [(R.ACTION, {"value": f"run{k}"})]), ("other", "()V", [])])


def java_source(k: int, brand: str) -> str:
    return f"""// package not.this;
package com.acme.src;
import javax.servlet.annotation.WebServlet; /* import a.b.Controller; */
import org.example.marks.*;
import org.springframework.web.bind.annotation.RequestMethod;

@WebServlet(urlPatterns = {{"/src/{k}", "*.p{k % 5}"}}, name = "s")
@Deprecated
public class Src{k} extends HttpServlet<String> implements Runnable, java.io.Serializable {{
    private String url = "http://x/*y*/"; // tail
    @RequestMapping(value = "/q{k}", method = RequestMethod.POST)
    public String go(@Valid String a, final int b) {{ return help(a); }}
    @GetMapping("/{brand}")
    protected void load() {{ if (x) {{ y(); }} }}
    public void load(int z) {{ }}
    int plain(long[] v) {{ return 0; }}
}}
"""


def web_xml(k: int) -> str:
    struts = "<filter><filter-name>st</filter-name><filter-class>org.apache.struts2.dispatcher.FilterDispatcher</filter-class></filter><filter-mapping><filter-name>st</filter-name><url-pattern>/*</url-pattern></filter-mapping>" if k % 5 == 0 else ""
    return f"""<?xml version="1.0"?><web-app xmlns="http://java.sun.com/xml/ns/javaee">
<servlet><servlet-name> s{k} </servlet-name><servlet-class>com.acme.old.S{k}</servlet-class></servlet>
<servlet><servlet-name>s{k}</servlet-name><servlet-class> com.acme.web.S{k} </servlet-class></servlet>
<servlet-mapping><servlet-name>s{k}</servlet-name><url-pattern>/one</url-pattern><url-pattern>s/{k}</url-pattern></servlet-mapping>
<servlet-mapping><servlet-name>ghost</servlet-name><url-pattern>*.g</url-pattern></servlet-mapping>
<filter-mapping><filter-name>lonely</filter-name><servlet-name>s{k}</servlet-name></filter-mapping>{struts}
</web-app>"""


def actions_xml(k: int, root: str) -> str:
    namespace = f'namespace="{"" if k % 3 else "/"}n{k % 7}"' if k % 2 else ""
    return f"""<?xml version="1.0"?><!DOCTYPE {root} PUBLIC "-//X//DTD//EN" "x.dtd">
<{root}><constant name="c" value="v"/><package name="p{k}" {namespace} extends="base">
<action name="a{k}_*" class="com.acme.act.Act{k}" method="do{k % 3}"><result name="ok">/x.jsp</result></action>
<action name="b{k}" class="com.acme.act.Act{k}"/></package></{root}>"""


def manifest(k: int) -> str:
    boot = f"Spring-Boot-Version: 2.{k % 10}.0\r\nSpring-Boot-Classes: BOOT-INF/classes/\r\n" if k % 3 == 0 else ""
    return f"Manifest-Version: 1.0\r\nLong-Key: abc\r\n def{k}\r\nBlank: \r\nno colon\r\nTwice: a\r\nTwice: b{k}\r\n{boot}\r\nName: com/acme/\r\nSealed: true\r\nManifest-Version: 9\r\n"


_LOCAL, _CENTRAL, _END = struct.Struct("<4s2B4HL2L2H"), struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s4H2LH")
#: 1 January 2020, as archives write it.
_DAY = 40 << 9 | 1 << 5 | 1


def zipped(files: dict[str, bytes | str]) -> bytes:
    return packed([(name, data, False) for name, data in files.items()])


def packed(files: list[tuple[str, bytes | str, bool]]) -> bytes:
    """Names (which may repeat), contents, and whether they are stored as they are: the bytes that ``zipfile`` writes of a few small files."""
    out, ends, at = [], [], 0
    for name, data, stored in files:
        data, path = data.encode() if isinstance(data, str) else data, name.encode()
        body = data
        if not stored:
            deflate = zlib.compressobj(-1, zlib.DEFLATED, -15)
            body = deflate.compress(data) + deflate.flush()
        facts = (0 if name.isascii() else 0x800, 0 if stored else 8, 0, _DAY, zlib.crc32(data), len(body), len(data), len(path), 0)
        out += [_LOCAL.pack(b"PK\3\4", 20, 0, *facts), path, body]
        ends += [_CENTRAL.pack(b"PK\1\2", 20, 3, 20, 0, *facts, 0, 0, 0, 0o600 << 16, at), path]
        at += 30 + len(path) + len(body)
    central = b"".join(ends)
    return b"".join(out) + central + _END.pack(b"PK\5\6", 0, 0, len(files), len(files), len(central), at, 0)


def jar_of(k: int, size: int) -> str:
    return f"{LITERALS[k % len(LITERALS)]}-{size}.{k % 4}.RELEASE.jar"


@cache
def plain_class(name: str) -> bytes:
    """A class that stands in every archive."""
    return bytecode.encode(name)


@cache
def deeper() -> bytes:
    return zipped({"com/acme/TooDeep.class": plain_class("com/acme/TooDeep")})


def archive(k: int, brand: str, size: int) -> bytes:
    """A war with everything the analysis reads: nested jars to the fourth level, a broken one, a class in two of them."""
    deepest = zipped({"lib/deeper.jar": deeper(), "com/acme/Deep.class": bytecode.encode(f"com/acme/Deep{k}")})
    inner = zipped({"com/acme/Dup.class": plain_class("com/acme/DupInner"), f"com/acme/rest/Res{k}.class": jaxrs_class(k), "lib/deep.jar": deepest, "META-INF/MANIFEST.MF": "Inner: yes\n"} if k % 2 else {"com/acme/Dup.class": plain_class("com/acme/DupInner"), f"com/acme/rest/Res{k}.class": jaxrs_class(k)})
    files: dict[str, bytes | str] = {"META-INF/MANIFEST.MF": manifest(k), f"WEB-INF/classes/com/acme/web/Part{k}.class": spring_class(k, brand), "com/acme/Dup.class": plain_class("com/acme/DupOuter"), "WEB-INF/web.xml": web_xml(k), f"src/Src{k}.java": java_source(k, brand)}
    if k % 4 == 0:
        files |= {"struts.xml": actions_xml(k, "struts"), "pom.xml": "<a/>"}
    if k % 11 == 0:
        files["xwork-a.xml"] = actions_xml(k, "xwork")
    if k % 7 == 0:
        files["Broken.class"] = b"\xca\xfe\xba\xbe\0\0\0\x34\0\x03\xff"
    if k % 5 == 0:
        files[f"WEB-INF/classes/com/acme/act/Act{k}.class"] = struts_class(k)
    files[f"WEB-INF/lib/{jar_of(k, size)}"] = inner
    files["WEB-INF/jstl.jar"] = b""
    if k % 13 == 0:
        files["WEB-INF/lib/bad-1.0.jar"] = b"no zip"
    return zipped(files)
