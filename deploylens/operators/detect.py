"""Components by jar name and frameworks by what an input holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..semantics import DEFAULT, Semantics
from . import index, marks
from . import routes as R

#: (component, category, jar literal), in order of match. Fixed values.
CATALOG = (
    ("Spring MVC", "Framework", "spring-webmvc"),
    ("Spring Web", "Framework", "spring-web"),
    ("Spring Boot", "Framework", "spring-boot"),
    ("Spring Boot Starter", "Framework", "spring-boot-starter-web"),
    ("Spring Cloud", "Framework", "spring-cloud"),
    ("Struts2", "Framework", "struts2-core"),
    ("JAX-RS", "Framework", "javax.ws.rs-api"),
    ("JAX-RS", "Framework", "jakarta.ws.rs-api"),
    ("MyBatis", "ORM", "mybatis"),
    ("MyBatis Spring", "ORM", "mybatis-spring"),
    ("MyBatis Plus", "ORM", "mybatis-plus"),
    ("Hibernate", "ORM", "hibernate-core"),
    ("JPA", "ORM", "hibernate-jpa"),
    ("Druid", "Database", "druid"),
    ("HikariCP", "Database", "HikariCP"),
    ("C3P0", "Database", "c3p0"),
    ("Shiro", "Security", "shiro-core"),
    ("Shiro Web", "Security", "shiro-web"),
    ("Spring Security", "Security", "spring-security-core"),
    ("Spring Security Web", "Security", "spring-security-web"),
    ("SaToken", "Security", "sa-token"),
    ("Log4j2", "Logging", "log4j-core"),
    ("Log4j", "Logging", "log4j"),
    ("Logback", "Logging", "logback-classic"),
    ("Logback Core", "Logging", "logback-core"),
    ("SLF4J", "Logging", "slf4j-api"),
    ("Dubbo", "RPC", "dubbo"),
    ("gRPC", "RPC", "grpc-core"),
    ("Tomcat", "Container", "tomcat-embed-core"),
    ("Tomcat Jasper", "Container", "tomcat-jasper"),
    ("Jetty", "Container", "jetty-server"),
    ("Undertow", "Container", "undertow-core"),
    ("Jackson", "JSON", "jackson-databind"),
    ("Jackson Core", "JSON", "jackson-core"),
    ("Jackson Annotations", "JSON", "jackson-annotations"),
    ("Fastjson", "JSON", "fastjson"),
    ("Fastjson2", "JSON", "fastjson2"),
    ("Gson", "JSON", "gson"),
    ("Thymeleaf", "Template", "thymeleaf"),
    ("FreeMarker", "Template", "freemarker"),
    ("Velocity", "Template", "velocity"),
    ("Beetl", "Template", "beetl"),
    ("HttpClient", "HTTP", "httpclient"),
    ("OkHttp", "HTTP", "okhttp"),
    ("JReap", "Framework", "jreap"),
    ("RuoYi", "Framework", "ruoyi"),
    ("Jeecg", "Framework", "jeecg"),
    ("DHCC", "Framework", "dhcc"),
    ("Eway Framework", "Framework", "eway"),
    ("Commons IO", "Utility", "commons-io"),
    ("Commons Lang", "Utility", "commons-lang"),
    ("Commons Lang", "Utility", "commons-lang3"),
    ("Commons BeanUtils", "Utility", "commons-beanutils"),
    ("Commons Collections", "Utility", "commons-collections"),
    ("Commons FileUpload", "Utility", "commons-fileupload"),
    ("Guava", "Utility", "guava"),
    ("Ehcache", "Cache", "ehcache"),
    ("Redis", "Cache", "jedis"),
    ("Lettuce", "Cache", "lettuce-core"),
    ("CXF", "Web Service", "cxf"),
    ("Axis2", "Web Service", "axis2"),
    ("Swagger", "API Doc", "swagger"),
    ("Knife4j", "API Doc", "knife4j"),
    ("JUnit", "Testing", "junit"),
    ("TestNG", "Testing", "testng"),
)
#: (prefix, component) of jars that count without a version. Fixed values.
UNVERSIONED = (
    ("servlet-api", "Servlet API"),
    ("jsp-api", "JSP API"),
    ("jstl", "JSTL"),
    ("standard", "JSTL Standard"),
    ("jta", "JTA"),
    ("activation", "Java Activation"),
    ("mail", "JavaMail"),
    ("jaxb-api", "JAXB"),
    ("websocket-api", "WebSocket API"),
    ("el-api", "EL API"),
    ("jaxen", "Jaxen"),
    ("dom4j", "Dom4J"),
    ("xstream", "XStream"),
    ("ognl", "OGNL"),
    ("cglib", "CGLib"),
    ("asm", "ASM"),
    ("javassist", "Javassist"),
    ("antlr", "ANTLR"),
    ("snakeyaml", "SnakeYAML"),
    ("jasypt", "Jasypt"),
    ("bcprov", "BouncyCastle"),
    ("bcpkix", "BouncyCastle PKIX"),
)
NO_DASH = "commons-collections"


def catalog_rows() -> list[tuple[int, str, str, str]]:
    """(order, component, category, literal)."""
    return [(k, *row) for k, row in enumerate(CATALOG)]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog_rows(), "ord int, component string, category string, literal string")


def versioned(name: Column, semantics: Semantics = DEFAULT) -> Column:
    """struct(ord, component, category, version) of the first catalogue entry whose pattern a jar's name matches, or null.

    A pattern is a literal, a dash, a version and ``.jar``. All are branches of one expression in the catalogue's order, so the first that fits is met
    first and a name is looked at once; what it begins with is then looked up in a map."""
    heads = {}
    for k, n, c, literal in catalog_rows():
        entry = F.struct(F.lit(k).alias("ord"), F.lit(n).alias("component"), F.lit(c).alias("category"))
        if literal != NO_DASH:
            ends = ["-"]
        else:  # its pattern has the version right after the literal
            ends = ["-", "4-"] if semantics.fixed_commons_collections else [""]
        heads |= {literal.lower() + end: entry for end in ends}
    table = F.create_map(*(x for head, entry in heads.items() for x in (F.lit(head), entry)))
    branches = "|".join(re.escape(head).replace("k", "[k\u212a]") for head in heads)  # the sign of Kelvin is a k in lower case
    pattern = rf"(?i)^({branches})({paths.VERSION})\.jar\z"
    found = F.try_element_at(table, F.lower(F.regexp_extract(name, pattern, 1)))
    return F.when(found.isNotNull(), F.struct(found["ord"].alias("ord"), found["component"].alias("component"), found["category"].alias("category"), F.regexp_extract(name, pattern, 2).alias("version")))


def components(jars: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(input_id, name, type, version, jars) from (input_id, visit_seq, jar_name): jars that share a file name count once. A name found with a
    version goes before one found by prefix only, of which the first jar is kept."""
    base = paths.basename(F.col("jar_name"), semantics.component_basename)
    once = jars.select("input_id", base.alias("base"), "visit_seq", "jar_name").groupBy("input_id", "base").agg(F.min_by("jar_name", F.struct("visit_seq", "jar_name")).alias("jar_name"), F.min("visit_seq").alias("visit_seq"))
    found = "struct<name:string,category:string,version:string>"
    hit, low = versioned(F.col("base"), semantics), F.lower("base")
    known = F.filter(F.transform(F.array(hit), lambda h: F.struct(h["component"].alias("name"), h["category"].alias("category"), paths.clean_version(h["version"]).alias("version")).cast(found)), lambda x: x["name"].isNotNull())
    prefixes = F.filter(F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(n).alias("name")) for p, n in UNVERSIONED)), lambda x: F.startswith(low, x["prefix"]))
    loose = F.transform(F.when(F.endswith(low, F.lit(".jar")), prefixes).otherwise(F.array()), lambda x: F.struct(x["name"].alias("name"), F.lit(None).alias("category"), F.lit(None).alias("version")).cast(found))
    # both kinds from one pass over the jars, so that what they come from is read once
    each = once.select("input_id", F.struct("visit_seq", "jar_name").alias("at"), F.explode(F.concat(known, loose)).alias("c")).select("input_id", "at", "c.*")
    sure = F.when(F.col("category").isNotNull(), F.col("at"))
    made = each.groupBy("input_id", "name").agg(
        F.min_by("category", sure).alias("type"), F.coalesce(F.min_by("version", F.when(F.col("version") != "", F.col("at"))), F.lit("")).alias("version"),
        F.transform(F.array_sort(F.collect_list(sure)), lambda x: x["jar_name"]).alias("jars"), F.min_by(F.col("at.jar_name"), F.col("at")).alias("first"),
    )
    return made.select("input_id", "name", F.coalesce("type", F.lit("Utility")).alias("type"), "version", F.when(F.col("type").isNotNull(), F.col("jars")).otherwise(F.array("first")).alias("jars"))


#: Components whose jars give a framework's version. Fixed values.
VERSION_COMPONENTS = ("JAX-RS", "Spring Boot", "Spring MVC", "Spring Web", "Struts2", "Tomcat")
EWAY = "com/eway"


def version_hit(jar: Column, semantics: Semantics = DEFAULT) -> Column:
    """The catalogue entry and version that a stored jar name stands for."""
    return versioned(paths.basename(jar, True) if semantics.version_basename else jar, semantics)


def jar_versions(jars: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(input_id, component, version): the first jar that gives a framework's version, as it stands in the name."""
    hit = version_hit(F.col("jar_name"), semantics)
    found = jars.select("input_id", "visit_seq", "jar_name", hit.alias("hit")).filter(F.col("hit.component").isin(*VERSION_COMPONENTS))
    return found.groupBy("input_id", F.col("hit.component").alias("component")).agg(F.min_by("hit.version", F.struct("visit_seq", "jar_name")).alias("version"))


def frameworks(ctx: R.Context, jars: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(input_id, ord, name, version, confidence, evidence) of the inputs of a context."""
    return frameworks_of(marks.of_context(ctx, jars, semantics), ctx.inputs)


def frameworks_of(found: DataFrame, inputs: DataFrame) -> DataFrame:
    """The same, given the inputs' ``marks``."""
    row = index.by_input(inputs.select("input_id"), found, how="left")
    has, version = marks.has, marks.version_of
    eway_files, struts_files, xwork_files = (marks.named(n, 3) for n in ("eway_file", "struts_file", "xwork_file"))
    first = lambda text, mark: F.transform(marks.named(mark, 1), lambda n: F.concat(F.lit(text), n))
    eway = has("eway_file", "eway_default", "eway_class")
    eway_evidence = F.concat(F.when(has("eway_file"), eway_files).otherwise(marks.named("eway_default", 1)), first("Eway base class: ", "eway_base"))
    webwork = has("xwork_file", "webwork_class")
    tomcat = version("Tomcat")
    found = (
        (has("boot"), "Spring Boot", F.coalesce(F.nullif("boot_version", F.lit("")), version("Spring Boot")), 95, F.array(F.lit("BOOT-INF directory found"), F.lit("MANIFEST.MF Spring-Boot headers"))),
        (has("mvc"), "Spring MVC", version("Spring MVC", "Spring Web"), 90, F.array(F.lit("@Controller/@RestController annotations found"))),
        (eway, "Eway Framework", F.lit("2.x"), 90, eway_evidence),
        (has("struts_file"), "Struts2", F.coalesce(F.nullif(version("Struts2"), F.lit("")), F.lit("2.x")), 90, struts_files),
        (webwork | eway, "WebWork", F.lit("2.x"), 85, F.when(webwork, F.concat(xwork_files, first("ActionSupport subclass: ", "action_support"))).otherwise(F.array(F.lit("xwork configuration files found (Eway Framework base)")))),
        (has("rest"), "JAX-RS", version("JAX-RS"), 85, F.array(F.lit("@Path annotations found on resource classes"))),
        (has("web_file", "servlet_class"), "Servlet", F.when(tomcat != "", F.concat(F.lit("Tomcat "), tomcat)).otherwise(""), 80, F.concat(marks.named("web_file"), F.transform(marks.named("servlet_class"), lambda c: F.concat(F.lit("@WebServlet on "), c)))),
    )
    # which frameworks an input has is told by its bits alone; what is shown of one is made once, in its own row
    ords = F.filter(F.array(*(F.when(cond, F.lit(k)) for k, (cond, *_) in enumerate(found))), lambda k: k.isNotNull())
    each = row.withColumn("ord", F.explode(F.when(F.size(ords) > 0, ords).otherwise(F.array(F.lit(9)))))

    def of_ord(values: list, otherwise: Column) -> Column:
        chosen = F
        for k, v in enumerate(values):
            chosen = chosen.when(F.col("ord") == k, v if isinstance(v, Column) else F.lit(v))
        return chosen.otherwise(otherwise)

    _, names, versions, confidences, evidence = map(list, zip(*found, strict=True))
    return each.select(
        "input_id", "ord", of_ord(names, F.lit("Unknown")).alias("name"), of_ord(versions, F.lit("")).alias("version"), of_ord(confidences, F.lit(0)).alias("confidence"),
        of_ord(evidence, F.array(F.lit("No supported framework markers found"))).alias("evidence"),
    )


class UnsupportedInput(ValueError):
    """No input has a framework that is known."""


def supported(found: DataFrame) -> str:
    """Names of the frameworks found, comma-joined; UnsupportedInput if there is none but Unknown."""
    names = found.filter("name <> 'Unknown'").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")).first()["names"]
    if not names:
        raise UnsupportedInput("no supported framework in any input")
    return names
