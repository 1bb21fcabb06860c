"""Build and configuration files, commit logs and probe output as rows, from (file, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Base names that are read as configuration.
CONFIG_FILES = ("go.mod", "package.json", "Dockerfile", "pom.xml", "build.gradle")


def config_kind(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(base.isin(*CONFIG_FILES), base)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))


def _once(files: DataFrame, parsed: Column) -> DataFrame:
    """(file, p): each text parsed once. A generator keeps the optimizer from copying the parser into every filter and field."""
    return files.select("file", F.explode(F.array(parsed)).alias("p"))


def go_mod(files: DataFrame) -> DataFrame:
    """(file, module, go, name, version, indirect): one row per requirement; a file without one has a row of nulls, one without a module none.

    Whether a line lies in a block follows from the brackets before it in its own file: a window over one file's lines.
    """
    raw = _lines(files).withColumn("t", F.trim(F.regexp_replace("line", r"//(?!\s*indirect).*$", "")))
    order = W.partitionBy("file").orderBy("n")
    raw = raw.withColumn("t", F.regexp_replace("t", r"^\s+|\s+$", ""))
    inside = F.sum(F.when(F.col("t").rlike(r"^require\s*\($"), 1).otherwise(0)).over(order) > F.sum(F.when(F.col("t") == ")", 1).otherwise(0)).over(order)
    need = F.when(F.col("t").rlike(r"^require\s+[^(\s]"), F.regexp_replace("t", r"^require\s+", "")).when(inside & ~F.col("t").rlike(r"^require\s*\($") & (F.col("t") != ""), F.col("t"))
    deps = raw.withColumn("need", need).where("need IS NOT NULL").select("file", "n", F.regexp_extract("need", r"^(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract("need", r"^(\S+)\s+(\S+)", 2).alias("version"), F.col("need").rlike(r"//\s*indirect").alias("indirect")).where("name <> ''")
    head = raw.groupBy("file").agg(F.min(F.when(F.col("t").startswith("module "), F.trim(F.substring("t", 8, 1000)))).alias("module"), F.min(F.when(F.col("t").startswith("go "), F.trim(F.substring("t", 4, 100)))).alias("go"))
    return head.where("module IS NOT NULL").join(deps.drop("n"), "file", "left")


def package_json(files: DataFrame) -> DataFrame:
    """(file, package, package_version, name, version, dev): production and development dependencies together."""
    j = _once(files, F.from_json("text", "name string, version string, dependencies map<string,string>, devDependencies map<string,string>"))
    side = lambda c, dev: j.select("file", F.col("p.name").alias("package"), F.col("p.version").alias("package_version"), F.explode(f"p.{c}").alias("name", "version"), F.lit(dev).alias("dev"))
    return side("dependencies", False).unionByName(side("devDependencies", True))


def dockerfile(files: DataFrame) -> DataFrame:
    """(file, what, value, ord): distinct base images in order of appearance, and exposed ports."""
    t = _lines(files).withColumn("t", F.trim("line"))
    base = F.trim(F.regexp_replace(F.regexp_extract("t", r"(?i)^FROM (.*)$", 1), r"(?i) AS .*$", ""))
    images = t.where(F.col("t").rlike("(?i)^FROM ")).select("file", base.alias("value"), "n").where("value <> ''").groupBy("file", "value").agg(F.min("n").alias("ord")).withColumn("what", F.lit("image"))
    ports = t.where(F.col("t").rlike("(?i)^EXPOSE ")).select("file", F.trim(F.substring("t", 8, 1000)).alias("value"), F.col("n").alias("ord")).where("value <> ''").withColumn("what", F.lit("port"))
    return images.unionByName(ports)


_POM_DEPENDENCY = "struct<groupId:string,artifactId:string,version:string,scope:string>"
_POM = f"groupId string, artifactId string, version string, packaging string, modules struct<module:array<string>>, dependencies struct<dependency:array<{_POM_DEPENDENCY}>>"


def poms(files: DataFrame) -> DataFrame:
    """(file, group_id, artifact_id, version, packaging, modules, dependencies): a row per project, all that is read of it from one parse.

    What it doesn't state is empty, packaging too. Dependencies are those that it declares itself, with an absent scope as compile:
    what it only manages, or its plugins need, isn't a dependency of the project.
    """
    said = lambda c: F.coalesce(F.trim(c), F.lit(""))
    own = lambda c: said(F.col(f"p.{c}"))
    scope = lambda d: F.when(said(d["scope"]) == "", "compile").otherwise(said(d["scope"])).alias("scope")
    declared = F.transform("p.dependencies.dependency", lambda d: F.struct(said(d["groupId"]).alias("group_id"), said(d["artifactId"]).alias("artifact_id"), said(d["version"]).alias("version"), scope(d)))
    return _once(files, F.from_xml(F.col("text"), _POM, {"rowTag": "project"})).where("p IS NOT NULL").select("file", own("groupId").alias("group_id"), own("artifactId").alias("artifact_id"), own("version").alias("version"),
        own("packaging").alias("packaging"), F.coalesce("p.modules.module", F.expr("CAST(array() AS array<string>)")).alias("modules"), declared.alias("dependencies"))


def pom_project(files: DataFrame) -> DataFrame:
    """(file, group_id, artifact_id, version, packaging, modules) of a project; what it doesn't state is empty, packaging too."""
    return poms(files).drop("dependencies")


def pom(files: DataFrame) -> DataFrame:
    """(file, group_id, artifact_id, version, scope) of the dependencies that a project itself declares; an absent scope is compile."""
    return poms(files).select("file", F.explode(F.col("dependencies")).alias("d")).select("file", "d.*")


# The configurations whose dependencies are read, and the parts of a coordinate in quotes.
GRADLE_CONFIGURATIONS = ("implementation", "testImplementation", "api", "compileOnly", "runtimeOnly")
_COORDINATE = r"""['"](?<group>[^:'"]+):(?<name>[^:'"]+):(?<version>[^'"]+)['"]"""


def gradle(files: DataFrame) -> DataFrame:
    """(file, configuration, group, name, version)."""
    declared = rf"^\s*(?<configuration>{'|'.join(GRADLE_CONFIGURATIONS)})\s+{_COORDINATE}"
    part = lambda i: F.regexp_extract("line", declared, i)
    return _lines(files).where(F.col("line").rlike(declared)).select("file", part(1).alias("configuration"), part(2).alias("group"), part(3).alias("name"), F.trim(part(4)).alias("version"))


def git_log(files: DataFrame) -> DataFrame:
    """(file, sha, author, email, subject, files): commits of a log of COMMIT:sha|name|email|subject and file lines."""
    rx = r"^COMMIT:([^|]+)\|([^|]*)\|([^|]*)\|(.*)$"
    order = W.partitionBy("file").orderBy("n")
    rows = _lines(files).withColumn("head", F.col("line").rlike(rx)).where(F.col("head") | ~F.col("line").startswith("COMMIT:"))
    rows = rows.withColumn("commit", F.sum(F.col("head").cast("int")).over(order)).where("commit > 0")
    first = F.max(F.when(F.col("head"), F.col("line")))
    touched = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & (F.trim("line") != ""), F.struct("n", F.trim("line").alias("p"))))), lambda x: x["p"]), ",")
    got = rows.groupBy("file", "commit").agg(first.alias("h"), touched.alias("files"))
    part = lambda i: F.regexp_extract("h", rx, i)
    return got.select("file", part(1).alias("sha"), part(2).alias("author"), part(3).alias("email"), part(4).alias("subject"), "files")


def probe(files: DataFrame, kind: str) -> DataFrame:
    """(file, codec, width, height, rate, sample_rate, channels, duration, bitrate): the first stream of a kind in probe JSON."""
    s = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,sample_rate:string,channels:int>>, format struct<duration:string,bit_rate:string>"
    j = files.select("file", F.from_json("text", s).alias("j")).withColumn("s", F.get(F.filter("j.streams", lambda x: x["codec_type"] == kind), F.lit(0)))
    num, den = F.split_part(F.col("s.r_frame_rate"), F.lit("/"), F.lit(1)).cast("double"), F.split_part(F.col("s.r_frame_rate"), F.lit("/"), F.lit(2)).cast("double")
    return j.where("s IS NOT NULL").select("file", F.col("s.codec_name").alias("codec"), "s.width", "s.height", F.when(den > 0, num / den).alias("rate"), F.col("s.sample_rate").cast("int").alias("sample_rate"), "s.channels", F.col("j.format.duration").cast("double").alias("duration"), F.col("j.format.bit_rate").cast("long").alias("bitrate"))
