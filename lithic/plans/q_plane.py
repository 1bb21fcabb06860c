"""The source plane and the triples of build files, history, media and code, over files written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import ids, text
from lithic.operators import retrieval, triples
from lithic.plans.catalog import query, read
from lithic.plans.q_identity import s_instance
from lithic.sources import code, config, plane

ORG, SYSTEM = "acme", "web-parts"
HEAD = f"'{ORG}.corpus.config.{SYSTEM}."


def lists(df, key, *cols):
    """One row per key with the columns as lists in the order of the first."""
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    field = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    return df.groupBy(key).agg(rows.alias("r")).select(key, *[field(c) for c in cols])


def s_slugify(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9-]', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g')"


def s_dep(name: str, version: str) -> str:
    return f"{HEAD}dependency.' || left(sha256({name} || '@' || {version}), 8)"


# ---- build files written from parts ---------------------------------------------------------------------------------

def parts(spark, d):
    """A part is a dependency of its brand's project."""
    k = F.col("p_partkey").cast("string")
    return read(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace(F.lower("p_brand"), "#", "-"), F.lit("/")).alias("folder"), F.concat(F.lit("example.org/p"), k).alias("dep"), F.concat(F.lit("v"), "p_size", F.lit(".0.1")).alias("version"), (F.col("p_partkey") % 3 == 0).alias("odd"))


S_PARTS = "x AS (SELECT p_partkey, replace(lower(p_brand), '#', '-') || '/' AS folder, 'example.org/p' || p_partkey AS dep, 'v' || p_size || '.0.1' AS version, p_partkey % 3 = 0 AS odd FROM part)"


def go_files(spark, d):
    g = lists(parts(spark, d), "folder", "p_partkey", "dep", "version", "odd")
    line = F.transform(F.arrays_zip("dep", "version", "odd"), lambda x: F.concat(F.lit("\t"), x["dep"], F.lit(" "), x["version"], F.when(x["odd"], F.lit(" // indirect")).otherwise(F.lit("  // a remark"))))
    return g.select(F.concat("folder", F.lit("go.mod")).alias("file"), F.concat(F.lit("// build file\nmodule example.org/"), F.rtrim(F.col("folder"), F.lit("/")), F.lit("\n\ngo 1.22\n\nrequire (\n"), F.array_join(line, "\n"), F.lit("\n)\nrequire example.org/last v0.0.1\n")).alias("text"))


@query("parse_go_mod_files", f"""WITH {S_PARTS}, l AS (SELECT folder, dep, version, odd FROM x UNION ALL SELECT DISTINCT folder, 'example.org/last', 'v0.0.1', false FROM x)
SELECT folder || 'go.mod' AS file, 'example.org/' || rtrim(folder, '/') AS module, '1.22' AS go, dep AS name, version, odd AS indirect FROM l""")
def parse_go_mod_files(spark, d):
    return config.go_mod(go_files(spark, d))


@query("config_go_triples", f"""WITH {S_PARTS}, l AS (SELECT folder, dep, version, odd FROM x UNION ALL SELECT DISTINCT folder, 'example.org/last', 'v0.0.1', false FROM x),
m AS (SELECT DISTINCT folder, 'example.org/' || rtrim(folder, '/') AS module FROM x), s AS (SELECT *, {HEAD}gomod.' || {s_slugify('module')} AS id FROM m)
SELECT DISTINCT * FROM (
SELECT {s_dep('dep', 'version')} AS subject, unnest(['dc.terms.title', 'source.config.dependency-name', 'source.config.dependency-version', 'source.config.dependency-kind', 'source.config.dependency-indirect']) AS predicate,
  unnest([dep, dep, version, 'go', CASE WHEN odd THEN 'true' ELSE 'false' END]) AS object FROM l
UNION ALL SELECT id, unnest(['dc.terms.title', 'source.config.module-path', 'source.config.module-go-version', 'source.config.file-path']), unnest([module, module, '1.22', folder || 'go.mod']) FROM s
UNION ALL SELECT id, 'source.config.requires', {s_dep('dep', 'version')} FROM l JOIN s USING (folder))""")
def config_go_triples(spark, d):
    rows = config.go_mod(go_files(spark, d)).withColumns({"org": F.lit(ORG), "system": F.lit(SYSTEM)})
    need = triples.dependency_id(F.col("org"), F.col("system"), F.col("name"), F.col("version"))
    mods = rows.groupBy("org", "system", "file", "module", "go").agg(F.collect_list(need).alias("needs")).select("org", "system", "file", F.col("module").alias("name"), F.array("module", "go").alias("values"), "needs")
    return triples.project_triples(mods, "gomod").unionByName(triples.dependency_triples(rows.where("name IS NOT NULL").withColumn("dep_kind", F.lit("go"))))


def package_files(spark, d):
    g = lists(parts(spark, d), "folder", "p_partkey", "dep", "version", "odd")
    side = lambda odd: F.map_from_entries(F.transform(F.filter(F.arrays_zip("dep", "version", "odd"), lambda x: x["odd"] == F.lit(odd)), lambda x: F.struct(x["dep"], x["version"])))
    body = F.to_json(F.struct(F.concat(F.lit("@web/"), F.rtrim(F.col("folder"), F.lit("/"))).alias("name"), F.lit("2.0.0").alias("version"), side(False).alias("dependencies"), side(True).alias("devDependencies")))
    return g.select(F.concat("folder", F.lit("package.json")).alias("file"), body.alias("text"))


@query("config_package_triples", f"""WITH {S_PARTS}, s AS (SELECT DISTINCT folder, '@web/' || rtrim(folder, '/') AS name FROM x), i AS (SELECT *, {HEAD}package.' || {s_slugify('name')} AS id FROM s)
SELECT DISTINCT * FROM (
SELECT {s_dep('dep', 'version')} AS subject, unnest(['dc.terms.title', 'source.config.dependency-name', 'source.config.dependency-version', 'source.config.dependency-kind']) AS predicate, unnest([dep, dep, version, CASE WHEN odd THEN 'npm-dev' ELSE 'npm-prod' END]) AS object FROM x
UNION ALL SELECT id, unnest(['dc.terms.title', 'source.config.package-name', 'source.config.package-version', 'source.config.file-path']), unnest([name, name, '2.0.0', folder || 'package.json']) FROM i
UNION ALL SELECT id, 'source.config.depends', {s_dep('dep', 'version')} FROM x JOIN i USING (folder))""")
def config_package_triples(spark, d):
    rows = config.package_json(package_files(spark, d)).withColumns({"org": F.lit(ORG), "system": F.lit(SYSTEM)})
    need = triples.dependency_id(F.col("org"), F.col("system"), F.col("name"), F.col("version"))
    own = rows.groupBy("org", "system", "file", "package", "package_version").agg(F.collect_list(need).alias("needs")).select("org", "system", "file", F.col("package").alias("name"), F.array("package", "package_version").alias("values"), "needs")
    return triples.project_triples(own, "package").unionByName(triples.dependency_triples(rows.withColumn("dep_kind", F.when(F.col("dev"), "npm-dev").otherwise("npm-prod"))))


def pom_files(spark, d):
    g = lists(parts(spark, d), "folder", "p_partkey", "dep", "version", "odd")
    element = lambda x, scope: F.concat(F.lit("<dependency><groupId>org.parts</groupId><artifactId>"), x["dep"], F.lit("</artifactId><version>"), x["version"], F.lit("</version>"), scope, F.lit("</dependency>"))
    deps = F.array_join(F.transform(F.arrays_zip("dep", "version", "odd"), lambda x: element(x, F.when(x["odd"], F.lit("<scope>test</scope>")).otherwise(F.lit("")))), "\n")
    managed = F.lit("<dependencyManagement><dependencies><dependency><groupId>org.managed</groupId><artifactId>only</artifactId><version>9</version></dependency></dependencies></dependencyManagement>"
                    "<build><plugins><plugin><artifactId>p</artifactId><dependencies><dependency><groupId>org.plugin</groupId><artifactId>need</artifactId></dependency></dependencies></plugin></plugins></build>")
    name = F.rtrim(F.col("folder"), F.lit("/"))
    whole = F.concat(F.lit('<?xml version="1.0"?>\n<project><parent><groupId>org.parent</groupId><artifactId>top</artifactId></parent><groupId>org.brand</groupId><artifactId>'), name, F.lit("</artifactId><version>1.5</version>"),
                     F.when(name.endswith("1"), F.lit("<packaging>pom</packaging>")).otherwise(""), F.lit("<modules><module>core</module><module>"), name, F.lit("-ui</module></modules>"), managed,
                     F.lit("<!-- <dependency><groupId>no</groupId></dependency> --><dependencies>"), deps, F.lit("</dependencies></project>"))
    return g.select(F.concat("folder", F.lit("pom.xml")).alias("file"), whole.alias("text"))


@query("parse_pom_files", f"WITH {S_PARTS} SELECT folder || 'pom.xml' AS file, 'org.parts' AS group_id, dep AS artifact_id, version, CASE WHEN odd THEN 'test' ELSE 'compile' END AS scope FROM x")
def parse_pom_files(spark, d):
    return config.pom(pom_files(spark, d))


@query("parse_pom_projects", f"""WITH {S_PARTS} SELECT DISTINCT folder || 'pom.xml' AS file, 'org.brand' AS group_id, rtrim(folder, '/') AS artifact_id, '1.5' AS version,
CASE WHEN folder LIKE '%1/' THEN 'pom' ELSE '' END AS packaging, 'core,' || rtrim(folder, '/') || '-ui' AS modules FROM x""")
def parse_pom_projects(spark, d):
    return config.pom_project(pom_files(spark, d)).withColumn("modules", F.array_join("modules", ","))


@query("config_maven_triples", f"""WITH {S_PARTS}, s AS (SELECT DISTINCT folder, rtrim(folder, '/') AS a FROM x), i AS (SELECT *, {HEAD}project.' || {s_slugify("'org.brand:' || a")} AS id FROM s),
m AS (SELECT id, folder, unnest(['core', a || '-ui']) AS name FROM i), mi AS (SELECT *, {HEAD}gomod.' || {s_slugify('name')} AS mid FROM m)
SELECT DISTINCT * FROM (
SELECT {s_dep("'org.parts:' || dep", 'version')} AS subject, unnest(['dc.terms.title', 'source.config.dependency-name', 'source.config.dependency-version', 'source.config.dependency-kind', 'source.config.dependency-scope']) AS predicate,
  unnest(['org.parts:' || dep, 'org.parts:' || dep, version, 'maven', CASE WHEN odd THEN 'test' ELSE 'compile' END]) AS object FROM x
UNION ALL SELECT id, unnest(['dc.terms.title', 'source.config.project-group-id', 'source.config.project-artifact-id', 'source.config.project-version', 'source.config.project-packaging', 'source.config.file-path']),
  unnest(['org.brand:' || a, 'org.brand', a, '1.5', CASE WHEN a LIKE '%1' THEN 'pom' ELSE '' END, folder || 'pom.xml']) FROM i
UNION ALL SELECT id, 'source.config.requires', {s_dep("'org.parts:' || dep", 'version')} FROM x JOIN i USING (folder)
UNION ALL SELECT id, 'source.config.contains', mid FROM mi
UNION ALL SELECT mid, unnest(['dc.terms.title', 'source.config.module-path', 'source.config.file-path']), unnest([name, name, folder || 'pom.xml']) FROM mi)""")
def config_maven_triples(spark, d):
    # Parsed once: all branches read the rows that were written. Subjects of projects, modules and dependencies are of different kinds, and each branch is distinct.
    own = retrieval._checkpointed(config.poms(pom_files(spark, d))).withColumns({"org": F.lit(ORG), "system": F.lit(SYSTEM)})
    name = lambda x: F.concat_ws(":", x["group_id"], x["artifact_id"])
    needs = F.transform("dependencies", lambda x: triples.dependency_id(F.col("org"), F.col("system"), name(x), x["version"]))
    project = own.select("org", "system", "file", F.concat_ws(":", "group_id", "artifact_id").alias("name"), F.array("group_id", "artifact_id", "version", "packaging").alias("values"), needs.alias("needs"),
                         F.transform("modules", lambda m: triples.module_id(F.col("org"), F.col("system"), m)).alias("parts"))
    modules = own.select("org", "system", "file", F.explode("modules").alias("name"))
    deps = own.select("org", "system", "file", F.explode("dependencies").alias("d")).select("org", "system", "file", name(F.col("d")).alias("name"), "d.version", "d.scope", F.lit("maven").alias("dep_kind"))
    return triples.project_triples(project, "project").unionByName(triples.module_triples(modules)).unionByName(triples.dependency_triples(deps))


def gradle_files(spark, d):
    g = lists(parts(spark, d), "folder", "p_partkey", "dep", "version", "odd")
    line = lambda x: F.when(x["odd"], F.concat(F.lit('    testImplementation "org.parts:'), x["dep"], F.lit(":"), x["version"], F.lit('"'))).otherwise(F.concat(F.lit("\tapi 'org.parts:"), x["dep"], F.lit(":"), x["version"], F.lit("' // used")))
    return g.select(F.concat("folder", F.lit("build.gradle")).alias("file"), F.concat(F.lit("plugins { id 'java' }\ndependencies {\n  kapt 'org.no:no:1'\n  api project(':own')\n"), F.array_join(F.transform(F.arrays_zip("dep", "version", "odd"), line), "\n"), F.lit("\n}\n")).alias("text"))


@query("config_gradle_triples", f"""WITH {S_PARTS}, s AS (SELECT DISTINCT folder, rtrim(folder, '/') AS a FROM x), i AS (SELECT *, {HEAD}project.' || {s_slugify('a')} AS id FROM s)
SELECT DISTINCT * FROM (
SELECT {s_dep("'org.parts:' || dep", 'version')} AS subject, unnest(['dc.terms.title', 'source.config.dependency-name', 'source.config.dependency-version', 'source.config.dependency-kind', 'source.config.dependency-configuration']) AS predicate,
  unnest(['org.parts:' || dep, 'org.parts:' || dep, version, 'gradle', CASE WHEN odd THEN 'testImplementation' ELSE 'api' END]) AS object FROM x
UNION ALL SELECT id, unnest(['dc.terms.title', 'source.config.project-artifact-id', 'source.config.project-build', 'source.config.file-path']), unnest([a, a, 'gradle', folder || 'build.gradle']) FROM i
UNION ALL SELECT id, 'source.config.requires', {s_dep("'org.parts:' || dep", 'version')} FROM x JOIN i USING (folder))""")
def config_gradle_triples(spark, d):
    deps = config.gradle(gradle_files(spark, d)).withColumns({"org": F.lit(ORG), "system": F.lit(SYSTEM)}).withColumn("name", F.concat_ws(":", "group", "name"))
    need = triples.dependency_id(F.col("org"), F.col("system"), F.col("name"), F.col("version"))
    folder = F.element_at(F.split("file", "/"), -2)
    own = deps.groupBy("org", "system", "file").agg(F.collect_list(need).alias("needs")).select("org", "system", "file", folder.alias("name"), F.array(folder, F.lit("gradle")).alias("values"), "needs")
    return triples.project_triples(own, "gradle").unionByName(triples.dependency_triples(deps.withColumn("dep_kind", F.lit("gradle"))))


def docker_files(spark, d):
    g = lists(parts(spark, d), "folder", "p_partkey", "dep")
    return g.select(F.concat("folder", F.lit("Dockerfile")).alias("file"), F.concat(F.lit("FROM golang:1.22 AS build\nRUN make\n"), F.array_join(F.transform(F.slice("dep", 1, 3), lambda x: F.concat(F.lit("from "), x, F.lit(" as x"))), "\n"), F.lit("\nEXPOSE 80\nexpose 9090/udp\n")).alias("text"))


@query("config_docker_triples", f"""WITH {S_PARTS}, r AS (SELECT folder, dep, row_number() OVER (PARTITION BY folder ORDER BY p_partkey) AS k FROM x), g AS (SELECT folder, dep AS image FROM r WHERE k <= 3 UNION SELECT folder, 'golang:1.22' FROM x),
i AS (SELECT *, {HEAD}image.' || {s_slugify('image')} AS id FROM g)
SELECT DISTINCT * FROM (SELECT id AS subject, unnest(['dc.terms.title', 'source.config.image-name', 'source.config.file-path', 'source.config.image-exposed-ports', 'source.config.image-exposed-ports']) AS predicate, unnest([image, image, folder || 'Dockerfile', '80', '9090/udp']) AS object FROM i)""")
def config_docker_triples(spark, d):
    rows = config.dockerfile(docker_files(spark, d))
    ports = rows.where("what = 'port'").groupBy("file").agg(F.collect_list("value").alias("ports"))
    images = rows.where("what = 'image'").join(ports, "file", "left").select(F.lit(ORG).alias("org"), F.lit(SYSTEM).alias("system"), "file", F.col("value").alias("name"), F.array("value").alias("values"), "ports")
    return triples.project_triples(images, "image")


# ---- history written from orders ------------------------------------------------------------------------------------

GIT = f"'{ORG}.corpus.git.{SYSTEM}."
S_COMMITS = """c AS (SELECT o_orderkey AS position, sha256('o' || o_orderkey) AS sha, 'Customer ' || (o_custkey % 97) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' Jr' END AS author,
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'c+' || (o_custkey % 97) || '@example.org' END AS email, o_orderpriority || ' | order' AS line FROM orders),
f AS (SELECT l_orderkey AS position, 'src/p' || l_partkey || '.go' AS file FROM lineitem)"""


def commits(spark, d):
    """A log's text per status of orders, parsed back to commits."""
    o, l = read(spark, d, "orders"), read(spark, d, "lineitem")
    who = F.concat(F.lit("Customer "), F.col("o_custkey") % 97, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(" Jr"))
    mail = F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("c+"), F.col("o_custkey") % 97, F.lit("@example.org")))
    touched = l.select("l_orderkey", F.concat(F.lit("src/p"), "l_partkey", F.lit(".go")).alias("f")).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("f")), "\n").alias("files"))
    head = F.concat(F.lit("COMMIT:"), F.sha2(F.concat(F.lit("o"), "o_orderkey"), 256), F.lit("|"), who, F.lit("|"), mail, F.lit("|"), "o_orderpriority", F.lit(" | order"))
    entries = o.join(touched, o["o_orderkey"] == touched["l_orderkey"], "left").select(F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 64).alias("part"), F.concat(head, F.lit("\n\n"), F.coalesce("files", F.lit(""))).alias("entry"))
    logs = lists(entries, "part", "position", "entry").select(F.concat(F.lit("log"), "part").alias("file"), F.array_join("entry", "\n").alias("text"))
    parsed = config.git_log(logs)
    back = o.select(F.sha2(F.concat(F.lit("o"), "o_orderkey"), 256).alias("sha"), F.col("o_orderkey").alias("position"))
    return parsed.join(back, "sha").select(F.lit(ORG).alias("org"), F.lit(SYSTEM).alias("system"), "sha", "author", "email", F.col("subject").alias("subject_line"), F.filter(F.split("files", ","), lambda x: x != "").alias("files"), "position")


@query("git_commit_triples", f"""WITH {S_COMMITS}, i AS (SELECT *, {GIT}commit.' || left(sha, 7) AS id FROM c)
SELECT id AS subject, unnest(['dc.terms.title', 'source.git.commit-sha', 'source.git.commit-short-sha', 'source.git.commit-author', 'source.git.commit-subject']) AS predicate, unnest([line, sha, left(sha, 7), author, line]) AS object, CAST(NULL AS VARCHAR) AS datatype FROM i
UNION ALL SELECT DISTINCT id, 'source.git.commit-touches', file, NULL FROM i JOIN f USING (position)
UNION ALL SELECT id, 'source.git.commit-authored-by', {GIT}author.' || {s_instance('email')}, 'entity_id' FROM i WHERE email <> ''""")
def git_commit_triples(spark, d):
    return triples.commit_triples(commits(spark, d))


@query("git_author_triples", f"""WITH {S_COMMITS}, a AS (SELECT email, arg_min(author, position) AS author FROM c GROUP BY email)
SELECT {GIT}author.' || {s_instance('email')} AS subject, unnest(['dc.terms.title', 'source.git.author-name', 'source.git.author-email']) AS predicate, unnest([author, author, email]) AS object FROM a""")
def git_author_triples(spark, d):
    return triples.author_triples(commits(spark, d))


@query("git_branch_triples", f"""WITH b AS (SELECT 'feature/' || c_mktsegment || '_' || c_custkey AS branch, sha256('h' || c_custkey) AS head FROM customer)
SELECT {GIT}branch.' || {s_instance('branch')} AS subject, unnest(['dc.terms.title', 'source.git.branch-name', 'source.git.branch-head-sha']) AS predicate, unnest([branch, branch, left(head, 7)]) AS object FROM b""")
def git_branch_triples(spark, d):
    b = read(spark, d, "customer").select(F.lit(ORG).alias("org"), F.lit(SYSTEM).alias("system"), F.concat(F.lit("feature/"), "c_mktsegment", F.lit("_"), "c_custkey").alias("branch"), F.sha2(F.concat(F.lit("h"), "c_custkey"), 256).alias("head"))
    return triples.branch_triples(b)


# ---- media, code ----------------------------------------------------------------------------------------------------

@query("media_video_triples", f"""WITH v AS (SELECT *, 'acme.corpus.media.' || source || '.video.' || left(sha256(text), 6) || '-' || doc_id AS id FROM documents)
SELECT id AS subject, unnest(['source.media.type', 'source.media.file-path', 'source.media.mime-type', 'source.media.file-hash', 'source.media.file-size', 'source.media.format', 'source.media.duration', 'source.media.frame-rate', 'source.media.width', 'source.media.height', 'source.media.codec', 'source.media.bitrate', 'source.media.keyframe-count']) AS predicate,
  unnest(['video', doc_id || '.mp4', 'video/mp4', sha256(text), CAST(octet_length(encode(text)) AS VARCHAR), 'mp4', CAST(n_chars AS VARCHAR), '25', '640', '480', 'h264', '128000', '3']) AS object, CAST(NULL AS VARCHAR) AS datatype FROM v
UNION ALL SELECT id, 'source.media.storage-ref', 'v/' || doc_id, NULL FROM v WHERE doc_id % 2 = 0""")
def media_video_triples(spark, d):
    v = read(spark, d, "documents")
    rows = v.select(F.concat(F.lit("acme.corpus.media."), "source", F.lit(".video."), ids.media_instance(F.col("text")), F.lit("-"), "doc_id").alias("id"), F.concat("doc_id", F.lit(".mp4")).alias("file_path"), F.lit("video/mp4").alias("mime_type"), F.sha2("text", 256).alias("file_hash"),
                    F.octet_length("text").alias("file_size"), F.lit("mp4").alias("format"), F.col("n_chars").alias("duration"), F.lit("25").alias("frame_rate"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("h264").alias("codec"), F.lit(128000).alias("bitrate"), F.lit(3).alias("keyframe_count"),
                    F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("v/"), "doc_id")).otherwise("").alias("storage_ref"))
    return triples.media_triples(rows, "video")


@query("media_keyframe_triples", """WITH v AS (SELECT doc_id, 'acme.corpus.media.x.keyframe.' || left(sha256(text), 6) || '-' || (10 * (doc_id % 7)) || 's' AS id, 10 * (doc_id % 7) || 's' AS t FROM documents)
SELECT id AS subject, unnest(['source.media.type', 'source.media.timestamp', 'source.media.frame-index', 'source.media.width', 'source.media.height', 'source.media.keyframe-of']) AS predicate, unnest(['keyframe', t, CAST(doc_id AS VARCHAR), '64', '48', 'v' || doc_id]) AS object,
  unnest([NULL, NULL, NULL, NULL, NULL, 'entity_id']) AS datatype FROM v""")
def media_keyframe_triples(spark, d):
    t = F.concat(F.lit(10) * (F.col("doc_id") % 7), F.lit("s"))
    rows = read(spark, d, "documents").select(F.concat(F.lit("acme.corpus.media.x.keyframe."), ids.keyframe_instance(F.col("text"), t)).alias("id"), t.alias("timestamp"), F.col("doc_id").alias("frame_index"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.lit("").alias("storage_ref"), F.concat(F.lit("v"), "doc_id").alias("keyframe_of"))
    return triples.media_triples(rows, "keyframe")


@query("vision_enrichment", """SELECT doc_id AS subject, unnest(['source.media.vision-labels', 'source.media.vision-description', 'source.media.vision-confidence', 'source.media.vision-model']) AS predicate, unnest([lang, 'length ' || n_chars, '0.5', 'fixed']) AS object
FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND n_chars * 4000 <= 10485760""")
def vision_enrichment(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars", F.when(F.col("doc_id") % 3 == 0, "audio").otherwise("image").alias("type"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("ref").alias("storage_ref"), (F.col("n_chars") * 4000).alias("size"))
    none = F.lit(None).cast("string")
    see = F.struct(F.col("lang").alias("labels"), F.concat(F.lit("length "), "n_chars").alias("description"), F.lit("0.5").alias("confidence"), none.alias("objects"), none.alias("text"), F.lit("fixed").alias("model"))
    return triples.vision_triples(rows, see)


@query("code_relationship_triples", """WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1), r AS (
SELECT 'o' || l_orderkey AS subject, 'code.structure.belongs' AS predicate, 'f' || (l_orderkey % 10) AS object, 0 AS o, 0 AS i FROM s WHERE l_orderkey % 3 > 0
UNION ALL SELECT 'o' || l_orderkey, 'code.relationship.calls', 'p' || p, 1, i FROM (SELECT l_orderkey, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM s)
UNION ALL SELECT 'o' || l_orderkey, 'code.relationship.receiver', 'builtin:int', 2, 0 FROM s
UNION ALL SELECT 'o' || l_orderkey, 'code.relationship.parameter', 'external:a.B', 3, 0 FROM s)
SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY o, i) - 1 AS INTEGER) AS ord, predicate, object, CAST(NULL AS VARCHAR) AS datatype FROM r""")
def code_relationship_triples(spark, d):
    k = F.col("l_orderkey")
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p")).select(
        F.concat(F.lit("o"), k).alias("id"), F.when(k % 3 > 0, F.concat(F.lit("f"), k % 10)).otherwise("").alias("contained_by"), F.transform("p", lambda x: F.concat(F.lit("p"), x.cast("string"))).alias("calls"),
        F.expr("CAST(NULL AS array<string>)").alias("extends"), F.lit("builtin:int").alias("receiver"), F.array(F.lit("external:a.B")).alias("parameters"))
    return triples.relationship_triples(rows)


@query("code_capability_triples", """SELECT * FROM (SELECT 's' || s_suppkey AS subject, unnest(['agentic.capability.name', 'agentic.capability.description', 'agentic.capability.tools', 'agentic.capability.tools']) AS predicate, unnest([s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE '' END, 'read', 'n' || s_nationkey]) AS object FROM supplier WHERE s_suppkey % 7 > 0) WHERE object <> ''""")
def code_capability_triples(spark, d):
    k, none = F.col("s_suppkey"), F.expr("CAST(NULL AS array<string>)")
    c = F.struct(F.col("s_name").alias("name"), F.when(k % 2 == 0, "even").otherwise("").alias("description"), F.array(F.lit("read"), F.concat(F.lit("n"), "s_nationkey")).alias("tools"), none.alias("inputs"), none.alias("outputs"))
    return triples.capability_triples(read(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("id"), F.when(k % 7 > 0, c).alias("capability"))).drop("ord", "datatype")


# ---- the plane ------------------------------------------------------------------------------------------------------

S_TREE = """t AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.cache/' WHEN 2 THEN 'vendor/lib' || (p_partkey % 3) || '/' ELSE 'src/' || lower(p_type) || '/' END || 'f' || p_partkey ||
  CASE p_partkey % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.GO' WHEN 2 THEN '.txt' WHEN 3 THEN '.adoc' ELSE '.bin' END AS path FROM part)"""


def tree(spark, d):
    k = F.col("p_partkey")
    folder = F.when(k % 7 == 0, "node_modules/").when(k % 7 == 1, ".cache/").when(k % 7 == 2, F.concat(F.lit("vendor/lib"), k % 3, F.lit("/"))).otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/")))
    end = F.when(k % 5 == 0, ".md").when(k % 5 == 1, ".GO").when(k % 5 == 2, ".txt").when(k % 5 == 3, ".adoc").otherwise(".bin")
    return read(spark, d, "part").select("p_partkey", F.concat(folder, F.lit("f"), k, end).alias("path"), "p_name")


@query("scan_boundaries", f"WITH {S_TREE} SELECT path FROM t WHERE NOT starts_with(path, 'node_modules/') AND NOT starts_with(path, '.cache/') AND NOT starts_with(path, 'vendor/lib1/')")
def scan_boundaries(spark, d):
    t = tree(spark, d)
    marks = spark.createDataFrame([("vendor/lib1/.git",), (".git/HEAD",)], "path string")
    return plane.outside_boundaries(t.where(plane.scanned(F.col("path"), [])), "path", plane.boundaries(marks, "path")).select("path")


@query("scan_globs", f"WITH {S_TREE}, f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM t) SELECT folder FROM f WHERE folder LIKE 'src/%' OR folder LIKE 'vendor/lib_' OR folder LIKE '.cache'")
def scan_globs(spark, d):
    folders = tree(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return plane.glob_folders(folders, spark.createDataFrame([("src/*",), ("vendor/lib?",), ("src/**",), (".c*",)], "glob string"))


@query("scan_documents", rf"""WITH {S_TREE}, x AS (SELECT path AS file, 'intro' || chr(10) || CASE WHEN t.p_partkey % 2 = 0 THEN '# ' || p_name || ' ' ELSE 'none' END || chr(10) || '= ' || p_brand AS text FROM t JOIN part USING (p_partkey) WHERE t.p_partkey % 9 > 0)
SELECT file, CASE WHEN file LIKE '%.md' THEN 'text/markdown' WHEN file LIKE '%.adoc' THEN 'text/asciidoc' ELSE 'text/plain' END AS mime, file LIKE '%.adoc' AS adoc,
  CASE WHEN file LIKE '%.adoc' THEN regexp_extract(text, '= (.*)$', 1) WHEN text LIKE '%# %' AND contains(text, chr(10) || '# ') THEN trim(regexp_extract(text, '\n# ([^\n]*)', 1)) ELSE regexp_replace(regexp_replace(file, '^.*/', ''), '\.[^.]*$', '') END AS title, sha256(text) AS hash
FROM x WHERE regexp_matches(file, '\.(md|txt|adoc)$') AND NOT starts_with(file, 'node_modules/') AND NOT starts_with(file, '.cache/')""")
def scan_documents(spark, d):
    t = tree(spark, d).join(read(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    body = F.concat(F.lit("intro\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("# "), "p_name", F.lit(" "))).otherwise("none"), F.lit("\n= "), "p_brand")
    return plane.documents(t.select(F.col("path").alias("file"), F.when(F.col("p_partkey") % 9 > 0, body).alias("text"))).drop("text")


@query("repo_expansion", """WITH s AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'url' ELSE 'repo' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'https://git.example.org/team/r' || s_suppkey || '.git' END AS url, CASE WHEN s_suppkey % 3 = 0 THEN '/data/r' || s_suppkey ELSE '' END AS path, 'p' || s_nationkey AS project FROM supplier),
r AS (SELECT *, CASE WHEN path <> '' THEN path ELSE '/ws/git-example-org-team-' || regexp_extract(url, '(r[0-9]+)', 1) END AS local FROM s WHERE kind = 'repo' AND (url <> '' OR path <> ''))
SELECT kind, url, path, 'main' AS branch, project, '' AS version FROM s WHERE kind <> 'repo'
UNION ALL SELECT 'git', url, path, 'main', '', '' FROM r UNION ALL SELECT 'ast', '', local, '', project, '' FROM r UNION ALL SELECT unnest(['docs', 'config']), '', local, '', '', '' FROM r""")
def repo_expansion(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(F.when(k % 4 == 0, "url").otherwise("repo").alias("kind"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://git.example.org/team/r"), k, F.lit(".git"))).alias("url"),
                                          F.when(k % 3 == 0, F.concat(F.lit("/data/r"), k)).otherwise("").alias("path"), F.lit("main").alias("branch"), F.concat(F.lit("p"), "s_nationkey").alias("project"), F.lit("").alias("version"))
    return plane.expand_repositories(s, "/ws")


@query("branch_changes", """WITH b AS (SELECT DISTINCT 'feature/' || c_mktsegment || '-' || (c_custkey % 40) AS branch FROM customer), k AS (SELECT 'feature/' || n_name AS branch FROM nation WHERE n_nationkey < 3 UNION SELECT branch FROM b WHERE branch LIKE '%-1'),
a AS (SELECT branch FROM b WHERE branch NOT IN (SELECT branch FROM k) AND branch LIKE 'feature/_%-_' ORDER BY branch LIMIT (SELECT greatest(0, 30 - count(*)) FROM k)),
r AS (SELECT branch, 'added' AS change FROM a UNION ALL SELECT branch, 'removed' FROM k WHERE branch NOT IN (SELECT branch FROM b WHERE branch LIKE 'feature/_%-_'))
SELECT branch, regexp_replace(regexp_replace(lower(branch), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g') AS slug, change FROM r""")
def branch_changes(spark, d):
    b = read(spark, d, "customer").select(F.concat(F.lit("feature/"), "c_mktsegment", F.lit("-"), F.col("c_custkey") % 40).alias("branch")).distinct()
    known = read(spark, d, "nation").where("n_nationkey < 3").select(F.concat(F.lit("feature/"), "n_name").alias("branch")).union(b.where(F.col("branch").endswith("-1")))
    return plane.branch_changes(b, spark.createDataFrame([("feature/?*-?",)], "pattern string"), known.distinct(), 30)


@query("submodule_reconcile", """WITH d AS (SELECT 'm' || s_suppkey AS path, sha256('s' || s_suppkey) AS sha, s_suppkey % 4 > 0 AS here FROM supplier WHERE s_suppkey % 3 > 0), t AS (SELECT 'm' || s_suppkey AS path, CASE WHEN s_suppkey % 5 = 0 THEN sha256('old') ELSE sha256('s' || s_suppkey) END AS sha, s_suppkey % 2 = 0 AS confirmed FROM supplier WHERE s_suppkey % 7 > 0),
b AS (SELECT coalesce(d.path, t.path) AS path, d.sha AS n, t.sha AS o, confirmed FROM (SELECT * FROM d WHERE here) d FULL JOIN t USING (path))
SELECT path, CASE WHEN o IS NULL THEN 'add' WHEN n IS NULL THEN 'remove' WHEN n <> o THEN 'move' ELSE 'confirm' END AS action FROM b WHERE o IS NULL OR n IS NULL OR n <> o OR NOT confirmed""")
def submodule_reconcile(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("m"), k).alias("path"), F.sha2(F.concat(F.lit("s"), k), 256).alias("sha"))
    return plane.reconcile_submodules(s.where(k % 3 > 0).withColumn("materialized", k % 4 > 0), s.where(k % 7 > 0).select("path", F.when(k % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("sha")).alias("sha"), (k % 2 == 0).alias("confirmed")))


@query("submodule_inventory", """WITH s AS (SELECT s_suppkey AS k, 'libs/m' || s_suppkey AS path FROM supplier)
SELECT path, '../r' || k || '.git' AS url, 'https://git.example.org/team/r' || k || '.git' AS resolved, CASE WHEN k % 3 > 0 THEN sha256('l' || k) END AS sha, k % 2 = 0 AS materialized, 1 AS depth, false AS beyond FROM s
UNION ALL SELECT path || '/inner', './deep/x.git', 'https://git.example.org/team/r' || k || '.git/deep/x.git', NULL, false, 2, false FROM s WHERE k % 2 = 0""")
def submodule_inventory(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k, F.concat(F.lit("libs/m"), k).alias("path"))
    root = spark.createDataFrame([("", None, "https://git.example.org/team/main")], "repo string, path string, url string")
    declared = root.unionByName(s.select(F.lit("").alias("repo"), "path", F.concat(F.lit("../r"), k, F.lit(".git")).alias("url"))).unionByName(s.select(F.col("path").alias("repo"), F.lit("inner").alias("path"), F.lit("./deep/x.git").alias("url")))
    links = s.where(k % 3 > 0).select(F.lit("").alias("repo"), "path", F.sha2(F.concat(F.lit("l"), k), 256).alias("sha"))
    return plane.submodules(declared, links, s.where(k % 2 == 0).select("path"), 3)


@query("source_spawn", """WITH a AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'git' ELSE 'docs' END AS kind, 'n' || c_nationkey AS p FROM customer), i AS (SELECT kind, kind || '-source-data-' || p AS instance FROM a)
SELECT instance, kind, instance NOT LIKE '%-n1_' AS created FROM i""")
def source_spawn(spark, d):
    a = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "git").otherwise("docs").alias("kind"), F.concat(F.lit("data/n"), "c_nationkey").alias("p"))
    asked = a.select("kind", plane.instance_name(F.col("kind"), F.col("p"), F.lit(""), F.lit("")).alias("instance"))
    return plane.spawn(asked.where(F.col("instance").rlike("-n1.$")), asked)


@query("source_remove", """SELECT DISTINCT 's' || c_nationkey AS instance, CASE WHEN c_nationkey < 9 THEN 'removed' ELSE 'NOT_FOUND' END AS result FROM customer UNION ALL SELECT '', 'VALIDATION_FAILED'""")
def source_remove(spark, d):
    asked = read(spark, d, "customer").select(F.concat(F.lit("s"), "c_nationkey").alias("instance")).distinct()
    return plane.unspawn(read(spark, d, "nation").where("n_nationkey < 9").select(F.concat(F.lit("s"), "n_nationkey").alias("instance")), asked.union(spark.createDataFrame([("",)], "instance string")))


@query("git_url_protocols", "SELECT page_id, starts_with(url, 'https:') AS allowed FROM pages UNION ALL SELECT p_partkey, p_partkey % 4 <> 1 FROM part")
def git_url_protocols(spark, d):
    k = F.col("p_partkey")
    made = read(spark, d, "part").select(k.alias("page_id"), F.concat(F.when(k % 4 == 0, "git@h.org:").when(k % 4 == 1, "file:///").when(k % 4 == 2, "SSH://h.org/").otherwise("git://h/"), "p_name").alias("url"))
    return read(spark, d, "pages").select("page_id", "url").unionByName(made).select("page_id", plane.git_url_allowed(F.col("url")).alias("allowed"))


@query("path_allow_list", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS allowed, p_partkey % 3 > 0 AS contained FROM part")
def path_allow_list(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/data/src/x/../p"), k)).when(k % 4 == 1, F.concat(F.lit("/data/src/../p"), k)).when(k % 4 == 2, "/data/srcs").when(k % 8 == 3, "/data/src")
    return read(spark, d, "part").select(k, plane.path_allowed(path, ["/data/src", "/opt/"]).alias("allowed"), plane.key_contained(F.when(k % 3 == 0, "a/../b").otherwise(F.concat(F.lit("a/..b/"), k))).alias("contained"))


@query("source_validation", """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'unknown type' WHEN 1 THEN 'poll interval' WHEN 2 THEN 'url or path' WHEN 3 THEN 'branch and branches' WHEN 4 THEN 'language not in languages' WHEN 5 THEN 'paths' WHEN 6 THEN 'keyframe mode' WHEN 7 THEN 'scene threshold' WHEN 8 THEN 'scene threshold' WHEN 9 THEN 'poll interval' WHEN 10 THEN 'urls' END AS problem FROM part""")
def source_validation(spark, d):
    k = F.col("p_partkey") % 12
    none, list_ = F.lit(None).cast("string"), lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    kind = F.when(k == 0, "ftp").when(k.isin(2, 1), "git").when(k.isin(3), "repo").when(k == 4, "ast").when(k == 5, "docs").when(k.isin(6, 7, 8), "video").when(k == 9, "config").when(k == 10, "url").otherwise("image")
    s = F.struct(kind.alias("kind"), F.when(k.isin(1, 3), "https://x").otherwise("").alias("url"), F.when(k == 4, "/a").alias("path"), F.when(k.isin(6, 7, 8, 9, 11), list_("/a")).alias("paths"), list_().alias("urls"), F.when(k == 3, "main").alias("branch"), F.when(k == 3, list_("x*")).alias("branches"),
                 F.when(k == 4, "go").alias("language"), F.when(k == 4, list_("java")).alias("languages"), F.when(k == 11, list_(".png")).alias("extensions"), F.when(k == 1, "-5s").when(k == 9, "0h0m").otherwise("1m30s").alias("poll"), none.alias("index"),
                 F.when(k == 6, "all").otherwise("scene").alias("keyframes"), F.when(k == 7, float("nan")).when(k == 8, 1.5).otherwise(0.4).alias("scene"))
    return read(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", plane.source_problem().alias("problem"))


# ---- names, comments, guards ----------------------------------------------------------------------------------------

@query("id_overload", r"""SELECT p_partkey, 'src-' || lower(replace(p_brand, '#', '')) || '-h-' || left(sha256('src-' || lower(replace(p_brand, '#', '')) || '-h'), 0) || 'run' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '-' || left(sha256('(int a, ' || lower(p_type) || ' b)'), 6) END AS instance FROM part""")
def id_overload(spark, d):
    k = F.col("p_partkey")
    params = F.when(k % 4 > 0, F.concat(F.lit(" (int\ta,\n   "), F.lower("p_type"), F.lit("  b) ")))
    return read(spark, d, "part").select(k, ids.overload_instance(F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/h")), F.expr("CAST(array() AS array<string>)"), F.lit("run"), F.lit("function"), params).alias("instance"))


@query("id_documents", f"SELECT doc_id, 'acme.corpus.web.' || source || '.doc.' || {s_instance('''source || '/a b/' || doc_id || '.md' ''')} AS id, 'public' = CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'acme' END AS public, left(sha256(text), 12) AS blob, left(sha256(text), 6) || '-30s' AS keyframe, left(sha256(text), 7) AS short FROM documents")
def id_documents(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", ids.document_id(F.lit("acme"), F.col("source"), F.concat("source", F.lit("/a b/"), "doc_id", F.lit(".md"))).alias("id"), ids.is_public(F.when(F.col("doc_id") % 2 == 0, "public").otherwise("acme")).alias("public"),
                                              ids.blob_instance(t).alias("blob"), ids.keyframe_instance(t, F.lit("30s")).alias("keyframe"), ids.short_sha(F.sha2(t, 256)).alias("short"))


@query("id_scopes", r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'lib' ELSE 'lib-' || lower(replace(p_brand, '#', '-')) END AS system, 'a-' || p_partkey || '-b-' || left(sha256('a-' || p_partkey || '-b'), 0) || CASE WHEN p_partkey % 2 = 0 THEN 'Box-run' ELSE 'Box' END AS instance FROM part""")
def id_scopes(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 2 == 0, "method").otherwise("file")
    return read(spark, d, "part").select(k, ids.scoped_slug(F.lit("lib"), F.when(k % 3 == 0, "").otherwise(F.lower("p_brand"))).alias("system"), ids.scoped_instance(F.concat(F.lit("/a/"), k, F.lit(".b")), F.array(F.lit("Box")), F.lit("run"), kind).alias("instance"))


@query("doc_comments", r"""SELECT p_partkey, p_name || chr(10) || '  indented *' || chr(10) || chr(10) || 'last' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '@' || p_type ELSE '' END AS comment FROM part""")
def doc_comments(spark, d):
    block = F.concat(F.lit("  /**\n *\n * "), "p_name", F.lit("  \n\t*   indented *\n *\n last\t\n */ "))
    return read(spark, d, "part").select("p_partkey", text.with_metadata(text.clean_comment(block), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" @"), "p_type")).otherwise(" ")).alias("comment"))


@query("symbol_cap", """WITH s AS (SELECT l_suppkey % 5 AS file, 'function' AS kind, l_orderkey || '-' || l_linenumber AS name FROM lineitem UNION ALL SELECT DISTINCT l_suppkey % 5, 'file', 'f' FROM lineitem), n AS (SELECT file, count(*) FILTER (kind <> 'file') AS n FROM s GROUP BY 1),
m AS (SELECT list_sort(list(n))[3] AS most FROM n) SELECT CAST(s.file AS VARCHAR) AS file, kind, name FROM s JOIN n USING (file), m WHERE n.n <= most OR kind = 'file'""")
def symbol_cap(spark, d):
    l = read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("file"), F.lit("function").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"))
    most = sorted(r["count"] for r in l.groupBy("file").count().collect())[2]  # the third of five counts: two files are over it, one meets it
    return code.capped(l.unionByName(l.select("file", F.lit("file").alias("kind"), F.lit("f").alias("name")).distinct()), most)


@query("minified_names", r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A-MIN.JS' WHEN 1 THEN 'x/a.bundle.js' WHEN 2 THEN 'x.min.css' WHEN 3 THEN 'min.js' WHEN 4 THEN 'a.min.mjs' ELSE 'q-min.css' END AS path FROM part)
SELECT p_partkey, p_partkey % 6 IN (0, 2, 5) AS minified FROM p""")
def minified_names(spark, d):
    k = F.col("p_partkey") % 6
    path = F.when(k == 0, "A-MIN.JS").when(k == 1, "x/a.bundle.js").when(k == 2, "x.min.css").when(k == 3, "min.js").when(k == 4, "a.min.mjs").otherwise("q-min.css")
    return read(spark, d, "part").select("p_partkey", text.minified(path, F.lit("short")).alias("minified"))
