"""Parsers over generated files, and the rules of each language that resolve types and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import resolve
from lithic.plans.catalog import query, read
from lithic.plans.q_plane import lists
from lithic.sources import brace

# ---- parsers --------------------------------------------------------------------------------------------------------


def sources(spark, d, head, member, tail, name):
    """One file per brand with a member per part, and the parts' places in it."""
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("b"), "p_size", "p_type")
    text = lists(p.withColumn("m", member), "b", "p_partkey", "m")
    return text.select(F.concat(F.lit(name[0]), "b", F.lit(name[1])).alias("file"), F.concat(head, F.array_join("m", ""), F.lit(tail)).alias("text"))


S_PLACED = "p AS (SELECT *, replace(p_brand, '#', '') AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@query("parse_java_files", f"""WITH {S_PLACED}
SELECT 'src/' || b || '.java' AS file, 'method' AS kind, 'm' || p_partkey AS name, b AS scope, 6 + 5 * i AS start, 9 + 5 * i AS "end", 'int[],List<String>' AS params, 'Map<K, V>' AS returns, 'helper' || p_size || ',this.go' AS calls, '' AS bases FROM p
UNION ALL SELECT DISTINCT 'src/' || b || '.java', 'class', b, '', 3, 5 + 5 * n, '', '', '', 'Base;One;Two' FROM p
UNION ALL SELECT DISTINCT 'src/' || b || '.java', 'const', 'MAX', b, 4, 4, '', 'int', '', '' FROM p UNION ALL SELECT DISTINCT 'src/' || b || '.java', 'file', b || '.java', '', 1, 6 + 5 * n, '', '', '', '' FROM p""")
def parse_java_files(spark, d):
    member = F.concat(F.lit("  // call(me) {\n  @Override public Map<K, V> m"), "p_partkey", F.lit("(final int[] a, List<String> b) {\n    String s = \"} no(call) {\"; /* x( */\n    if (a != b) { helper"), "p_size", F.lit("(a); this.go(s); }\n  }\n"))
    f = sources(spark, d, F.concat(F.lit("package a;\n/** Doc. */\npublic final class "), "b", F.lit("<T> extends Base<T> implements One, Two<T> {\n  private static final int MAX = 3;\n")), member, "}\n", ("src/", ".java"))
    r = brace.symbols(f, "java")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return r.select("file", "kind", "name", "scope", "start", "end", joined("params"), joined("returns"), joined("calls"), F.array_join(F.concat("bases", "implements"), ";").alias("bases"))


@query("parse_go_files", f"""WITH {S_PLACED}
SELECT 'pkg/' || b || '.go' AS file, 'method' AS kind, 'M' || p_partkey AS name, b AS receiver, 10 + 4 * i AS start, 13 + 4 * i AS "end", 'int,int,...string' AS params, 'string,error' AS returns, 'b.next,pkg.Do' || p_size AS calls, '' AS embeds FROM p
UNION ALL SELECT DISTINCT 'pkg/' || b || '.go', 'struct', b, '', 3, 7, '', '', '', 'Base,pkg.Other' FROM p UNION ALL SELECT DISTINCT 'pkg/' || b || '.go', 'const', unnest(['A', 'B']), '', 8, 8, '', '', '', '' FROM p
UNION ALL SELECT DISTINCT 'pkg/' || b || '.go', 'file', b || '.go', '', 1, 10 + 4 * n, '', '', '', '' FROM p""")
def parse_go_files(spark, d):
    member = F.concat(F.lit("func (b *"), "b", F.lit(") M"), "p_partkey", F.lit("(a, c int, rest ...string) (string, error) {\n\tx := `no(call) {`\n\tif pkg.Do"), "p_size", F.lit("(a) { return b.next(x) } // go(1)\n}\n"))
    f = sources(spark, d, F.concat(F.lit("package m\n\ntype "), "b", F.lit(" struct {\n\tBase\n\t*pkg.Other `json:\"o\"`\n\tn int\n}\nconst A, B = 1, 2\n\n")), member, "", ("pkg/", ".go"))
    r = brace.symbols(f, "golang")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return r.select("file", "kind", "name", "receiver", "start", "end", joined("params"), joined("returns"), joined("calls"), joined("embeds"))


@query("parse_script_files", f"""WITH {S_PLACED}
SELECT 'web/' || b || '.ts' AS file, 'method' AS kind, 'm' || p_partkey AS name, b AS scope, 3 + 3 * i AS start, 5 + 3 * i AS "end", 'number,string' AS params, 'Promise<void>' AS returns, 'g' || p_size || ',this.x' AS calls FROM p
UNION ALL SELECT DISTINCT 'web/' || b || '.ts', 'class', b, '', 2, 3 + 3 * n, '', '', '' FROM p UNION ALL SELECT DISTINCT 'web/' || b || '.ts', 'function', 'f', '', 4 + 3 * n, 6 + 3 * n, 'number', '', 'h' FROM p
UNION ALL SELECT DISTINCT 'web/' || b || '.ts', 'type', 'T', '', 7 + 3 * n, 7 + 3 * n, '', '', '' FROM p UNION ALL SELECT DISTINCT 'web/' || b || '.ts', 'file', b || '.ts', '', 1, 8 + 3 * n, '', '', '' FROM p""")
def parse_script_files(spark, d):
    member = F.concat(F.lit("  async m"), "p_partkey", F.lit("(a: number, b?: string): Promise<void> {\n    g"), "p_size", F.lit("('} no(1)'); this.x(`{ ${a}`);\n  }\n"))
    f = sources(spark, d, F.concat(F.lit("import { g } from './g'\nexport default class "), "b", F.lit(" extends A<B> {\n")), member, "}\nexport const f = (x: number) => {\n  return h(x)\n}\nexport type T = { a: string }\n", ("web/", ".ts"))
    r = brace.symbols(f, "typescript")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return r.select("file", "kind", "name", "scope", "start", "end", joined("params"), joined("returns"), joined("calls"))


@query("parse_cpp_files", f"""WITH {S_PLACED}
SELECT 'lib/' || b || '.hpp' AS file, 'method' AS kind, 'get' || p_partkey AS name, 'x.' || b AS scope, 6 + 2 * i AS start, 7 + 2 * i AS "end", 'const std::string &,int' AS params, 'std::vector<int>' AS returns, 'q.find' || p_size AS calls, '' AS bases FROM p
UNION ALL SELECT DISTINCT 'lib/' || b || '.hpp', 'class', b, 'x', 3, 6 + 2 * n, '', '', '', 'Base<T>,other::B' FROM p UNION ALL SELECT DISTINCT 'lib/' || b || '.hpp', 'type', 'x', '', 2, 7 + 2 * n, '', '', '', '' FROM p
UNION ALL SELECT DISTINCT 'lib/' || b || '.hpp', 'const', 'MAX', '', 1, 1, '', '', '', '' FROM p UNION ALL SELECT DISTINCT 'lib/' || b || '.hpp', 'file', b || '.hpp', '', 1, 8 + 2 * n, '', '', '', '' FROM p""")
def parse_cpp_files(spark, d):
    member = F.concat(F.lit("  std::vector<int> get"), "p_partkey", F.lit("(const std::string &k, int n = 3) const {\n    return q->find"), "p_size", F.lit("(k); }\n"))
    f = sources(spark, d, F.concat(F.lit("#define MAX 3\nnamespace x {\ntemplate <class T>\nclass "), "b", F.lit(" : public Base<T>, private other::B {\npublic:\n")), member, "};\n}\n", ("lib/", ".hpp"))
    r = brace.symbols(f, "cpp")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return r.select("file", "kind", "name", "scope", "start", "end", joined("params"), joined("returns"), joined("calls"), joined("bases"))


# ---- rules ----------------------------------------------------------------------------------------------------------

@query("go_type_refs", """WITH r AS (SELECT p_partkey AS src, 'f' || (p_partkey % 9) AS file, p_brand AS dir, CASE p_partkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'pk.T' WHEN 2 THEN 'nn.T' WHEN 3 THEN p_name ELSE 'Own' || p_partkey END AS name FROM part), t AS (SELECT p_brand AS dir, p_name AS name, min('id' || p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT src, CASE WHEN name = 'int' THEN 'builtin:int' WHEN name = 'pk.T' THEN CASE WHEN file = 'f0' THEN 'pk.T' ELSE 'external:example.org/pk.T' END WHEN name = 'nn.T' THEN name ELSE coalesce(id, 'type:' || file || '#' || name) END AS dst FROM r LEFT JOIN t USING (dir, name)""")
def go_type_refs(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    refs = p.select(k.alias("src"), F.concat(F.lit("f"), k % 9).alias("file"), F.col("p_brand").alias("dir"), F.when(k % 5 == 0, "int").when(k % 5 == 1, "pk.T").when(k % 5 == 2, "nn.T").when(k % 5 == 3, F.col("p_name")).otherwise(F.concat(F.lit("Own"), k)).alias("name"))
    imports = spark.createDataFrame([(f"f{i}", "pk", "example.org/pk") for i in range(1, 9)], "file string, alias string, path string")
    return resolve.go_types(refs, imports, p.where(k % 2 == 0).select(F.col("p_brand").alias("dir"), F.col("p_name").alias("name"), F.concat(F.lit("id"), k).alias("id"))).select("src", "dst")


@query("python_call_refs", """WITH c AS (SELECT p_partkey AS src, 'f' || (p_partkey % 7) AS file, CASE p_partkey % 6 WHEN 0 THEN 'g' || (p_partkey % 20) WHEN 1 THEN 'imported' WHEN 2 THEN 'mod.run' WHEN 3 THEN 'self.m' || (p_partkey % 4) WHEN 4 THEN 'outside' ELSE 'mod.none' END AS name FROM part)
SELECT src, CASE WHEN name LIKE 'g%' THEN 'fn:' || file || ':' || name WHEN name = 'imported' THEN 'fn:lib:run' WHEN name = 'mod.run' THEN 'fn:lib:run' WHEN name LIKE 'self%' THEN 'me:' || file || ':' || name ELSE 'external:outside' END AS dst FROM c
WHERE src % 11 > 0 AND (name LIKE 'g%' AND CAST(substr(name, 2) AS INTEGER) < 15 OR name IN ('imported', 'mod.run', 'outside') OR name IN ('self.m1', 'self.m3'))""")
def python_call_refs(spark, d):
    k = F.col("p_partkey")
    calls = read(spark, d, "part").select(k.alias("src"), F.concat(F.lit("f"), k % 7).alias("file"), F.lit("Box").alias("scope"), F.when(k % 6 == 0, F.concat(F.lit("g"), k % 20)).when(k % 6 == 1, "imported").when(k % 6 == 2, "mod.run").when(k % 6 == 3, F.concat(F.lit("self.m"), k % 4)).when(k % 6 == 4, "outside").otherwise("mod.none").alias("name"))
    files = range(7)
    functions = spark.createDataFrame([(f"f{i}", f"g{j}", f"fn:f{i}:g{j}") for i in files for j in range(15)] + [("lib", "run", "fn:lib:run")], "file string, name string, id string")
    methods = spark.createDataFrame([(f"f{i}", "Box", f"m{j}", f"me:f{i}:self.m{j}") for i in files for j in (1, 3)], "file string, scope string, name string, id string")
    imports = spark.createDataFrame([(f"f{i}", a, b, c) for i in files for a, b, c in (("imported", "run", "lib"), ("mod", "", "lib"), ("outside", "x", None))], "file string, local string, origin string, target string")
    shadows = calls.where("src % 11 = 0").select("src", F.regexp_replace("name", r"\..*$", "").alias("name"))
    return resolve.python_calls(calls, functions, methods, imports, shadows)


@query("python_type_refs", """SELECT p_partkey AS src, CASE p_partkey % 6 WHEN 0 THEN 'builtin:list' WHEN 1 THEN 'builtin:Optional' WHEN 2 THEN 'class:lib.py#Real' WHEN 3 THEN 'external:Far' WHEN 4 THEN 'external:a.b.C' ELSE 'class:f.py#T' || p_size END AS dst FROM part""")
def python_type_refs(spark, d):
    k = F.col("p_partkey")
    refs = read(spark, d, "part").select(k.alias("src"), F.lit("f.py").alias("file"), F.when(k % 6 == 0, "list[int]").when(k % 6 == 1, "Optional[X]").when(k % 6 == 2, " Near").when(k % 6 == 3, "Far").when(k % 6 == 4, "a.b.C").otherwise(F.concat(F.lit("T"), "p_size")).alias("name"))
    return resolve.python_types(refs, spark.createDataFrame([("f.py", "Near", "Real", "lib.py"), ("f.py", "Far", "Far", None)], "file string, local string, origin string, target string")).select("src", "dst")


@query("java_type_refs", """SELECT p_partkey AS src, CASE p_partkey % 8 WHEN 0 THEN 'builtin:String' WHEN 1 THEN 'external:java.util.List' WHEN 2 THEN 'app/src/main/java/a/Own.java' WHEN 3 THEN 'b/Top.java' WHEN 4 THEN 'lib/src/test/java/c/One.java' WHEN 5 THEN NULL WHEN 6 THEN 'app/src/main/java/a/Beside.java' ELSE 'app/src/main/java/a/F.java' END AS dst FROM part""")
def java_type_refs(spark, d):
    k = F.col("p_partkey") % 8
    me = "app/src/main/java/a/F.java"
    refs = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.lit(me).alias("file"), F.when(k == 0, "String").when(k == 1, "List").when(k == 2, "Own").when(k == 3, "Top").when(k == 4, "One").when(k == 5, "Two").when(k == 6, "Beside").otherwise("Inner").alias("name"))
    imports = spark.createDataFrame([(me, "List", "java.util.List"), (me, "Own", "a.Own"), (me, "Top", "b.Top"), (me, "One", "c.One"), (me, "Two", "c.Two")], "file string, name string, fqn string")
    files = spark.createDataFrame([(f,) for f in (me, "app/src/main/java/a/Own.java", "b/Top.java", "lib/src/test/java/c/One.java", "lib/src/main/java/c/Two.java", "old/src/main/java/c/Two.java", "app/src/main/java/a/Beside.java", "a/b/c/src/main/java/c/One.java")], "file string")
    return resolve.java_types(refs, imports, spark.createDataFrame([(me, "a")], "file string, package string"), files).select("src", "dst")


@query("java_call_refs", """SELECT p_partkey AS src, CASE p_partkey % 6 WHEN 0 THEN 'A.run' WHEN 1 THEN 'B.go' WHEN 2 THEN 'A.run' WHEN 3 THEN 'A.run' ELSE 'B.new' END AS dst FROM part WHERE p_partkey % 6 < 5 AND NOT (p_partkey % 6 = 1 AND p_partkey % 4 = 1)""")
def java_call_refs(spark, d):
    k = F.col("p_partkey")
    p = read(spark, d, "part")
    calls = p.select(k.alias("src"), F.lit("C").alias("own"), F.when(k % 6 == 0, "this").when(k % 6 == 1, "v").when(k % 6 == 2, "").when(k % 6 == 3, "A").when(k % 6 == 4, "B").otherwise("A").alias("receiver"), F.when(k % 6 == 1, "go").when(k % 6 < 4, "run").otherwise("new").alias("member"))
    variables = p.select(k.alias("src"), F.lit("v").alias("receiver"), F.lit("C").alias("type")).union(p.where("p_partkey % 4 = 1").select(k, F.lit("v"), F.lit("Z")))
    parents = spark.createDataFrame([("C", "B"), ("B", "A")], "type string, parent string")
    return resolve.java_calls(calls, variables, parents, spark.createDataFrame([("A", "run"), ("B", "go"), ("A", "go")], "type string, member string"), spark.createDataFrame([("B",)], "type string"))


@query("script_call_refs", """SELECT p_partkey AS src, CASE p_partkey % 7 WHEN 0 THEN 'w:own' WHEN 1 THEN 'lib:real' WHEN 2 THEN 'lib:main' WHEN 3 THEN 'lib:real' ELSE 'w:Box.m' END AS dst FROM part WHERE p_partkey % 7 < 5 AND p_partkey % 5 > 0 AND NOT (p_partkey % 7 = 4 AND p_partkey % 2 = 0)""")
def script_call_refs(spark, d):
    k = F.col("p_partkey")
    calls = read(spark, d, "part").select(k.alias("src"), F.lit("w").alias("file"), F.lit("Box").alias("scope"), F.when(k % 7 == 0, "own").when(k % 7 == 1, "alias").when(k % 7 == 2, "def").when(k % 7 == 3, "ns.shown").when(k % 7 == 4, "this.m").when(k % 7 == 5, "hidden").otherwise("alias.x").alias("name"), (k % 2 == 0).alias("rebound"))
    functions = spark.createDataFrame([("w", "own", "w:own"), ("lib", "real", "lib:real"), ("lib", "main", "lib:main"), ("lib", "hidden", "lib:hidden")], "file string, name string, id string")
    imports = spark.createDataFrame([("w", "alias", "named", "shown", "lib"), ("w", "def", "default", "", "lib"), ("w", "ns", "namespace", "", "lib"), ("w", "hidden", "named", "hidden", "lib")], "file string, local string, kind string, origin string, target string")
    exports = spark.createDataFrame([("lib", "shown", "real"), ("lib", "default", "main")], "file string, export string, name string")
    methods = spark.createDataFrame([("w", "Box", "m", "w:Box.m")], "file string, scope string, name string, id string")
    return resolve.script_calls(calls, functions, imports, exports, methods, calls.where("src % 5 = 0").select("src", F.regexp_replace("name", r"\..*$", "").alias("name")))


@query("script_type_refs", """SELECT p_partkey AS src, CASE p_partkey % 7 WHEN 0 THEN 'builtin:string' WHEN 1 THEN 'class:b.ts#Base' WHEN 2 THEN 'external:Far' WHEN 3 THEN 'interface:a.ts#Local' WHEN 4 THEN 'enum:a.ts#Own' WHEN 5 THEN 'type:a.ts#B' ELSE 'external:R.C' END AS dst FROM part""")
def script_type_refs(spark, d):
    k = F.col("p_partkey") % 7
    refs = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.lit("a.ts").alias("file"), F.when(k == 0, ": string[]").when(k == 1, "B<T>").when(k == 2, "Far").when(k == 3, "Local").when(k == 4, ":Own | null").when(k == 5, "B").otherwise("R.C<X>").alias("name"), F.when(k.isin(1, 2), "class").when(k == 3, "interface").alias("kind"))
    return resolve.script_types(refs, spark.createDataFrame([("a.ts", "B", "Base", "b.ts"), ("a.ts", "Far", "Far", None)], "file string, local string, origin string, target string"), spark.createDataFrame([("a.ts", "Own", "enum")], "file string, name string, kind string")).select("src", "dst")


@query("c_call_refs", """WITH f AS (SELECT p_name || (p_partkey % 300) AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '.h' ELSE p_brand || '.c' END AS file, p_partkey AS line, 'd' || p_partkey AS id FROM part), u AS (SELECT name, arg_min(id, (line, id)) AS id FROM f WHERE file NOT LIKE '%.h' GROUP BY name HAVING count(DISTINCT file) = 1),
c AS (SELECT DISTINCT l_orderkey AS src, p_name || (p_partkey % 300) AS name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT DISTINCT src, id AS dst FROM c JOIN u USING (name) WHERE src % 9 > 0""")
def c_call_refs(spark, d):
    p = read(spark, d, "part").withColumn("name", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey") % 300))
    defs = p.select("name", F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, ".h").otherwise(".c")).alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("d"), "p_partkey").alias("id"))
    calls = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), "name").distinct()
    return resolve.c_calls(calls, defs, spark.createDataFrame([("a.cc",), ("b.c",)], "file string"), calls.where("src % 9 = 0"))


@query("cpp_base_refs", """WITH c AS (SELECT 'c' || p_partkey AS id, p_name || (p_partkey % 400) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'enum' ELSE 'class' END AS kind, (SELECT p_name || ((q.p_partkey * 7) % 400)) AS base FROM part q), i AS (SELECT name, min(id) AS dst FROM c WHERE kind = 'class' GROUP BY name HAVING count(*) = 1)
SELECT c.id AS src, dst FROM c JOIN i ON i.name = c.base WHERE c.id <> dst""")
def cpp_base_refs(spark, d):
    k = F.col("p_partkey")
    c = read(spark, d, "part").select(F.concat(F.lit("c"), k).alias("id"), F.concat("p_name", k % 400).alias("name"), F.when(k % 5 == 0, "enum").otherwise("class").alias("kind"), F.array(F.concat(F.lit("ns::deep::"), "p_name", (k * 7) % 400, F.lit("<T, a::b>"))).alias("bases"))
    return resolve.cpp_bases(c)


@query("svelte_component_refs", "SELECT p_partkey AS src, 'component:lib/Box.svelte' AS dst FROM part WHERE p_partkey % 3 = 0")
def svelte_component_refs(spark, d):
    k = F.col("p_partkey")
    tags = read(spark, d, "part").select(k.alias("src"), F.lit("a.svelte").alias("file"), F.when(k % 3 == 0, "Box").when(k % 3 == 1, "div").otherwise("Far").alias("tag"))
    return resolve.component_refs(tags, spark.createDataFrame([("a.svelte", "Box", "lib/Box.svelte"), ("a.svelte", "Far", None)], "file string, local string, target string"))
