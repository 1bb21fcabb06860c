"""Code symbols and the joins that resolve references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import text
from lithic.operators import resolve
from lithic.plans.catalog import query, read
from lithic.plans.q_config import files, values
from lithic.sources import code

PY = [("pkg/a.py", 'LIMIT = 3\n\ndef helper():\n    return LIMIT\n\nclass Box:\n    """A box."""\n    @property\n    def size(self):\n        return self._n() + helper()\n    def _n(self):\n        return 1\n'), ("pkg/bad.py", "def broken(:\n")]
GO = [("m/a.go", "package m\n\nfunc Run(x int) error {\n\treturn nil\n}\n\ntype Box struct {\n}\n\nfunc (b *Box) size() int {\n}\nvar limit = 3\n")]
JAVA = [("A.java", "public class A extends B {\n    private int f;\n    public static void main(String[] args) {\n    }\n}\ninterface I {\n}\n")]
TS = [("a.ts", "export class A {\n}\nexport const x = 1\nexport async function go() {\n}\ninterface I {}\ntype T = string\n")]
C = [("a.c", "#define MAX 3\nstruct node {\n};\nstatic int add(int a, int b)\n{\n}\nint go(void);\n")]
CPP = [("a.cpp", "namespace x {\nclass Node {\n};\ntemplate <class T> struct Box {\n};\n}\n")]
SVELTE = [("A.svelte", "<script>\nlet { a } = $props();\nlet n = $state(0);\nlet m = $state(1);\nfunction go() {}\n</script>\n")]


@query("parse_python", values('file, kind, name, scope, start, "end", visibility, doc, calls', [
    ("pkg/a.py", "file", "a.py", "", 1, 13, "public", "", ""), ("pkg/a.py", "const", "LIMIT", "", 1, 1, "public", "", ""), ("pkg/a.py", "function", "helper", "", 3, 4, "public", "", ""), ("pkg/a.py", "class", "Box", "", 6, 12, "public", "A box.", ""),
    ("pkg/a.py", "method", "size", "Box", 9, 10, "public", "@property", "helper,self._n"), ("pkg/a.py", "method", "_n", "Box", 11, 12, "private", "", ""), ("pkg/bad.py", "file", "bad.py", "", 1, 2, "public", "", "")]))
def parse_python(spark, d):
    return code.python_symbols(files(spark, PY)).withColumn("calls", F.array_join("calls", ","))


def declared(name, language, rows, want):
    @query(name, values("file, line, kind, name, exported", want))
    def run(spark, d):
        return code.declared(files(spark, rows), language)

    return run


declared("parse_go", "golang", GO, [("m/a.go", 3, "function", "Run", True), ("m/a.go", 7, "struct", "Box", True), ("m/a.go", 10, "method", "size", False), ("m/a.go", 12, "var", "limit", False)])
declared("parse_java", "java", JAVA, [("A.java", 1, "class", "A", True), ("A.java", 3, "method", "main", True), ("A.java", 6, "interface", "I", True)])
declared("parse_typescript", "typescript", TS, [("a.ts", 1, "class", "A", True), ("a.ts", 3, "var", "x", True), ("a.ts", 4, "function", "go", True), ("a.ts", 6, "interface", "I", True), ("a.ts", 7, "type", "T", True)])
declared("parse_c", "c", C, [("a.c", 1, "const", "MAX", True), ("a.c", 2, "struct", "node", True), ("a.c", 4, "function", "add", True), ("a.c", 7, "function", "go", True)])
declared("parse_cpp", "cpp", CPP, [("a.cpp", 1, "type", "x", True), ("a.cpp", 2, "class", "Node", True), ("a.cpp", 4, "struct", "Box", True)])
declared("parse_svelte", "svelte", SVELTE, [("A.svelte", 3, "var", "n", True), ("A.svelte", 4, "var", "m", True), ("A.svelte", 5, "function", "go", True)])


@query("svelte_runes", values("file, rune, n", [("A.svelte", "props", 1), ("A.svelte", "state", 2)]))
def svelte_runes(spark, d):
    return code.runes(files(spark, SVELTE))


@query("resolve_unique_calls", """
WITH f AS (SELECT p_name AS name, p_brand AS file, p_partkey AS line, 'p' || p_partkey AS id FROM part), u AS (SELECT name, arg_min(id, line) AS id FROM f GROUP BY name HAVING count(DISTINCT file) = 1),
c AS (SELECT 's' || l_suppkey AS src, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey), sh AS (SELECT 's' || s_suppkey AS src, p_name AS name FROM supplier JOIN part ON s_suppkey = p_partkey)
SELECT DISTINCT src, id AS dst FROM c JOIN u USING (name) WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.src = c.src AND sh.name = c.name)""")
def resolve_unique_calls(spark, d):
    part = read(spark, d, "part")
    defs = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("p"), F.col("p_partkey")).alias("id"))
    named = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    src = lambda c: F.concat(F.lit("s"), F.col(c)).alias("src")
    calls = read(spark, d, "lineitem").join(named, F.col("l_partkey") == F.col("k")).select(src("l_suppkey"), "name")
    shadows = read(spark, d, "supplier").join(named, F.col("s_suppkey") == F.col("k")).select(src("s_suppkey"), "name")
    return resolve.resolve_calls(calls, defs, shadows)


@query("resolve_module_prefix", r"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '^[^:/?#]+://([^?#]*)', 1) AS path FROM pages), m AS (SELECT DISTINCT regexp_extract(path, '^([^/]*/[^/]+)', 1) AS module FROM p WHERE length(path) % 2 = 0 UNION SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1) FROM p)
SELECT path, arg_max(module, length(module)) AS module FROM p JOIN m ON module <> '' AND (path = module OR starts_with(path, module || '/')) GROUP BY path""")
def resolve_module_prefix(spark, d):
    p = read(spark, d, "pages").select(F.regexp_extract("url", "^[^:/?#]+://([^?#]*)", 1).alias("path")).distinct()
    m = p.where(F.length("path") % 2 == 0).select(F.regexp_extract("path", "^([^/]*/[^/]+)", 1).alias("module")).union(p.select(F.regexp_extract("path", "^([^/]*)", 1))).where("module <> ''")
    return resolve.longest_prefix(p, m).select("path", "module")


@query("resolve_python_modules", values("src, module, target", [("a", "pkg.b", "pkg/b.py"), ("a", "pkg", "pkg/__init__.py")]))
def resolve_python_modules(spark, d):
    refs = spark.createDataFrame([("a", "pkg.b"), ("a", "pkg"), ("a", "other.x")], "src string, module string")
    f = spark.createDataFrame([("pkg/b.py",), ("pkg/__init__.py",), ("pkg/b/__init__.py",)], "file string")
    return resolve.first_existing(refs, f, resolve.python_candidates(F.col("module")))


@query("resolve_script_modules", values("file, spec, target", [("src/a/x.ts", "./y", "src/a/y.tsx"), ("src/a/x.ts", "../b", "src/b/index.d.ts"), ("src/a/x.ts", "./types", "src/a/types.d.ts"), ("top.ts", ".", "index.js")]))
def resolve_script_modules(spark, d):
    refs = spark.createDataFrame([("src/a/x.ts", "./y"), ("src/a/x.ts", "../b"), ("src/a/x.ts", "./types"), ("src/a/x.ts", "../../../out"), ("src/a/x.ts", "src/b"), ("src/a/x.ts", "./plain.css"), ("src/a/x.ts", "./C"), ("top.ts", ".")], "file string, spec string")
    f = spark.createDataFrame([("src/a/y.tsx",), ("src/a/y.js",), ("src/b/index.d.ts",), ("src/b/index.js",), ("out.ts",), ("src/a/types.d.ts",), ("src/a/types.js",), ("src/b.mjs.txt",), ("src/a/plain.css",), ("src/a/C.svelte",), ("index.js",)], "file string")
    return resolve.first_existing(refs, f, resolve.script_candidates(resolve.relative(F.col("file"), F.col("spec"))))


@query("resolve_nearest_ancestor", values("type, member, owner", [("C", "m", "B"), ("D", "k", "A")]))
def resolve_nearest_ancestor(spark, d):
    asks = spark.createDataFrame([("C", "m"), ("D", "k"), ("E", "m"), ("C", "none")], "type string, member string")
    parents = spark.createDataFrame([("C", "B"), ("B", "A"), ("D", "C"), ("E", "X"), ("E", "Y")], "type string, parent string")
    declares = spark.createDataFrame([("B", "m"), ("A", "m"), ("A", "k"), ("X", "m"), ("Y", "m")], "type string, member string")
    return resolve.nearest_declaring(asks, parents, declares)


@query("test_paths", values("path, test", [("a_test.go", True), ("x/y.spec.ts", True), ("test_a.py", True), ("tests/a.py", True), ("src/test/A.java", True), ("ATest.java", True), ("x/__tests__/y.js", True), ("src/main.go", False)]))
def test_paths(spark, d):
    p = spark.createDataFrame([("a_test.go",), ("x/y.spec.ts",), ("test_a.py",), ("tests/a.py",), ("src/test/A.java",), ("ATest.java",), ("x/__tests__/y.js",), ("src/main.go",)], "path string")
    return p.select("path", text.is_test_path(F.col("path")).alias("test"))


@query("file_guard", r"""
WITH b AS (SELECT doc_id, octet_length(encode(text)) AS size, regexp_replace(left(hex(encode(text)), 131072), '(..)', '\1,', 'g') AS probe FROM documents)
SELECT doc_id, size >= 4096 AND floor((length(probe) / 3) / len(string_split(probe, '0A,'))) > 512 AS minified FROM b""")
def file_guard(spark, d):
    return read(spark, d, "documents").select("doc_id", text.minified(F.lit("a.txt"), F.col("text")).alias("minified"))


@query("route_extension", values("path, language", [("a.go", "golang"), ("b.H", "cpp"), ("c.tsx", "typescript"), ("d.mjs", "javascript"), ("e.txt", None)]))
def route_extension(spark, d):
    p = spark.createDataFrame([("a.go",), ("b.H",), ("c.tsx",), ("d.mjs",), ("e.txt",)], "path string")
    return p.select("path", code.route(F.col("path")).alias("language"))
