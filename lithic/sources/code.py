"""Symbols of source files: Python by its own grammar, other languages by their declaration lines."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic import vocab

SYMBOL = "file string, kind string, name string, scope string, start long, `end` long, visibility string, doc string, calls array<string>"
_SCHEMA = pa.schema([("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("scope", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("visibility", pa.string()), ("doc", pa.string()), ("calls", pa.list_(pa.string()))])
#: A file of more symbols keeps its containers only; these kinds don't count as symbols.
MOST_SYMBOLS = 5000
CONTAINERS = ("repo", "folder", "file", "package")


def _called(node: ast.AST) -> list[str]:
    """Plain names and self. members called in a body, nested classes left out."""
    out, todo = set(), list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, ast.ClassDef):
            continue
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.add(f.id)
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls"):
                out.add("self." + f.attr)
        todo += ast.iter_child_nodes(n)
    return sorted(out)


def python_file(path: str, text: str) -> list[dict]:
    """Module, classes, functions, methods, constants (all capitals) and variables; a file that can't be parsed is its file alone."""
    out = [{"file": path, "kind": "file", "name": path.rsplit("/", 1)[-1], "scope": "", "start": 1, "end": text.count("\n") + 1, "visibility": "public", "doc": "", "calls": []}]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def put(node: ast.stmt, kind: str, name: str, scope: str, doc: str = "", calls: list[str] | None = None) -> None:
        out.append({"file": path, "kind": kind, "name": name, "scope": scope, "start": node.lineno, "end": node.end_lineno, "visibility": "private" if name.startswith("_") else "public", "doc": doc, "calls": calls or []})

    def walk(body: list[ast.stmt], scope: str, in_class: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                put(node, "class", node.name, scope, ast.get_docstring(node) or "")
                walk(node.body, f"{scope}.{node.name}".lstrip("."), True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                decorated = " ".join("@" + ast.unparse(x) for x in node.decorator_list)
                put(node, "method" if in_class else "function", node.name, scope, f"{decorated} {ast.get_docstring(node) or ''}".strip(), _called(node))
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        put(node, "const" if t.id.isupper() else "var", t.id, scope)

    walk(tree.body, "", False)
    symbols = sum(x["kind"] not in CONTAINERS for x in out)
    return out if symbols <= MOST_SYMBOLS else [x for x in out if x["kind"] in CONTAINERS]


def python_symbols(files: DataFrame) -> DataFrame:
    """A row per symbol of (file, text), parsed where the file is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(python_file(r["file"], r["text"] or ""), schema=_SCHEMA)

    return files.select("file", "text").mapInArrow(run, SYMBOL)


# Declaration lines by language: pattern, kind. The first group is the name.
DECLARATIONS = {
    "golang": [(r"^func\s+\([^)]*\)\s*(\w+)\s*\(", "method"), (r"^func\s+(\w+)\s*[\[(]", "function"), (r"^type\s+(\w+)\s+struct\b", "struct"), (r"^type\s+(\w+)\s+interface\b", "interface"), (r"^type\s+(\w+)\s", "type"), (r"^const\s+(\w+)\b", "const"), (r"^var\s+(\w+)\b", "var")],
    "java": [(r"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*class\s+(\w+)", "class"), (r"^\s*(?:(?:public|protected|private|static)\s+)*interface\s+(\w+)", "interface"), (r"^\s*(?:(?:public|protected|private|static)\s+)*enum\s+(\w+)", "enum"), (r"^\s*(?:(?:public|protected|private|static|final)\s+)*record\s+(\w+)", "class"),
             (r"^\s+(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)+[\w<>\[\], .?]+\s+(\w+)\s*\(", "method")],
    "typescript": [(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^(?:export\s+)?interface\s+(\w+)", "interface"), (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"^(?:export\s+)?type\s+(\w+)\s*[=<]", "type"), (r"^(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"), (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)", "var")],
    "c": [(r"^#define\s+(\w+)", "const"), (r"^(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*\{", "struct"), (r"^(?:typedef\s+)?enum\s+(\w+)\s*\{", "enum"), (r"^typedef\s+.*?(\w+)\s*;", "type"), (r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s*]*?[\s*](\w+)\s*\([^;{]*\)\s*[;{]?\s*$", "function")],
    "cpp": [(r"^\s*namespace\s+(\w+)", "type"), (r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)", "class"), (r"^\s*(?:template\s*<[^>]*>\s*)?(?:struct|union)\s+(\w+)", "struct"), (r"^\s*enum\s+(?:class\s+)?(\w+)", "enum"), (r"^\s*using\s+(\w+)\s*=", "type"), (r"^#define\s+(\w+)", "const"), (r"^[A-Za-z_][\w:<>,\s*&~]*?[\s*&](\w+)\s*\([^;{]*\)\s*(?:const)?\s*\{?\s*$", "function")],
    "svelte": [(r"^\s*(?:export\s+)?function\s+(\w+)", "function"), (r"^\s*(?:let|const)\s+(\w+)\s*=\s*\$(?:state|derived|props|bindable)", "var"), (r"^\s*(?:export\s+)?(?:let|const)\s+(\w+)", "var")],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
RUNES = r"\$(props|state|derived|effect|bindable)\b"


def route(path: Column) -> Column:
    """The language of a path by its extension; null for what isn't code. Of the contested header extension, C++."""
    out = F.lit(None).cast("string")
    for suffix, language in vocab.ROUTES:
        out = F.when(F.lower(path).endswith(suffix), language).otherwise(out)
    return out


def declared(files: DataFrame, language: str) -> DataFrame:
    """(file, line, kind, name, exported) of (file, text): one native pass over lines; the first fitting pattern counts."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, k in reversed(DECLARATIONS[language]):
        kind, name = F.when(F.col("line").rlike(pattern), k).otherwise(kind), F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)).otherwise(name)
    first = F.substring("name", 1, 1)
    out = lines.select("file", (F.col("n") + 1).alias("line"), kind.alias("kind"), name.alias("name")).where("kind IS NOT NULL")
    return out.withColumn("exported", (first != F.lower(first)) if language == "golang" else F.lit(True))


def capped(symbols: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """Symbols of any language without those of files that have more than `most`; containers (repo, folder, file, package) stay."""
    is_symbol = ~F.col("kind").isin(*CONTAINERS)
    over = symbols.where(is_symbol).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > most).select("file", F.lit(True).alias("over"))
    return symbols.join(over, "file", "left").where(F.col("over").isNull() | ~is_symbol).select(*symbols.columns)


def runes(files: DataFrame) -> DataFrame:
    """(file, rune, n) of component files."""
    return files.select("file", F.explode(F.regexp_extract_all("text", F.lit(RUNES), F.lit(1))).alias("rune")).groupBy("file", "rune").agg(F.count("*").alias("n"))


def walk(spark, root: str, excludes: list[str] | None = None) -> DataFrame:
    """(file, text) of a tree of code files; pruned folders (node_modules, hidden ones, excludes) and other sources' trees left out.

    A folder below the root that holds .git belongs to another source. Paths are chosen before any file is read.
    """
    from lithic.sources import plane

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    below = F.substring(path, len(root.rstrip("/")) + 1, 100_000) if "://" in root else F.element_at(F.split(path, F.lit(root.rstrip("/") + "/")), -1)
    paths = raw.select(path, below.alias("below"))
    foreign = paths.where(F.col("below").rlike(r"(^|/)[^/]+/\.git(/|$)"))
    kept = plane.outside_boundaries(paths.where(plane.scanned(F.col("below"), excludes or []) & route(F.col("below")).isNotNull()), "below", plane.boundaries(foreign, "below"))
    return raw.join(kept.select("path"), "path", "left_semi").select(path.alias("file"), F.decode("content", "UTF-8").alias("text"))
