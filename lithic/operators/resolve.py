"""References to definitions: an edge only where the target is known and unique, otherwise none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_definitions(defs: DataFrame) -> DataFrame:
    """(name, id) of names that exactly one file defines; the first definition in a file counts. From (name, file, line, id)."""
    one = defs.groupBy("name").agg(F.min("file").alias("low"), F.max("file").alias("high"), F.min(F.struct("line", "id")).alias("first"))
    return one.where("low = high").select("name", F.col("first.id").alias("id"))


def resolve_calls(calls: DataFrame, defs: DataFrame, shadows: DataFrame | None = None) -> DataFrame:
    """(src, dst) from calls (src, name): unshadowed names with one definition, never a call of itself by itself alone."""
    open_ = calls if shadows is None else calls.join(shadows, ["src", "name"], "left_anti")
    return open_.join(unique_definitions(defs), "name").select("src", F.col("id").alias("dst")).distinct()


def in_package(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst) from calls (src, dir, name) to the first definition (dir, name, file, line, id) of their directory; tests define nothing."""
    first = defs.where(~F.col("file").endswith("_test.go")).groupBy("dir", "name").agg(F.min(F.struct("file", "line", "id"))["id"].alias("dst"))
    return calls.join(first, ["dir", "name"]).select("src", "dst").distinct()


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module, rest): the deepest module that encloses each path.

    Every ancestor of a path is a candidate and meets the modules in an equi join, so no range join compares all with all.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select("path", F.explode(up).alias("module")).join(modules.select("module").distinct(), "module")
    best = found.groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))
    return best.withColumn("rest", F.ltrim(F.col("path").substr(F.length("module") + 1, F.length("path")), F.lit("/")))


def first_existing(refs: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """refs with the first of their candidate paths that exists, as `target`; refs without one fall away."""
    spread = refs.select("*", F.posexplode(candidates).alias("order", "target"))
    hits = spread.join(files.select(F.col("file").alias("target")).distinct(), "target")
    keys = refs.columns
    return hits.groupBy(*keys).agg(F.min(F.struct("order", "target"))["target"].alias("target"))


def python_candidates(module: Column) -> Column:
    path = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))


# What a relative import may name, in order: a file of the same name first, then a folder's index.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")


def script_candidates(target: Column) -> Column:
    both = F.array(*[F.concat(target, F.lit(s)) for s in SCRIPT_SUFFIXES], *[F.concat_ws("/", F.nullif(target, F.lit("")), F.lit("index" + s)) for s in SCRIPT_SUFFIXES])
    return F.when(target.isNotNull(), both)


def relative(path: Column, spec: Column) -> Column:
    """A relative specifier beside a file, normalised; null where it leaves the root, or doesn't begin with a dot."""
    start = F.filter(F.concat(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.split(spec, "/")), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(start, F.array(F.lit("/")).cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).otherwise(F.slice(a, 1, F.size(a) - 1)))
    return F.when(spec.startswith(".") & (F.element_at(F.concat(walked, F.array(F.lit(""))), 1) == "/"), F.array_join(F.slice(walked, 2, F.greatest(F.size(walked) - 1, F.lit(0))), "/"))


def nearest_declaring(asks: DataFrame, parents: DataFrame, declares: DataFrame, most_depth: int = 12) -> DataFrame:
    """(type, member, owner): the nearest ancestor that declares a member; two at one depth give none. Rounds over the frontier."""
    front = asks.select("type", "member", F.col("type").alias("at"))
    out = None
    for depth in range(most_depth + 1):
        hit = front.join(declares.select(F.col("type").alias("at"), "member"), ["at", "member"], "left_semi").select("type", "member", "at", F.lit(depth).alias("depth"))
        out = hit if out is None else out.unionByName(hit)
        front = front.join(hit.select("type", "member").distinct(), ["type", "member"], "left_anti").join(parents.select(F.col("type").alias("at"), "parent"), "at").select("type", "member", F.col("parent").alias("at")).distinct()
        if depth % 3 == 2:
            from lithic.operators.retrieval import _checkpointed

            front, out = _checkpointed(front), _checkpointed(out)
            if front.isEmpty():
                break
    w = W.partitionBy("type", "member")
    return out.withColumns({"near": F.min("depth").over(w)}).where("depth = near").groupBy("type", "member").agg(F.count_distinct("at").alias("n"), F.min("at").alias("owner")).where("n = 1").drop("n")


# ---- types and calls by language ------------------------------------------------------------------------------------
#
# A reference resolves to an id, to a marker (builtin: or external:) that never matches an entity, or to none. The rules of a
# language are joins against what its files define and import; each gives a column `dst`.

# Names that a language brings along. Fixed values.
BUILTINS = {
    "golang": ("bool", "byte", "complex128", "complex64", "error", "float32", "float64", "int", "int16", "int32", "int64", "int8", "rune", "string", "uint", "uint16", "uint32", "uint64", "uint8", "uintptr", "any", "comparable"),
    "python": ("int", "float", "str", "bool", "bytes", "list", "dict", "set", "tuple", "object", "None", "type", "complex", "frozenset", "bytearray"),
    "java": ("byte", "short", "int", "long", "float", "double", "boolean", "char", "void", "String", "Object"),
    "typescript": ("string", "number", "boolean", "any", "unknown", "never", "void", "null", "undefined", "object", "symbol", "bigint"),
}


def _left(refs: DataFrame, table: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """refs with one value per key of a table as `name`; keys are not repeated in refs' rows."""
    one = table.groupBy(*keys).agg(F.min(value).alias(name))
    return refs.join(one, keys, "left")


def go_types(refs: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """refs (src, file, dir, name) with dst: a builtin, an imported package's type as external, a type of the package's directory, else one of its own file.

    imports (file, alias, path), types (dir, name, id); a qualified name without an import stays as it is written.
    """
    alias, member = F.regexp_extract("name", r"^([^.]+)\.", 1), F.regexp_replace("name", r"^[^.]+\.", "")
    met = _left(refs.withColumn("alias", alias), imports, ["file", "alias"], "path", "path")
    met = _left(met, types, ["dir", "name"], "id", "local")
    qualified = F.when(F.col("path").isNotNull(), F.concat(F.lit("external:"), "path", F.lit("."), member)).otherwise(F.col("name"))
    own = F.coalesce("local", F.concat(F.lit("type:"), "file", F.lit("#"), "name"))
    dst = F.when(F.col("alias") != "", qualified).when(F.col("name").isin(*BUILTINS["golang"]), F.concat(F.lit("builtin:"), "name")).otherwise(own)
    return met.withColumn("dst", dst).select(*refs.columns, "dst")


def python_calls(calls: DataFrame, functions: DataFrame, methods: DataFrame, imports: DataFrame, shadows: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, file, scope, name): a file's own function, a confirmed function of an imported module, a method of the own class.

    functions (file, name, id) are top-level ones; methods (file, scope, name, id); imports (file, local, origin, target), target
    null for a module outside the tree; shadows (src, name): parameters and locals, through whose values nothing is called.
    """
    head = F.regexp_extract("name", r"^([^.]*)\.", 1)
    member = F.regexp_replace("name", r"^[^.]*\.", "")
    rows = calls.withColumns({"head": F.when(head == "", F.col("name")).otherwise(head), "member": member, "dotted": head != ""})
    rows = rows.join(shadows.select("src", F.col("name").alias("head")).distinct(), ["src", "head"], "left_anti")
    of_self = rows.where(F.col("head").isin("self", "cls") & F.col("dotted") & (F.col("scope") != "")).join(methods.select("file", "scope", F.col("name").alias("member"), F.col("id").alias("dst")), ["file", "scope", "member"]).select("src", "dst")
    plain = rows.where(~F.col("dotted"))
    own = plain.join(functions.select("file", "name", F.col("id").alias("dst")), ["file", "name"])
    rest = rows.where(~F.col("head").isin("self", "cls")).join(functions.select("file", F.col("name").alias("name")), ["file", "name"], "left_anti")
    bound = rest.join(imports.select("file", F.col("local").alias("head"), "origin", "target"), ["file", "head"])
    wanted = F.when(F.col("dotted"), F.col("member")).otherwise(F.col("origin"))
    outside = bound.where("target IS NULL").select("src", F.concat(F.lit("external:"), "name").alias("dst"))
    inside = bound.where("target IS NOT NULL").select("src", F.col("target").alias("file"), wanted.alias("name")).join(functions.select("file", "name", F.col("id").alias("dst")), ["file", "name"]).select("src", "dst")
    return of_self.unionByName(own.select("src", "dst")).unionByName(outside).unionByName(inside).distinct()


def python_types(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (src, file, name) with dst: a builtin (also with arguments), an imported class, an external one, else a class of the file."""
    base = F.regexp_replace(F.trim("name"), r"\[.*$", "")
    met = refs.withColumn("local", F.trim("name")).join(imports.select("file", "local", "origin", "target"), ["file", "local"], "left")
    built = base.isin(*BUILTINS["python"]) | (base.isin("Optional", "Union") & F.trim("name").contains("["))
    imported = F.when(F.col("target").isNotNull(), F.concat(F.lit("class:"), "target", F.lit("#"), "origin")).otherwise(F.concat(F.lit("external:"), F.trim("name")))
    dst = F.when(built, F.concat(F.lit("builtin:"), base)).when(F.col("origin").isNotNull(), imported).when(F.trim("name").contains("."), F.concat(F.lit("external:"), F.trim("name"))).otherwise(F.concat(F.lit("class:"), "file", F.lit("#"), F.trim("name")))
    return met.withColumn("dst", dst).select(*refs.columns, "dst")


def java_types(refs: DataFrame, imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """refs (src, file, name) with dst, the defining file: an import, sought in the own source root, from the root, then in exactly one sibling root; else the same package.

    imports (file, name, fqn), packages (file, package), files (file). A name found in several sibling roots is ambiguous: it
    has no dst, unlike one that is found nowhere, which is external. A name of the same package that no file defines is the
    file's own.
    """
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    rows = refs.join(packages, "file", "left").withColumns({"folder": folder, "as_path": F.replace(F.coalesce("package", F.lit("")), F.lit("."), F.lit("/"))})
    root = F.when(F.col("as_path") == "", F.col("folder")).when(F.col("folder") == F.col("as_path"), "").when(F.col("folder").endswith(F.concat(F.lit("/"), "as_path")), F.expr("substring(folder, 1, length(folder) - length(as_path) - 1)")).otherwise("")
    rows = rows.withColumn("root", root).join(imports, ["file", "name"], "left").withColumn("target", F.concat(F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".java")))
    there = files.select(F.col("file").alias("found")).distinct()
    one = lambda df, path, name: df.join(there.withColumnRenamed("found", name), path == F.col(name), "left")
    rows = one(rows, F.when(F.col("root") == "", F.col("target")).otherwise(F.concat_ws("/", "root", "target")), "own")
    rows = one(rows, F.col("target"), "top")
    rows = one(rows, F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.concat("name", F.lit(".java"))), "beside")
    layout = r"^(?:[^/]+/){1,2}src/[^/]+/java/"
    siblings = files.where(F.col("file").rlike(layout)).select(F.regexp_replace("file", layout, "").alias("target"), "file").groupBy("target").agg(F.count("*").alias("n"), F.min("file").alias("sibling"))
    # Only a source root of the same layout has siblings.
    rows = rows.join(siblings, "target", "left").withColumn("laid", F.concat("root", F.lit("/")).rlike(r"(^|/)src/[^/]+/java/$"))
    by_import = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("top").isNotNull(), F.col("top")).when(F.col("laid") & (F.col("n") == 1), F.col("sibling")).when(F.col("laid") & (F.col("n") > 1), F.lit(None)).otherwise(F.concat(F.lit("external:"), "fqn"))
    dst = F.when(F.col("name").isin(*BUILTINS["java"]), F.concat(F.lit("builtin:"), "name")).when(F.col("name").contains("."), F.concat(F.lit("external:"), "name")).when(F.col("fqn").isNotNull(), by_import).otherwise(F.coalesce("beside", "file"))
    return rows.withColumn("dst", dst).select(*refs.columns, "dst")


def receiver_types(variables: DataFrame) -> DataFrame:
    """(src, receiver, type) of (src, receiver, type): a name with two types in one callable tells nothing."""
    return variables.groupBy("src", "receiver").agg(F.count_distinct("type").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")


def java_calls(calls: DataFrame, variables: DataFrame, parents: DataFrame, declares: DataFrame, constructors: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, own, receiver, member): by the receiver's type, a class's name, or the own class, to the nearest ancestor that declares the member.

    An empty receiver or `this` is the own class; member new calls a constructor, only of a type (receiver) that declares one.
    variables (src, receiver, type), declares (type, member), parents (type, parent), constructors (type).
    """
    made = calls.where("member = 'new'").join(constructors.select(F.col("type").alias("receiver")).distinct(), "receiver", "left_semi").select("src", F.concat_ws(".", "receiver", F.lit("new")).alias("dst"))
    rest = calls.where("member <> 'new'")
    known = declares.select(F.col("type").alias("class_name")).union(parents.select("type")).distinct()
    rows = rest.join(receiver_types(variables), ["src", "receiver"], "left").join(known, F.col("receiver") == F.col("class_name"), "left")
    shadowed = variables.select("src", "receiver", F.lit(True).alias("is_variable")).distinct()
    rows = rows.join(shadowed, ["src", "receiver"], "left")
    of = F.when(F.col("receiver").isin("", "this"), F.col("own")).when(F.col("is_variable"), F.col("type")).otherwise(F.col("class_name"))
    asked = rows.select("src", of.alias("type"), "member").where("type IS NOT NULL")
    owners = nearest_declaring(asked.select("type", "member").distinct(), parents, declares)
    return made.unionByName(asked.join(owners, ["type", "member"]).select("src", F.concat_ws(".", "owner", "member").alias("dst"))).distinct()


def script_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, exports: DataFrame, methods: DataFrame, shadows: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, file, scope, name, rebound) in TypeScript, JavaScript and component scripts.

    A shadowed head calls nothing; then the file's own function; a named import by the export's real name, a default import by
    what the module declares as its default, a namespace's member by its export; this.m in the own class unless `this` is
    rebound. imports (file, local, kind: named, default or namespace, origin, target), exports (file, export, name),
    functions (file, name, id), methods (file, scope, name, id).
    """
    head, member = F.regexp_extract("name", r"^([^.]*)\.", 1), F.regexp_replace("name", r"^[^.]*\.", "")
    rows = calls.withColumns({"head": F.when(head == "", F.col("name")).otherwise(head), "member": F.when(head == "", F.lit("")).otherwise(member)})
    rows = rows.join(shadows.select("src", F.col("name").alias("head")).distinct(), ["src", "head"], "left_anti")
    of_this = rows.where("head = 'this' AND member <> '' AND NOT rebound").join(methods.select("file", "scope", F.col("name").alias("member"), F.col("id").alias("dst")), ["file", "scope", "member"]).select("src", "dst")
    own = rows.where("member = ''").join(functions.select("file", F.col("name").alias("head"), F.col("id").alias("dst")), ["file", "head"])
    rest = rows.join(functions.select("file", F.col("name").alias("head")), ["file", "head"], "left_anti").join(imports.select("file", F.col("local").alias("head"), "kind", "origin", "target"), ["file", "head"])
    export = F.when((F.col("kind") == "named") & (F.col("member") == ""), F.col("origin")).when((F.col("kind") == "default") & (F.col("member") == ""), "default").when((F.col("kind") == "namespace") & (F.col("member") != ""), F.col("member"))
    there = rest.select("src", F.col("target").alias("file"), export.alias("export")).where("export IS NOT NULL").join(exports, ["file", "export"]).join(functions.select("file", "name", F.col("id").alias("dst")), ["file", "name"])
    return of_this.unionByName(own.select("src", "dst")).unionByName(there.select("src", "dst")).distinct()


def script_types(refs: DataFrame, imports: DataFrame, kinds: DataFrame) -> DataFrame:
    """refs (src, file, name, kind) with dst: kind is class or interface where the syntax says so, else null: then only the file's own definitions count.

    imports (file, local, origin, target); kinds (file, name, kind).
    """
    name = F.trim(F.regexp_replace(F.regexp_replace("name", r"^\s*:", ""), r"(?<=.)[<\[|&].*$", ""))
    rows = refs.withColumn("local", name).join(imports.select("file", "local", "origin", "target"), ["file", "local"], "left").join(kinds.select("file", F.col("name").alias("local"), F.col("kind").alias("own_kind")), ["file", "local"], "left")
    entity = lambda k, f, n: F.concat(k, F.lit(":"), f, F.lit("#"), n)
    by_syntax = F.when(F.col("target").isNotNull(), entity(F.col("kind"), F.col("target"), F.col("origin"))).when(F.col("origin").isNotNull(), F.concat(F.lit("external:"), "local")).otherwise(entity(F.col("kind"), F.col("file"), F.col("local")))
    by_file = entity(F.coalesce("own_kind", F.lit("type")), F.col("file"), F.col("local"))
    dst = F.when(F.col("local").isin(*BUILTINS["typescript"]), F.concat(F.lit("builtin:"), "local")).when(F.col("local").contains("."), F.concat(F.lit("external:"), "local")).when(F.col("kind").isNotNull(), by_syntax).otherwise(by_file)
    return rows.withColumn("dst", dst).select(*refs.columns, "dst")


def c_calls(calls: DataFrame, definitions: DataFrame, files: DataFrame, shadows: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, name) to the only file that defines a function; headers define nothing if the corpus has any C++ source.

    definitions (name, file, line, id); calls through a pointer, a member or a local value (shadows) call nothing.
    """
    cpp = files.where(F.col("file").rlike(r"\.(cpp|cc|cxx|hpp|hh|hxx)$")).limit(1).select(F.lit(True).alias("cpp"))
    usable = definitions.join(cpp, how="left", on=F.col("file").endswith(".h")).where("cpp IS NULL").drop("cpp")
    return resolve_calls(calls.where(F.col("name").rlike(r"^\w+$")), usable, shadows)


def cpp_bases(classes: DataFrame) -> DataFrame:
    """(src, dst) of classes (id, name, kind, bases): a base is known by its name without namespaces and arguments, if exactly one class or struct has it and it isn't itself."""
    index = classes.where(F.col("kind").isin("class", "struct")).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("dst")).where("n = 1")
    base = F.trim(F.regexp_replace(F.regexp_replace("base", "<.*$", ""), "^.*::", ""))
    asked = classes.select(F.col("id").alias("src"), F.explode("bases").alias("base")).select("src", base.alias("name"))
    return asked.join(index.drop("n"), "name").where("src <> dst").select("src", "dst").distinct()


def component_refs(tags: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) of a component's template tags (src, file, tag): capitalised tags are components, of the file that their import names."""
    return tags.where(F.col("tag").rlike("^[A-Z]")).join(imports.where("target IS NOT NULL").select("file", F.col("local").alias("tag"), "target"), ["file", "tag"]).select("src", F.concat(F.lit("component:"), "target").alias("dst")).distinct()
