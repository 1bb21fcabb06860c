"""The source plane: which files, branches, submodules and sources there are, and what has changed about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import ids

# Fixed values of the scans.
FLOOR = ("node_modules", ".git")
DOC_TYPES = {".adoc": "text/asciidoc", ".md": "text/markdown", ".mdx": "text/markdown", ".txt": "text/plain"}
ROOT_DOC_EXCLUDES = ("openspec",)
SOURCE_TYPES = ("git", "repo", "ast", "docs", "config", "url", "image", "video", "audio")
GIT_PROTOCOLS = ("https", "git", "ssh")
MOST_BRANCHES, MOST_DEPTH = 10, 10


# ---- files ----------------------------------------------------------------------------------------------------------

def extension(path: Column) -> Column:
    """The last dot and what follows it in the base name, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def scanned(path: Column, excludes: list[str]) -> Column:
    """No folder on the way is of the floor, hidden, or excluded; excludes add to the floor."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda f: f.isin(*FLOOR, *excludes) | ((F.length(f) > 1) & f.startswith(".")))


def boundaries(paths: DataFrame, path: str) -> DataFrame:
    """(boundary): the folders below the root that hold a .git entry."""
    return paths.select(F.regexp_extract(path, r"^/?(.+)/\.git(?:/.*)?$", 1).alias("boundary")).where("boundary <> ''").distinct()


def outside_boundaries(paths: DataFrame, path: str, found: DataFrame) -> DataFrame:
    """The paths that lie in no boundary folder: each ancestor meets the boundaries in an equi join."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = paths.select(F.col(path).alias("inside"), F.explode(F.when(F.size(parts) > 1, up)).alias("boundary")).join(found, "boundary", "left_semi").select("inside").distinct()
    return paths.join(inside, F.col(path) == F.col("inside"), "left_anti")


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression: * within a segment, ** over any number of them, ? one character."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}\[\]|\\])", r"\\$1")
    deep = F.regexp_replace(F.regexp_replace(quoted, r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    flat = F.regexp_replace(F.regexp_replace(deep, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(flat, "\u0001", "(?:.*/)?"), "\u0002", ".*"), F.lit("$"))


def glob_folders(folders: DataFrame, globs: DataFrame) -> DataFrame:
    """(folder) of (folder) that any of (glob) names, each once. Globs are a configuration's few, and are broadcast."""
    return folders.join(F.broadcast(globs.select(glob_pattern(F.col("glob")).alias("p"))), F.expr("folder rlike p"), "left_semi").distinct()


def documents(files: DataFrame) -> DataFrame:
    """(file, text, mime, adoc, title, hash) of the documents of (file, text); files that couldn't be read (null) are passed over.

    The title is the first line that begins with the format's heading mark, wherever it stands, else the file's stem.
    """
    kind, base = extension(F.col("file")), F.element_at(F.split("file", "/"), -1)
    mime = F.lit("application/octet-stream")
    for end, m in DOC_TYPES.items():
        mime = F.when(kind == end, m).otherwise(mime)
    kept = files.where(F.col("text").isNotNull() & kind.isin(*DOC_TYPES) & scanned(F.col("file"), []) & ~F.element_at(F.split("file", "/"), 1).isin(*ROOT_DOC_EXCLUDES))
    return kept.select("file", "text", mime.alias("mime"), (kind == ".adoc").alias("adoc"), title(F.col("text"), base, kind == ".adoc").alias("title"), F.sha2("text", 256).alias("hash"))


def title(text: Column, base: Column, adoc: Column) -> Column:
    heading = lambda mark: F.regexp_extract(text, rf"(?m)^{mark} (.*)$", 1)
    has = F.when(adoc, text.rlike("(?m)^= ")).otherwise(text.rlike("(?m)^# "))
    return F.when(has, F.btrim(F.when(adoc, heading("=")).otherwise(heading("#")), F.lit(" \t\r"))).otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))


# ---- repositories ---------------------------------------------------------------------------------------------------

def expand_repositories(sources: DataFrame, workspace: str) -> DataFrame:
    """(kind, url, path, branch, project, version) of (kind, url, path, branch, project, version): a repo becomes git, ast, docs and config.

    The git part keeps the stated path; the others get the clone's folder where none is stated. A repo without url and path
    is no source and falls away; other kinds pass as they are.
    """
    url, path = F.coalesce("url", F.lit("")), F.coalesce("path", F.lit(""))
    local = F.when(path != "", path).otherwise(F.concat(F.lit(workspace.rstrip("/") + "/"), ids.git_url_slug(url)))
    nothing = F.lit("")
    of = lambda kind, u, p, b, pr, v: F.struct(F.lit(kind).alias("kind"), u.alias("url"), p.alias("path"), b.alias("branch"), pr.alias("project"), v.alias("version"))
    text = lambda c: F.coalesce(F.col(c), nothing)
    parts = F.array(of("git", url, path, text("branch"), nothing, nothing), of("ast", nothing, local, nothing, text("project"), text("version")), of("docs", nothing, local, nothing, nothing, nothing), of("config", nothing, local, nothing, nothing, nothing))
    own = F.array(F.struct(F.col("kind"), url.alias("url"), path.alias("path"), text("branch").alias("branch"), text("project").alias("project"), text("version").alias("version")))
    return sources.where((F.col("kind") != "repo") | (url != "") | (path != "")).select(F.inline(F.when(F.col("kind") == "repo", parts).otherwise(own)))


def branch_changes(branches: DataFrame, patterns: DataFrame, known: DataFrame, most: int = MOST_BRANCHES) -> DataFrame:
    """(branch, slug, change): matching branches that aren't known are added while there is room, in order of name; known ones that no longer match or exist are removed.

    Room is what the known branches leave: removals of the same pass make none. Branches of one repository are few.
    """
    match = branches.join(F.broadcast(patterns.select(glob_pattern(F.col("pattern")).alias("p"))), F.expr("branch rlike p"), "left_semi").select("branch").distinct()
    room = max(0, most - known.count())
    added = match.join(known, "branch", "left_anti").orderBy("branch").limit(room)
    gone = known.select("branch").join(match, "branch", "left_anti")
    row = lambda df, change: df.select("branch", ids.slugify(F.col("branch")).alias("slug"), F.lit(change).alias("change"))
    return row(added, "added").unionByName(row(gone, "removed"))


def submodule_url(base: Column, raw: Column) -> Column:
    """A relative submodule URL beside its parent's; others, and those of a parent without a path, as they are."""
    scheme = F.regexp_extract(base, "^([^:/]+://[^/]*)/", 1)
    scp = F.regexp_extract(base, "^(git@[^:]*:)", 1)
    head = F.when(base.contains("://"), scheme).when(scp != "", scp).otherwise("")
    start = F.substring(base, F.length(head) + 1, F.length(base))
    parts = F.filter(F.concat(F.split(start, "/"), F.split(raw, "/")), lambda p: (p != "") & (p != "."))
    rooted = start.startswith("/")
    # What goes above a root stays at it; without a root it stays written out.
    walked = F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p)))
                         .when((F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(rooted, a).otherwise(F.concat(a, F.array(p))))
    joined = F.concat(head, F.when(rooted, "/").otherwise(""), F.array_join(walked, "/"))
    relative = raw.startswith("./") | raw.startswith("../")
    return F.when(~relative | (base == "") | (base.contains("://") & (scheme == "")), raw).otherwise(joined)


def submodules(declared: DataFrame, links: DataFrame, present: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(path, url, resolved, sha, materialized, depth, beyond): the submodules of a repository and of its present submodules.

    declared (repo, path, url) and links (repo, path, sha) name a repository by its path from the root, '' the root itself,
    whose row in declared has a null path and its own URL; present (path) lists the folders that have content. What lies
    deeper than most_depth is listed, with beyond true, and not entered.
    """
    root = declared.where("path IS NULL").select(F.col("repo"), F.coalesce("url", F.lit("")).alias("base"))
    own = declared.where("path IS NOT NULL")
    out, level = None, root
    for depth in range(1, most_depth + 2):
        rows = level.join(own, "repo").join(links, ["repo", "path"], "left")
        whole = F.when(F.col("repo") == "", F.col("path")).otherwise(F.concat_ws("/", "repo", "path"))
        rows = rows.select(whole.alias("path"), "url", submodule_url(F.col("base"), F.col("url")).alias("resolved"), "sha")
        rows = rows.join(present.select("path", F.lit(True).alias("materialized")).distinct(), "path", "left").withColumns({"materialized": F.coalesce("materialized", F.lit(False)), "depth": F.lit(depth), "beyond": F.lit(depth > most_depth)})
        out = rows if out is None else out.unionByName(rows)
        level = rows.where("materialized").select(F.col("path").alias("repo"), F.col("resolved").alias("base"))
    return out


def reconcile_submodules(desired: DataFrame, tracked: DataFrame, least_sha: int = 7) -> DataFrame:
    """(path, action): add, move (spawn the new commit, then remove the old), remove, or confirm what is tracked at the same commit and not confirmed yet."""
    want = desired.where(F.col("materialized") & (F.length("sha") >= least_sha)).select("path", F.col("sha").alias("new"))
    both = want.join(tracked.select("path", F.col("sha").alias("old"), "confirmed"), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("new") != F.col("old"), "move").when(~F.col("confirmed"), "confirm")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def instance_name(kind: Column, path: Column, url: Column, branch: Column) -> Column:
    """The deterministic name of a source's component."""
    slug = ids.scoped_slug(ids.system_slug(F.when(path != "", path).otherwise(url)), branch)
    return F.concat(kind, F.lit("-source-"), slug)


def spawn(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """(instance, kind, created): idempotent adds of (instance, kind): created is false for one that is registered already."""
    held = registry.select("instance", F.lit(True).alias("held")).distinct()
    return asked.select("instance", "kind").distinct().join(held, "instance", "left").select("instance", "kind", F.col("held").isNull().alias("created"))


def unspawn(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """(instance, result): removed, NOT_FOUND, or VALIDATION_FAILED for an empty name."""
    held = registry.select("instance", F.lit(True).alias("held")).distinct()
    return asked.join(held, "instance", "left").select("instance", F.when(F.coalesce("instance", F.lit("")) == "", "VALIDATION_FAILED").when(F.col("held"), "removed").otherwise("NOT_FOUND").alias("result"))


# ---- validation -----------------------------------------------------------------------------------------------------

def git_url_allowed(url: Column) -> Column:
    return url.startswith("git@") | F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*GIT_PROTOCOLS)


def clean_path(path: Column) -> Column:
    """An absolute path without empty, . and .. segments."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def path_allowed(path: Column, roots: list[str]) -> Column:
    """A path is one of the roots or lies under one, once it is cleaned; a source without a path needs none (null: allowed)."""
    out = path.isNull()
    for root in roots:
        out = out | (clean_path(path) == root.rstrip("/")) | clean_path(path).startswith(root.rstrip("/") + "/")
    return out


def key_contained(key: Column) -> Column:
    """A store key that can't leave its folder: not empty, and without a segment of two dots."""
    return (key != "") & ~F.array_contains(F.split(key, "/"), "..") & (clean_path(key) != "/")


def _positive(duration: Column) -> Column:
    """Null or empty, or a Go-like duration above zero: numbers with units, one after the other."""
    whole = duration.rlike(r"^\+?([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h)(([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h))*$")
    return (F.coalesce(duration, F.lit("")) == "") | (whole & duration.rlike("[1-9]"))


def source_problem(s: str = "s") -> Column:
    """Why a source (kind, url, path, paths, urls, branch, branches, language, languages, extensions, poll, index, keyframes, scene) isn't valid, or null."""
    c = lambda n: F.col(f"{s}.{n}")
    empty = lambda n: F.coalesce(c(n), F.lit("")) == ""
    none = lambda n: F.coalesce(F.size(c(n)), F.lit(0)) <= 0
    k = c("kind")
    languages = k.isin("repo", "ast") & ~none("languages")
    return (F.when(~k.isin(*SOURCE_TYPES), "unknown type").when(~_positive(c("poll")), "poll interval").when(~_positive(c("index")), "index interval")
            .when(k.isin("git", "repo") & empty("url") & empty("path"), "url or path").when((k == "repo") & ~none("branches") & ~empty("branch"), "branch and branches")
            .when((k == "ast") & empty("path"), "path").when(k.isin("docs", "config", "image", "video", "audio") & none("paths"), "paths").when((k == "url") & none("urls"), "urls")
            .when(languages & F.array_contains(c("languages"), ""), "empty language").when(languages & ~empty("language") & ~F.array_contains(c("languages"), c("language")), "language not in languages")
            .when((k == "image") & ~none("extensions") & F.array_contains(c("extensions"), ""), "empty extension")
            .when((k == "video") & ~empty("keyframes") & ~c("keyframes").isin("interval", "scene", "iframes"), "keyframe mode")
            .when((k == "video") & (F.isnan(c("scene")) | (c("scene") < 0) | (c("scene") > 1)), "scene threshold"))
