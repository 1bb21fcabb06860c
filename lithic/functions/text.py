"""Small text functions of parsing, splitting and ranking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section_anchor(heading: Column) -> Column:
    """The fragment by which a heading is addressed; characters beyond ASCII stay."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[ _]", "-"), r"[\x00-\x7F&&[^a-z0-9-]]", "")
    return F.regexp_replace(kept, "^-+|-+$", "")


def passage_title(parent: Column, path: Column, ordinal: Column) -> Column:
    """Parent and heading path; headings that repeat the parent's title at the front are left out."""
    same = F.transform(path, lambda h: F.lower(F.trim(h)) == F.lower(F.trim(parent)))
    lead = F.coalesce(F.array_position(same, False).cast("int"), F.lit(0))
    tail = F.when(lead == 0, F.array().cast("array<string>")).otherwise(F.slice(path, F.greatest(lead, F.lit(1)), F.size(path)))
    bare = F.when(F.size(path) > 0, parent).otherwise(F.concat(parent, F.lit(" § passage "), (ordinal + 1).cast("string")))
    return F.when(F.size(tail) > 0, F.concat(parent, F.lit(" § "), F.array_join(tail, " § "))).otherwise(bare)


def clean_comment(block: Column) -> Column:
    """The text of a documentation comment: its marks and each line's star removed, blank lines at both ends left out."""
    inner = F.regexp_replace(F.regexp_replace(F.btrim(block, F.lit(" \t\r\n")), r"^/\*\*", ""), r"\*/$", "")
    lines = F.transform(F.split(inner, "\n"), lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, r"^[ \t]*\*?", ""), "^ ", ""), F.lit(" \t")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", "")


def with_metadata(comment: Column, metadata: Column) -> Column:
    """A comment and what else is known of a symbol, a blank line between them."""
    parts = F.array(F.btrim(comment, F.lit(" \t\r\n")), F.btrim(metadata, F.lit(" \t\r\n")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def is_test_path(path: Column) -> Column:
    base, parts = F.element_at(F.split(path, "/"), -1), F.split(path, "/")
    return (base.endswith("_test.go") | base.contains(".test.") | base.contains(".spec.") | (base.endswith(".py") & (base.startswith("test_") | base.endswith("_test.py"))) | base.endswith("Test.java")
            | F.array_contains(parts, "__tests__") | (path.contains("src/test/") & base.endswith(".java")) | (base.endswith(".py") & F.array_contains(parts, "tests")))


def visibility(name: Column) -> Column:
    """public where the first letter is upper case."""
    first = F.substring(name, 1, 1)
    return F.when((first != F.lower(first)) & (first == F.upper(first)), "public").otherwise("private")


def byte_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


# Fixed values of the guard against generated assets.
MINIFIED_NAMES = (".min.js", "-min.js", ".min.css", "-min.css")
PROBE_BYTES, PROBE_LEAST, BYTES_A_LINE = 64 * 1024, 4 * 1024, 512


def minified(path: Column, text: Column) -> Column:
    """By the end of its name in any case, or by its shape: 4 KiB and more with over 512 whole bytes a line in the first 64 KiB."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    named = F.lit(False)
    for end in MINIFIED_NAMES:
        named = named | name.endswith(end)
    # One character a byte, so that the probe ends at a byte and not at a character.
    probe = F.decode(F.substring(F.encode(text, "UTF-8"), 1, PROBE_BYTES), "ISO-8859-1")
    return named | ((F.octet_length(text) >= PROBE_LEAST) & (F.floor(F.length(probe) / byte_lines(probe)) > BYTES_A_LINE))


def natural_key(v: Column) -> Column:
    """Orders versions with digit runs by value, digits before text, a prefix before what it begins."""
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    run = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(r)).cast("string"), 4, "0"), digits(r))).otherwise(F.concat(F.lit("1"), r, F.lit("\x01")))
    return F.array_join(F.transform(F.regexp_extract_all(v, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), run), "")


_SEMVER = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def is_semver(v: Column) -> Column:
    return v.rlike(_SEMVER)


def semver_key(v: Column) -> Column:
    """Orders lenient semantic versions; a prerelease is before its release, build metadata doesn't count."""
    number = lambda i: F.lpad(F.when(F.regexp_extract(v, _SEMVER, i) == "", "0").otherwise(F.regexp_extract(v, _SEMVER, i)), 12, "0")
    pre = F.regexp_extract(v, _SEMVER, 4)
    part = lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 12, "0"))).otherwise(F.concat(F.lit("1"), p, F.lit("\x01")))
    return F.concat(number(1), number(2), number(3), F.when(pre == "", "~").otherwise(F.array_join(F.transform(F.split(pre, r"\."), part), "")))


def version_key(v: Column) -> Column:
    """One total order: semantic versions first, then natural order."""
    return F.when(is_semver(v), F.concat(F.lit("0"), semver_key(v))).otherwise(F.concat(F.lit("1"), natural_key(v)))
