"""Deterministic identity as pure column expressions.

An entity id is org.platform.domain.system.type.instance; everything here is ASCII by contract, so bytes are characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the id contract.
MAX_ID = 256
MAX_SYSTEM = 80
MAX_INSTANCE = 60
MAX_ORG = 64
PLATFORM = "corpus"

_EDGES = "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"
_TAIL = "[^A-Za-z0-9]+$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once: expressions that name it often stay small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sha_prefix(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def short_hash(c: Column) -> Column:
    """First eight hex digits of the sha256."""
    return sha_prefix(c, 8)


def file_hash(c: Column) -> Column:
    """First sixteen hex digits of the sha256 (code files)."""
    return sha_prefix(c, 16)


def _dashed(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "-")


def _collapsed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_dashed(c), "-{2,}", "-"), _EDGES, "")


def system_slug(path: Column) -> Column:
    """A source path or URL as one id segment of at most 80 characters."""
    host = F.regexp_replace(F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), "^.*@", "")
    below = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    flat = F.when(host != "", F.concat(host, F.coalesce(F.try_url_decode(below), below))).otherwise(path)
    flat = F.regexp_replace(F.regexp_replace(flat, r"\.git$", ""), r"^\./", "")
    base = F.regexp_extract(F.regexp_replace(flat, "/+$", ""), "([^/]*)$", 1)
    whole = F.when(flat.startswith("/"), base).otherwise(flat)
    return let(_collapsed(whole), lambda slug: F.when(F.length(slug) > MAX_SYSTEM, F.concat(F.substring(slug, 1, MAX_SYSTEM - 7), F.lit("-"), sha_prefix(slug, 6))).otherwise(slug))


def scoped_slug(system: Column, scope: Column) -> Column:
    """A system slug narrowed to a branch or a version; unchanged by an empty scope."""
    return F.when(scope == "", system).otherwise(system_slug(F.concat(system, F.lit("-"), scope)))


def versioned_system(project: Column, version: Column) -> Column:
    return scoped_slug(system_slug(project), system_slug(version))


# What decides an instance: after the leading junk, as many letters, digits, underscores and whole runs of all else as fit, and the
# next letter or digit if there is one, however far. Possessive: nothing is tried twice.
_DECIDES = f"^[^A-Za-z0-9]*+((?:[A-Za-z0-9_]|[^A-Za-z0-9_]++){{0,{MAX_INSTANCE}}}+(?:[^A-Za-z0-9]*+[A-Za-z0-9])?)"


def sanitize_instance(s: Column) -> Column:
    """At most 60 characters, dashes collapsed, case kept; what has none left is its hash.

    Of a long text only what decides is rewritten; its hash is of all of it.
    """
    kept = lambda out: F.regexp_replace(F.substring(out, 1, MAX_INSTANCE - 9), _TAIL, "")
    return let(_collapsed(F.regexp_extract(s, _DECIDES, 1)), lambda out: F.when(out == "", short_hash(s)).when(F.length(out) > MAX_INSTANCE, F.concat(kept(out), F.lit("-"), short_hash(s))).otherwise(out))


def sanitize_segment(s: Column) -> Column:
    """One legal segment without loss: what had to change carries the hash of the original."""
    stripped = F.regexp_replace(_dashed(s), "^[^A-Za-z0-9]+", "")
    return let(stripped, lambda out: F.when(out == "", short_hash(s)).when(out == s, out).otherwise(F.concat(out, F.lit("-"), short_hash(s))))


def sanitize_path(path: Column) -> Column:
    return sanitize_segment(F.regexp_replace(F.regexp_replace(path, "[/.]", "-"), "^-", ""))


def scoped_instance(path: Column, scopes: Column, name: Column, kind: Column) -> Column:
    """Path, enclosing scopes and name joined by dashes; files and packages have no name part."""
    named = (name != "") & ~kind.isin("file", "package")
    return F.array_join(F.concat(F.array(sanitize_path(path)), F.transform(scopes, sanitize_path), F.when(named, F.array(sanitize_segment(name))).otherwise(F.array().cast("array<string>"))), "-")


def build(org: Column, domain: Column, system: Column, kind: Column, instance: Column, platform: Column | None = None) -> Column:
    """The six-part id; over 256 bytes the instance is shortened and carries its hash."""
    head = F.concat_ws(".", org, platform if platform is not None else F.lit(PLATFORM), domain, system, kind)
    room = F.lit(MAX_ID - 1) - F.length(head)
    kept = F.regexp_replace(instance.substr(F.lit(1), F.greatest(room - 9, F.lit(0))), _TAIL, "")
    short = F.when((room < 10) | (kept == ""), short_hash(instance)).otherwise(F.concat(kept, F.lit("-"), short_hash(instance)))
    return F.concat(head, F.lit("."), F.when(F.length(head) + 1 + F.length(instance) <= MAX_ID, instance).otherwise(short))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, fragment, query and trailing slashes dropped (the identity of sources)."""
    at = F.instr(url, "://")
    scheme = F.lower(url.substr(F.lit(1), at - 1))
    rest = F.regexp_replace(F.regexp_replace(url.substr(at + 3, F.length(url)), r"(?s)#.*$", ""), r"(?s)\?.*$", "")
    host, path = F.lower(F.regexp_extract(rest, "^([^/]*)", 1)), F.regexp_replace(F.regexp_extract(rest, "(?s)^[^/]*(.*)$", 1), "/+$", "")
    return F.when(at == 0, F.regexp_replace(url, "/+$", "")).otherwise(F.concat(scheme, F.lit("://"), host, path))


def page_url(url: Column) -> Column:
    """The other canonical form, of pages: keeps the query, drops the fragment, and an empty path becomes a slash."""
    scheme = F.lower(F.regexp_extract(url, "^([^:/?#]+)://", 1))
    host = F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)


def host_name(url: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1), "^.*@", ""), ":[0-9]*$", "")


def page_system(url: Column) -> Column:
    host = F.replace(F.lower(host_name(url)), F.lit("."), F.lit("-"))
    return F.when(host == "", "unknown").otherwise(host)


def page_instance(url: Column) -> Column:
    return short_hash(page_url(url))


def legacy_page_slug(url: Column) -> Column:
    """The older page slug: host and path, lower case, at most 80 characters."""
    path = F.regexp_replace(F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    slug = F.lower(F.concat(F.replace(host_name(url), F.lit("."), F.lit("-")), F.when(path != "", F.concat(F.lit("-"), path)).otherwise("")))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(slug, "[^a-z0-9-]", "-"), "-{2,}", "-"), "^-+|-+$", "")
    return F.when(F.length(slug) > 80, F.regexp_replace(F.substring(slug, 1, 80), "-+$", "")).otherwise(slug)


def slugify(s: Column) -> Column:
    """Lower-case letters, digits and single dashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9-]", "-"), "-{2,}", "-"), "^-+|-+$", "")


def repo_slug(path: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.when(name == "", "unknown").otherwise(F.replace(name, F.lit("."), F.lit("-")))


def git_url_slug(url: Column) -> Column:
    """A clone URL, shorthand included, as a slug."""
    plain = F.when(url.startswith("git@"), F.regexp_replace(F.regexp_replace(url, "^git@", ""), "^([^:]*):", "$1/")).otherwise(url)
    return slugify(F.regexp_replace(F.regexp_replace(plain, r"\.git$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?", ""))


def valid_key(id_: Column) -> Column:
    """Printable ASCII without blank, star, slash, greater-than or backslash."""
    return id_.rlike(r"^[\x21-\x7E]+$") & ~id_.rlike(r"[ */>\\]")


def valid_id(id_: Column) -> Column:
    """Six segments that begin with a letter or digit, 256 bytes at most."""
    return id_.rlike(r"^([A-Za-z0-9][A-Za-z0-9_-]*\.){5}[A-Za-z0-9][A-Za-z0-9_-]*$") & (F.octet_length(id_) <= MAX_ID)


def valid_namespace(org: Column) -> Column:
    return org.rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$") & (F.octet_length(org) <= MAX_ORG)


def org_of(id_: Column) -> Column:
    return F.when(F.instr(id_, ".") > 0, F.substring_index(id_, ".", 1)).otherwise("")


def part(id_: Column, n: int) -> Column:
    """The n-th of six parts, counted from 1; empty for an id of fewer."""
    parts = F.split(id_, r"\.", 6)
    return F.when(F.size(parts) >= 6, parts[n - 1]).otherwise("")


def resolve_org(override: Column, default: Column) -> Column:
    return F.when(override == "public", "public").otherwise(default)


def media_instance(content: Column) -> Column:
    return sha_prefix(content, 6)


def short_sha(sha: Column) -> Column:
    """Seven characters of a commit; a shorter one as it is."""
    return F.substring(sha, 1, 7)


def keyframe_instance(content: Column, timestamp: Column) -> Column:
    return F.concat(media_instance(content), F.lit("-"), timestamp)


def blob_instance(content: Column) -> Column:
    return sha_prefix(content, 12)


def is_public(org: Column) -> Column:
    """The namespace that all may read."""
    return org == "public"


def overload_instance(path: Column, scopes: Column, name: Column, kind: Column, parameters: Column) -> Column:
    """A C++ callable's instance: its parameter list, blanks collapsed, tells overloads apart; one without a list has none."""
    plain = F.btrim(F.regexp_replace(parameters, r"\s+", " "))
    return F.concat(scoped_instance(path, scopes, name, kind), F.when(parameters.isNull(), "").otherwise(F.concat(F.lit("-"), sha_prefix(plain, 6))))


def document_id(org: Column, system: Column, path: Column) -> Column:
    return build(org, F.lit("web"), system, F.lit("doc"), sanitize_instance(path))


def chunk_instance(path: Column, ordinal: Column) -> Column:
    return F.concat(sanitize_instance(path), F.lit("-"), F.lpad(ordinal.cast("string"), 4, "0"))


def safe_url(url: Column) -> Column:
    """https, and neither a local name nor a private, loopback, link-local or shared IPv4 or IPv6 address."""
    authority = F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), r"^\[|\]$", "")
    v4 = F.regexp_replace(host, "^::ffff:", "")
    private = v4.rlike(r"^(10|127)(\.[0-9]{1,3}){3}$|^192\.168(\.[0-9]{1,3}){2}$|^169\.254(\.[0-9]{1,3}){2}$|^172\.(1[6-9]|2[0-9]|3[01])(\.[0-9]{1,3}){2}$|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])(\.[0-9]{1,3}){2}$|^224\.0\.0\.[0-9]{1,3}$")
    v6 = host.contains(":") & host.rlike("^(::1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff02:)")
    return url.startswith("https://") & (host != "localhost") & ~host.endswith(".local") & ~host.endswith(".internal") & ~private & ~v6
