"""Symbols of languages with braces (Go, Java, TypeScript and JavaScript, C, C++), with scopes, lines, types and calls.

A file's comments and texts are blanked out first, so that only structure is left; then one pass over its brackets,
semicolons and (in Go) line ends cuts it into statements. A statement before an opening brace is the head of a type, a
callable or a plain block; one that ends without a brace is a field, a constant or a prototype. What a language's heads
look like is a table of patterns; all else is shared. Files are parsed where they are read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TEXTS = pa.list_(pa.string())
FIELDS = [("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("scope", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("signature", pa.string()), ("receiver", pa.string()),
          ("params", TEXTS), ("returns", TEXTS), ("bases", TEXTS), ("implements", TEXTS), ("embeds", TEXTS), ("modifiers", TEXTS), ("doc", pa.string()), ("calls", TEXTS)]
SCHEMA = pa.schema(FIELDS)
_ORDERED = SCHEMA.append(pa.field("place", pa.int64()))
#: Symbols of one batch, and of those that are held as Python objects.
MOST_ROWS = 4096
COLUMNS = ", ".join(f"{'`end`' if n == 'end' else n} {'array<string>' if t == TEXTS else 'bigint' if t == pa.int64() else 'string'}" for n, t in FIELDS)

_NAME = r"[A-Za-z_$][\w$]*"
_HIDDEN = re.compile(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_BLOCK_WORDS = frozenset("if for while switch catch else do try return new throw synchronized finally sizeof typeof await case default with function super this constructor".split())
_GO_WORDS = frozenset("if for switch select case return go defer func range".split())
_MODIFIERS = frozenset("public protected private abstract final static sealed native synchronized transient volatile strictfp default export declare async readonly override const inline extern virtual explicit constexpr friend typename".split())


class Head(NamedTuple):
    """A pattern of a statement's head: what it declares, and whether a brace must follow (None: either)."""

    pattern: re.Pattern
    kind: str
    braced: bool | None = None


def _heads(*rows: tuple) -> list[Head]:
    return [Head(re.compile(p, re.S), *rest) for p, *rest in rows]


_GENERIC = r"(?:\s*<[^{;]*?>)?"
HEADS = {
    "golang": _heads(
        (rf"^func\s*\(\s*(?:(?:{_NAME}|_)\s+)?(?P<receiver>\*?\s*{_NAME})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_NAME})\s*\((?P<params>.*)$", "method", True),
        (rf"^func\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s*\((?P<params>.*)$", "function", True),
        (rf"^type\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+struct\s*$", "struct", True), (rf"^type\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+interface\s*$", "interface", True),
        (rf"^type\s+(?P<name>{_NAME})\b(?!.*\b(?:struct|interface)\s*$)", "type", None), (rf"^const\s+(?P<name>{_NAME}(?:\s*,\s*{_NAME})*)", "const", None), (rf"^var\s+(?P<name>{_NAME}(?:\s*,\s*{_NAME})*)", "var", None)),
    "java": _heads(
        (rf"(?:^|\s)(?:class)\s+(?P<name>{_NAME}){_GENERIC}(?P<after>.*)$", "class", True), (rf"(?:^|\s)@?interface\s+(?P<name>{_NAME}){_GENERIC}(?P<after>.*)$", "interface", True),
        (rf"(?:^|\s)enum\s+(?P<name>{_NAME})(?P<after>.*)$", "enum", True), (rf"(?:^|\s)record\s+(?P<name>{_NAME}){_GENERIC}\s*\((?P<params>.*?)\)(?P<after>.*)$", "class", True),
        (rf"^(?P<returns>(?:{_NAME}|[\w.$]+)(?:<.*>)?(?:\[\])*)\s+(?P<name>{_NAME})\s*\((?P<params>.*)\)", "method", None), (rf"^(?P<name>{_NAME})\s*\((?P<params>.*)\)", "method", True),
        (rf"^(?P<returns>[\w.$]+(?:<.*?>)?(?:\[\])*)\s+(?P<name>{_NAME})\s*(?:=|$)", "var", False)),
    "typescript": _heads(
        (rf"(?:^|\s)class\s+(?P<name>{_NAME}){_GENERIC}(?P<after>.*)$", "class", True), (rf"^interface\s+(?P<name>{_NAME}){_GENERIC}(?P<after>.*)$", "interface", True), (rf"^enum\s+(?P<name>{_NAME})", "enum", True),
        (rf"^type\s+(?P<name>{_NAME}){_GENERIC}\s*=", "type", None), (rf"^function\s*\*?\s*(?P<name>{_NAME}){_GENERIC}\s*\((?P<params>.*)$", "function", True),
        (rf"^(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=]*)?=\s*(?:async\s*)?(?:{_GENERIC}\s*\((?P<params>.*)\)[^=]*|{_NAME}\s*)=>\s*$", "function", True),
        (rf"^(?:const|let|var)\s+[\[{{]?\s*(?P<name>{_NAME}(?:\s*,\s*{_NAME})*)", "var", None), (rf"^(?:get\s+|set\s+|\*\s*)?(?P<name>#?{_NAME}){_GENERIC}\s*\((?P<params>.*)$", "method", True)),
    "c": _heads(
        (rf"^(?:typedef\s+)?(?:struct|union)\s+(?P<name>{_NAME})\s*$", "struct", True), (rf"^(?:typedef\s+)?enum\s+(?P<name>{_NAME})\s*$", "enum", True), (rf"^typedef\b.*\(\s*\*\s*(?P<name>{_NAME})\s*\)\s*\(.*\)\s*$", "type", False), (rf"^typedef\b.*?(?P<name>{_NAME})\s*$", "type", False),
        (rf"^(?P<returns>[\w\s*]+?[\s*])(?P<name>{_NAME})\s*\((?P<params>.*)\)\s*$", "function", None), (rf"^(?P<returns>[\w\s*]+?[\s*])(?P<name>{_NAME})\s*(?:\[.*\])?\s*(?:=|$)", "var", False)),
    "cpp": _heads(
        (rf"^(?:inline\s+)?namespace\s+(?P<name>[\w:]+)\s*$", "type", True), (rf"^(?:template\s*<.*?>\s*)?class\s+(?P<name>{_NAME})\b(?P<after>[^;(]*)$", "class", True), (rf"^(?:typedef\s+)?(?:template\s*<.*?>\s*)?(?:struct|union)\s+(?P<name>{_NAME})\b(?P<after>[^;(]*)$", "struct", True),
        (rf"^enum\s+(?:class\s+|struct\s+)?(?P<name>{_NAME})", "enum", True), (rf"^using\s+(?P<name>{_NAME})\s*=", "type", False), (rf"^typedef\b.*?(?P<name>{_NAME})\s*$", "type", False),
        (rf"^(?:template\s*<.*?>\s*)?(?P<returns>[\w:<>,\s*&]+?[\s*&])(?P<name>(?:{_NAME}::)*~?{_NAME}|operator\S+)\s*\((?P<params>.*?)\)\s*(?:const|noexcept|override|final|\s|=\s*(?:0|default|delete))*$", "function", None),
        (rf"^(?P<name>(?:{_NAME}::)*~?{_NAME})\s*\((?P<params>.*?)\)\s*(?::.*)?$", "function", None), (rf"^(?P<returns>[\w:<>,\s*&]+?[\s*&])(?P<name>{_NAME})\s*(?:\[.*\])?\s*(?:=|$)", "var", False)),
}
HEADS["javascript"] = HEADS["typescript"]
_CONTAINERS = ("class", "interface", "enum", "struct", "type")


class _Open(NamedTuple):
    """A bracket that is open: the symbol whose body it begins (or None), and where that body begins."""

    symbol: dict | None
    at: int
    scope: tuple[str, ...]
    declares: bool  # whether statements in it declare something
    before: int = 0  # where the statement that it stands in begins
    typedef: bool = False


def blanked(text: str) -> tuple[str, array, array]:
    """The text with comments and texts as blanks (line ends stay), and where its comments begin and end."""
    begins, ends = array("q"), array("q")

    def blank(m: re.Match) -> str:
        if m[0][:2] in ("/*", "//"):
            begins.append(m.start())
            ends.append(m.end())
        return re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", "_", m[0][1:-1]) + m[0][-1]

    return _HIDDEN.sub(blank, text), begins, ends


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand in no bracket."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1:i] not in "=-"))
        if c == mark and depth <= 0:
            out.append(text[begin:i])
            begin = i + 1
    return [x.strip() for x in [*out, text[begin:]] if x.strip()]


def _closed(text: str) -> tuple[str, str]:
    """What stands before the bracket that closes an open one, and after it."""
    depth = 1
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return text[:i], text[i + 1:]
    return text, ""


def parameter_types(params: str, language: str) -> list[str]:
    """The types of a parameter list, one for each name."""
    parts = split_top(params)
    if language == "golang":
        named = any(re.match(rf"^{_NAME}\s+\S", p) and not p.startswith(("func", "chan ", "map[")) for p in parts)
        out: list[str] = []
        for p in reversed(parts):  # a, b int: a name without a type has the next one's
            m = re.match(rf"^{_NAME}\s+(.*)$", p, re.S) if named else None
            out.append(m[1].strip() if m else (out[-1] if named and out else p))
        return out[::-1]
    if language in ("typescript", "javascript"):
        return [m[1].strip() if (m := re.match(r"^[^:=]*:\s*([^=]*)", p, re.S)) else "any" for p in parts]
    out = []
    for p in parts:
        p = re.sub(r"@\w+(\([^)]*\))?\s*", "", p.split("=")[0]).strip()
        p = re.sub(r"^final\s+", "", p)
        m = re.match(rf"^(.*[\s*&>.\]])({_NAME})((?:\[[^\]]*\])*)$", p, re.S)
        kind = (m[1] + m[3]).strip() if m and m[1].strip() not in ("const", "struct", "unsigned", "enum") else p
        if kind != "void" or m:
            out.append(re.sub(r"\s+", " ", kind))
    return out


def _returned(after: str, language: str) -> list[str]:
    after = after.strip()
    if language == "golang":
        return parameter_types(_closed(after[1:])[0], language) if after.startswith("(") else [after] if after else []
    m = re.match(r"^:\s*(.*?)\s*(?:=>)?\s*$", after, re.S)
    return [m[1]] if m and m[1] else []


def _calls(body: str, language: str) -> list[str]:
    """Names that are called in a body: plain, or with what stands before their dots."""
    found = re.findall(rf"(?<![\w$.])((?:{_NAME}(?:\s*(?:\.|::|->)\s*))*{_NAME})\s*\(", body)
    words = _GO_WORDS if language == "golang" else _BLOCK_WORDS
    return sorted({re.sub(r"\s+", "", f).replace("->", ".") for f in found if f not in words})


def _after_type(after: str, language: str) -> tuple[list[str], list[str]]:
    """(bases, implemented interfaces) of what follows a type's name."""
    plain = lambda t: [re.sub(r"\s*<.*$", "", x, flags=re.S).strip() for x in split_top(t)]
    if language in ("c", "cpp"):
        return [re.sub(r"^(?:(?:public|protected|private|virtual)\s+)*", "", b).strip() for b in split_top(after.partition(":")[2])], []
    pick = lambda w: plain(m[1]) if (m := re.search(rf"\b{w}\s+(.*?)(?=\b(?:extends|implements|permits)\b|$)", after, re.S)) else []
    return pick("extends"), pick("implements")


def parse(path: str, text: str, language: str) -> list[dict]:
    """The file's own row and a row per symbol, in the order of their places."""
    return [r for batch in parsed(path, text, language) for r in batch.to_pylist()]


def parsed(path: str, text: str, language: str) -> Iterator[pa.RecordBatch]:
    """The rows of parse in batches of MOST_ROWS. Symbols that are complete wait for their order in Arrow's form, at a tenth of a dict's size."""
    code, begins, ends = blanked(text)
    starts = array("q", [0])
    starts.extend(m.end() for m in re.finditer("\n", code))
    line = lambda at: bisect_right(starts, at)
    out: list[dict] = []
    complete: list[pa.RecordBatch] = []

    def ends_on(n: int) -> tuple[int, int] | None:
        """The last comment that ends on a line."""
        i = (bisect_left(ends, starts[n]) if n < len(starts) else len(ends)) - 1
        return (begins[i], ends[i]) if n > 0 and i >= 0 and ends[i] >= starts[n - 1] else None

    def settle(still_open: list[dict]) -> None:
        """All but the file's row and symbols that are open go over into Arrow's form; of equal places the first put comes first."""
        held = {id(r) for r in still_open}
        done = [r for r in out if id(r) not in held]
        if done:
            complete.append(pa.RecordBatch.from_pylist(done, schema=_ORDERED))
        out[:] = [r for r in out if id(r) in held]

    places = count()

    def put(kind: str, name: str, scope: tuple[str, ...], at: int, **more) -> dict:
        row = {n: [] if t == TEXTS else "" for n, t in FIELDS} | {"place": next(places), "file": path, "kind": kind, "name": name, "scope": ".".join(scope), "start": line(at), "end": line(at)} | more
        out.append(row)
        return row

    whole = put("file", path.rsplit("/", 1)[-1], (), 0)
    whole["end"] = text.count("\n") + 1

    def doc_before(at: int) -> str:
        span, parts = ends_on(line(at) - 1), []
        while span and not code[starts[line(span[0]) - 1]:span[0]].strip():
            parts.append(text[span[0]:span[1]])
            if text.startswith("/*", span[0]):
                break
            span = ends_on(line(span[0]) - 1)
        return "\n".join(re.sub(r"^\s*(/\*\*?|\*/|\*|//)\s?|\s*\*/$", "", x).rstrip() for p in reversed(parts) for x in p.split("\n")).strip("\n")

    def declare(head: str, at: int, braced: bool, inside: _Open) -> dict | None:
        words, modifiers, lead = head, [], re.match(r"\s*", head).end()
        while m := re.match(r"(@[\w.]+(?:\([^)]*\))?|[A-Za-z]+)\s+", words[lead:]):
            if m[1][0] != "@" and (m[1] not in _MODIFIERS or (m[1] == "const" and language not in ("java",)) or (m[1] == "default" and language == "java" and not braced)):
                break
            modifiers.append(m[1])
            lead += m.end()
        bare = words[lead:].strip()
        of_type = inside.symbol is not None and inside.symbol["kind"] in _CONTAINERS
        for h in HEADS[language]:
            if h.braced is not None and h.braced != braced:
                continue
            m = h.pattern.search(bare) if h.pattern.pattern.startswith("(?:^") else h.pattern.match(bare)
            if not m or m["name"].split("::")[-1] in _BLOCK_WORDS - {"constructor"}:
                continue
            got = m.groupdict()
            if h.kind == "method" and language in ("typescript", "javascript") and not of_type:
                continue
            if h.kind in ("method", "function", "var") and language in ("java", "c", "cpp") and (got.get("returns") or "x").split()[0] in _BLOCK_WORDS | {"package", "import", "using"}:
                continue
            kind = "method" if h.kind == "function" and language == "cpp" and of_type and inside.symbol["kind"] in ("class", "struct") else h.kind
            if kind == "var" and language == "c" and of_type:
                return None
            if kind == "var" and language == "java" and {"static", "final"} <= set(modifiers):
                kind = "const"
            if kind == "var" and bare.startswith("const") and language in ("typescript", "javascript"):
                kind = "const"
            params, returns = got.get("params"), got.get("returns")
            if params is not None and language in ("golang", "typescript", "javascript"):
                params, rest = _closed(params)
                returned = _returned(rest, language)
            else:
                returned = [re.sub(r"\s+", " ", returns).strip()] if returns and kind != "var" and returns.strip() != "void" else []
            bases, implemented = _after_type(got["after"], language) if got.get("after") else ([], [])
            if kind == "interface" and language != "golang":
                implemented = []
            first = None
            for name in split_top(m["name"]):
                row = put(kind, name.split("::")[-1], (*inside.scope, *name.split("::")[:-1]), at, signature=re.sub(r"\s+", " ", " ".join([*modifiers, bare])) if params is not None else "", receiver=re.sub(r"[\s*]", "", got.get("receiver") or ""),
                          params=parameter_types(params, language) if params is not None else [], returns=returned, bases=bases, implements=implemented, modifiers=modifiers, doc=doc_before(at))
                first = first or row
            return first
        return None

    stack = [_Open(None, 0, (), True)]
    begin, depth, group = 0, 0, ""
    if language in ("c", "cpp"):
        for m in re.finditer(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+)(\()?", code):
            put("const", m[1], (), m.start(1))
        code = re.sub(r"\b(?:public|protected|private)\s*:(?!:)", lambda m: " " * len(m[0]), code)
        code = re.sub(r"(?m)^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    for m in re.finditer(r"[{}();\n]", code):
        if len(out) >= MOST_ROWS + len(stack):
            settle([whole, *[o.symbol for o in stack if o.symbol is not None]])
        c, at, top = m[0], m.start(), stack[-1]
        if c == "(":
            head = code[begin:at].strip()
            if language == "golang" and not depth and not group and head in ("type", "const", "var", "import") and top.declares:
                group, begin = head, at + 1
                continue
            depth += 1
        elif c == ")":
            if depth:
                depth -= 1
            elif group:
                group, begin = "", at + 1
        elif depth and c != "{" and c != "}":
            continue
        elif c == "{":
            head = code[begin:at]
            place = begin + len(head) - len(head.lstrip())
            symbol = None
            if top.declares and head.strip() and not depth:
                symbol = declare(f"{group} {head.strip()}" if group else head.strip(), place, True, top)
            inner = symbol["kind"] in _CONTAINERS if symbol else False
            extern = language == "cpp" and re.match(r'^\s*extern\s*"', head)
            inner_scope = (*filter(None, symbol["scope"].split(".")), symbol["name"]) if symbol else top.scope
            stack.append(_Open(symbol, at, inner_scope, bool(inner or extern) and not (symbol and symbol["kind"] == "enum"), begin, language in ("c", "cpp") and head.lstrip().startswith("typedef")))
            if symbol and symbol["kind"] in ("struct", "interface") and language == "golang":
                stack[-1] = stack[-1]._replace(declares=False)
            begin, depth = at + 1, (0 if not depth else -depth - 1000)
        elif c == "}":
            if len(stack) > 1:
                done = stack.pop()
                if depth <= -1000 or (depth < 0):
                    depth = -(depth + 1000)
                if done.symbol is not None:
                    done.symbol["end"] = line(at)
                    body = code[done.at + 1:at]
                    if done.symbol["kind"] in ("function", "method"):
                        done.symbol["calls"] = _calls(body, language)
                    elif language == "golang":
                        done.symbol["embeds"] = [re.sub(r"^\*", "", x) for x in re.findall(r"(?m)^\s*(\*?[A-Za-z_][\w.]*(?:\[[^\]]*\])?)\s*(?:`[^`]*`)?\s*$", body)]
                    begin = at + 1
                else:  # a value in braces belongs to the statement that it stands in
                    begin = done.before if stack[-1].declares and code[done.before:done.at].rstrip().endswith("=") else at + 1
                named = done.typedef and re.match(rf"\s*\**({_NAME})\s*;", code[at + 1:])
                if named:
                    put("type", named[1], stack[-1].scope, at + 1 + named.start(1))
        elif c == ";" or (language == "golang" and c == "\n") or (language in ("typescript", "javascript") and c == "\n" and not re.search(r"[=,(\[{+\-*/&|?:.<]\s*$", code[begin:at])):
            head = code[begin:at].strip()
            if head and top.declares:
                place = begin + len(code[begin:at]) - len(code[begin:at].lstrip())
                row = declare(f"{group} {head}" if group else head, place, False, top)
                if row:
                    row["end"] = line(at)
            begin = at + 1
    out.remove(whole)
    settle([])
    yield pa.RecordBatch.from_pylist([whole], schema=SCHEMA)
    if complete:
        table = pa.Table.from_batches(complete).combine_chunks()
        complete.clear()
        order = pc.sort_indices(table, sort_keys=[("start", "ascending"), ("end", "ascending"), ("place", "ascending")])
        table = table.drop_columns("place")
        for i in range(0, len(order), MOST_ROWS):
            yield from table.take(order[i:i + MOST_ROWS]).combine_chunks().to_batches()


def symbols(files: DataFrame, language: str) -> DataFrame:
    """A row per symbol of (file, text); a file's own row comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*batch.columns, strict=True):  # one file at a time
                yield from parsed(file.as_py(), text.as_py() or "", language)

    return files.select("file", "text").mapInArrow(run, COLUMNS)
