"""The parser of languages with braces on what generated files don't hold: groups, nesting, literals, typedefs, broken files."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lithic.sources import brace


def found(text, language):
    return {(r["kind"], r["scope"], r["name"]): r for r in brace.parse("f", text, language)}


def test_go_groups():
    got = found("package m\n\nimport (\n\t\"a\"\n)\n\ntype (\n\tA int\n\tB struct {\n\t\tC\n\t}\n)\n\nconst (\n\tX = 1\n\tY\n)\nvar p, q = 1, 2\n\n// Gen makes.\n// Much.\nfunc Gen[T any](x T) T { return x }\n", "golang")
    assert {k[0] + ":" + k[2] for k in got} == {"file:f", "type:A", "struct:B", "const:X", "const:Y", "var:p", "var:q", "function:Gen"}
    gen = got["function", "", "Gen"]
    assert (gen["params"], gen["returns"], gen["doc"]) == (["T"], ["T"], "Gen makes.\nMuch.") and got["struct", "", "B"]["embeds"] == ["C"]


def test_java_nesting():
    got = found("package a;\nclass Box<T> {\n  private List<String> names = new ArrayList<>();\n  Box(int a) { super(a); }\n  abstract void none();\n  enum Color { RED, BLUE }\n  interface I extends J, K { int f(); }\n}\nrecord P(int x, String y) { }\n", "java")
    assert {k[1:] + (k[0],) for k in got} == {("", "f", "file"), ("", "Box", "class"), ("Box", "names", "var"), ("Box", "Box", "method"), ("Box", "none", "method"), ("Box", "Color", "enum"), ("Box", "I", "interface"), ("Box.I", "f", "method"), ("", "P", "class")}
    assert got["interface", "Box", "I"]["bases"] == ["J", "K"] and got["class", "", "P"]["params"] == ["int", "String"]


def test_script_values():
    got = found("const y = { a: 1, b: () => { h() } };\nexport function run<T>(x: T, ...rest: string[]): T { return x }\nenum E { A, B }\nlet u = 3\n", "typescript")
    assert {k[0] + ":" + k[2] for k in got} == {"file:f", "const:y", "function:run", "enum:E", "var:u"} and got["function", "", "run"]["returns"] == ["T"]


def test_c_typedefs_and_macros():
    got = found("#include <x.h>\n#define MAX 3\n#define F(x) \\\n  (x)\ntypedef struct node { int a; } node_t;\ntypedef int (*cb)(int);\nstatic int add(int a, const char *b)\n{\n    return go(a) + MAX;\n}\nint go(void);\nint table[3] = {1, 2, 3};\n", "c")
    assert {k[0] + ":" + k[2] for k in got} == {"file:f", "const:MAX", "const:F", "struct:node", "type:node_t", "type:cb", "function:add", "function:go", "var:table"}
    assert got["function", "", "add"]["params"] == ["int", "const char *"] and got["function", "", "add"]["calls"] == ["go"] and got["function", "", "go"]["params"] == []


def test_cpp_scopes():
    got = found("namespace x::y {\nclass Node : public B {\npublic:\n  Node(int a) : a_(a) { init(); }\n  virtual int size() const = 0;\nprivate:\n  int a_;\n};\n}\nint x::y::Node::size() const { return 1; }\n", "cpp")
    assert ("method", "x.y.Node", "size") in got and ("var", "x.y.Node", "a_") in got and ("function", "x.y.Node", "size") in got and got["class", "x.y", "Node"]["bases"] == ["B"]
    assert got["method", "x.y.Node", "Node"]["calls"] == ["init"]


@given(st.text(alphabet="{}()[];\n\"'`/* classfunc=,<>:", max_size=120), st.sampled_from(sorted(brace.HEADS)))
@settings(max_examples=300, deadline=None)
def test_any_text_is_parsed(text, language):
    rows = brace.parse("f", text, language)
    assert rows[0]["kind"] == "file" and all(1 <= r["start"] <= r["end"] <= text.count("\n") + 1 for r in rows)


def test_symbols_of_a_long_file_come_in_batches(monkeypatch):
    text = "class A {\n" + "".join(f"  /** D{i} */\n  int f{i}(int a) {{ return g{i}(a); }}\n" for i in range(300)) + "}\nclass B {\n}\n"
    whole = brace.parse("d/A.java", text, "java")
    assert len(whole) == 303 and [r["name"] for r in whole[:3]] == ["A.java", "A", "f0"] and whole[1]["end"] == 602 and whole[2]["doc"] == "D0"
    monkeypatch.setattr(brace, "MOST_ROWS", 7)
    batches = list(brace.parsed("d/A.java", text, "java"))
    assert max(b.num_rows for b in batches) <= 7 and [r for b in batches for r in b.to_pylist()] == whole
