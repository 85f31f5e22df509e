"""Imports, component uses and calls of source texts."""

import pytest

from larkspur.extract.usage import analyze


def run(source, targets=(), path="src/a.tsx", known=()):
    out = analyze(path, source, "", frozenset(targets), frozenset(known))
    assert out["errors"] == []
    return out


def names(out, field, key):
    return [x[key] for x in out[field]]


@pytest.mark.parametrize(
    ("text", "specifiers", "types"),
    [
        ("import { a } from 'p'", [("a", "a", "named")], False),
        ("import { a as b } from 'p'", [("b", "a", "named")], False),
        ("import a from 'p'", [("a", "default", "default")], False),
        ("import * as a from 'p'", [("a", "*", "namespace")], False),
        ("import a, { b, c as d } from 'p'", [("a", "default", "default"), ("b", "b", "named"), ("d", "c", "named")], False),
        ("import type { a } from 'p'", [("a", "a", "named")], True),
        ("import { type a, b } from 'p'", [("a", "a", "named"), ("b", "b", "named")], False),
        ("import 'p'", [], False),
        ("import type from 'p'", [("type", "default", "default")], False),
    ],
)
def test_imports(text, specifiers, types):
    (found,) = run(text)["imports"]
    assert [(s["local"], s["imported"], s["type"]) for s in found["specifiers"]] == specifiers
    assert found["typeOnly"] is types


def test_type_imports_do_not_bind():
    out = run("import type { A } from 'p'; import { type B, C } from 'p'; x = [<A/>, <B/>, <C/>]")
    assert names(out, "componentUsages", "componentName") == ["C"]


@pytest.mark.parametrize(
    ("attribute", "name", "value", "dynamic"),
    [
        ('v="x"', "v", "x", False), ("v", "v", "true", False), ("v={3}", "v", "3", False), ("v={1.50}", "v", "1.5", False), ("v={false}", "v", "false", False),
        ("v={null}", "v", None, False), ("v={undefined}", "v", None, False), ("v={'y'}", "v", "y", False), ("v={w}", "v", "[w]", True), ("v={() => 1}", "v", "[ArrowFunctionExpression]", True),
        ("v={{a: 1}}", "v", "[ObjectExpression]", True), ("v={[1]}", "v", "[ArrayExpression]", True), ("v={`t`}", "v", "[TemplateLiteral]", True), ("v={f()}", "v", "[CallExpression]", True),
        ("v={a.b}", "v", "[MemberExpression]", True), ("v={a ? 1 : 2}", "v", "[ConditionalExpression]", True), ("v={a && b}", "v", "[BinaryExpression]", True), ("v=<i/>", "v", "[jsx]", True), ('a:b="c"', "a:b", "c", False),
    ],
)
def test_props(attribute, name, value, dynamic):
    (use,) = run(f"import {{ B }} from 'p'; x = <B {attribute} />")["componentUsages"]
    (prop,) = use["props"]
    assert (prop["name"], prop["value"], prop["isDynamic"]) == (name, value, dynamic)
    assert (prop["sourceSnippet"] is not None) is dynamic


def test_spread_props_are_passed_over():
    (use,) = run("import { B } from 'p'; x = <B {...p} v />")["componentUsages"]
    assert [p["name"] for p in use["props"]] == ["v"]


def test_component_names():
    source = "import * as N from 'n'; import { B as C } from 'p'; import D from 'd'; x = <N.X><C/><C.Y/><D.Z/><D/><div/><Other/></N.X>"
    out = run(source)
    assert names(out, "componentUsages", "componentName") == ["N.X", "C", "B.Y", "D.Z", "D"]


def test_calls_in_attributes_of_tracked_components_do_not_count():
    out = run("import { B, f } from 'p'; x = <B on={f()}>{f(1)}<div on={f(2)} /></B>")
    assert [c["args"][0]["value"] for c in out["functionCalls"]] == ["1", "2"]


def test_lines_columns_and_snippets():
    source = "import { f } from 'p'\n\n\n\n  f(x)\n\n\n\n"
    (call,) = run(source)["functionCalls"]
    assert (call["line"], call["column"]) == (5, 3)
    assert call["args"][0]["sourceSnippet"] == "\n\n  f(x)\n\n"


@pytest.mark.parametrize(
    ("argument", "kind", "value"),
    [
        ("'s'", "string", "s"), ("-1", "UnaryExpression", None), ("1e3", "number", "1000"), ("0xff", "number", "255"), ("true", "boolean", "true"), ("null", "null", None), ("undefined", "undefined", None),
        ("v", "identifier", "v"), ("{a}", "object", None), ("[a]", "array", None), ("() => 1", "function", None), ("async x => x", "function", None), ("function () {}", "function", None), ("`t${a}`", "template", None),
        ("a.b", "MemberExpression", None), ("g()", "CallExpression", None), ("new G()", "NewExpression", None), ("await g()", "AwaitExpression", None), ("a + b", "BinaryExpression", None), ("a = b", "AssignmentExpression", None),
        ("a as T", "TsAsExpression", None), ("/x/g", "RegExpLiteral", None), ("<i/>", "JSXElement", None), ("g<T>(1)", "CallExpression", None),
    ],
)
def test_arguments(argument, kind, value):
    call = run(f"import {{ f }} from 'p'; f({argument})")["functionCalls"][0]
    assert (call["args"][0]["type"], call["args"][0]["value"]) == (kind, value)


@pytest.mark.parametrize(
    ("code", "found"),
    [
        ("n.f()", ["n.f"]), ("n.a.f()", ["n.a.f"]), ("d.f()", ["d.f"]), ("d.a.f()", ["a.f"]), ("i.a.f()", ["a.f"]), ("i()", ["i"]), ("i<T>(1)", ["i"]), ("n['f']()", ["n.f"]), ("d.a.b.f()", []),
        ("new i()", ["new i"]), ("new n.X(1)", ["new n.X"]), ("new i", ["new i"]), ("i(i())", ["i", "i"]), ("i()()", ["i"]), ("x.i()", []), ("function i() {}", []), ("const o = { i(a) { return a } }", []), ("other()", []),
        ("// i()\n/* i() */ '<i()'", []), ("if (a) { i() }", ["i"]), ("x = a / i() / 2", ["i"]), ("x = `a ${i()} b`", ["i"]),
    ],
)
def test_callees(code, found):
    out = run("import * as n from 'n'; import d from 'd'; import { i } from 'i';\n" + code)
    assert names(out, "functionCalls", "functionName") == found


@pytest.mark.parametrize(("source", "kept"), [("./x", False), ("../x", False), ("/x", False), ("@/x", False), ("~/x", False), ("x", True), ("@s/x/y", True)])
def test_internal_paths(source, kept):
    assert bool(run(f"import a from '{source}'")["imports"]) is kept


def test_known_packages_and_targets():
    source = "import a from '@s/x/y'; import b from '@alias/z'; import { c } from 'q'; a(); b(); c()"
    out = run(source, targets=["@s/x"], known=["@s/x", "q"])
    assert [i["source"] for i in out["imports"]] == ["@s/x/y", "q"]
    assert names(out, "functionCalls", "functionName") == ["a"]


def test_a_file_that_does_not_parse_keeps_its_row():
    out = analyze("a.ts", "const a = (")
    assert out["errors"] and out["imports"] == []
    assert analyze("a.ts", None)["errors"]


def test_types_of_typescript_files_are_not_markup():
    out = run("import { f } from 'p'; const g = <T,>(x: T) => f<Map<string, T>>(x); let y = <any>z;", path="a.ts")
    assert names(out, "functionCalls", "functionName") == ["f"]


@pytest.mark.parametrize(("shown", "value"), [("1e400", "Infinity"), ("010", "8"), ("08", "8"), ("0x1F", "31"), ("1_000", "1000")])
def test_numbers_are_shown_as_the_language_prints_them(shown, value):
    (call,) = analyze("a.ts", f"import {{f}} from 'a'; f({shown})")["functionCalls"]
    assert [a["value"] for a in call["args"]] == [value]


@pytest.mark.parametrize("source", ["f(" + "[" * 3000, "import {f} from 'a'; f(0x)", "f(0b12", "<A b={"])
def test_a_file_that_breaks_the_reader_keeps_its_row(source):
    assert analyze("a.ts", source)["filePath"] == "a.ts"
