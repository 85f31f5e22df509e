"""Imports, component use sites and calls of a source file."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from larkspur.extract.syntax import Node, Reader, SyntaxProblem

TYPED, MARKED = (".ts", ".tsx", ".mts", ".cts"), (".tsx", ".jsx", ".js", ".mjs")
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split())
BINARY = frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>>".split())
#: What an argument of a kind is called (fixed values); any other kind keeps its own name.
LABELS = {
    "StringLiteral": "string", "NumericLiteral": "number", "BooleanLiteral": "boolean", "NullLiteral": "null", "Undefined": "undefined", "Identifier": "identifier",
    "ObjectExpression": "object", "ArrayExpression": "array", "ArrowFunctionExpression": "function", "FunctionExpression": "function", "TemplateLiteral": "template",
}
LITERAL = ("StringLiteral", "NumericLiteral", "BooleanLiteral", "NullLiteral", "Undefined")
VERSION = dict.fromkeys(("packageVersionResolved", "packageVersionMajor", "packageVersionMinor", "packageVersionPatch", "packageVersionPrerelease", "packageVersionIsPrerelease"))


def package_of(source: str) -> str:
    return "/".join(source.split("/")[: 2 if source.startswith("@") else 1])


def is_external(source: str, known: frozenset[str] = frozenset()) -> bool:
    if source.startswith((".", "/", "@/", "~/")):
        return False
    return not known or source in known or package_of(source) in known


def is_target(source: str, targets: frozenset[str]) -> bool:
    return not targets or any(source == t or source.startswith(t + "/") for t in targets)


def shown_number(text: str) -> str:
    """A number as JavaScript prints it."""
    plain = text.replace("_", "").rstrip("n")
    if plain[:2].lower() in ("0x", "0b", "0o"):
        value = int(plain, 0)
    elif plain[0] == "0" and plain.isdigit() and not set(plain) & {"8", "9"}:  # octal without a mark
        value = int(plain, 8)
    else:
        value = float(plain)
    if value == float("inf"):
        return "Infinity"
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


def kind_of(items: list[Node]) -> tuple[str, str | None]:
    """(kind, value) of an expression."""
    if not items:
        return "JSXEmptyExpression", None
    first, last = items[0], items[-1]
    if len(items) == 1:
        if first.kind == "string":
            return "StringLiteral", first.value
        if first.kind == "number":
            return ("BigIntLiteral", None) if first.value.endswith("n") else ("NumericLiteral", shown_number(first.value))
        if first.kind == "regex":
            return "RegExpLiteral", None
        if first.kind == "template":
            return "TemplateLiteral", None
        if first.kind == "markup":
            return ("JSXElement" if first.value else "JSXFragment"), None
        if first.kind == "group":
            return {"{": "ObjectExpression", "[": "ArrayExpression", "(": "ParenthesisExpression"}[first.value], None
        if first.kind == "name":
            if first.value in ("true", "false"):
                return "BooleanLiteral", first.value
            special = {"null": "NullLiteral", "undefined": "Undefined", "this": "ThisExpression"}.get(first.value)
            return (special, None) if special else ("Identifier", first.value)
    ops = [x.value for x in items if x.kind == "op"]
    if "=>" in ops:
        return "ArrowFunctionExpression", None
    head = first.value if first.kind == "name" else ""
    if head == "function" or head == "async" and items[1].value == "function":
        return "FunctionExpression", None
    if head == "class":
        return "ClassExpression", None
    if head == "yield":
        return "YieldExpression", None
    if ASSIGN.intersection(ops):
        return "AssignmentExpression", None
    if "?" in ops and ":" in ops:
        return "ConditionalExpression", None
    for word, kind in (("as", "TsAsExpression"), ("satisfies", "TsSatisfiesExpression")):
        if any(x.kind == "name" and x.value == word for x in items[1:]):
            return kind, None
    operands = [k for k, x in enumerate(items) if x.kind == "op" and x.value in BINARY and k and not (items[k - 1].kind == "op" and items[k - 1].value not in ("++", "--", "!"))]
    if any(x.kind == "name" and x.value in ("instanceof", "in") for x in items[1:]) or operands and not _generic(items, len(items) - 1):
        return "BinaryExpression", None
    if head == "await":
        return "AwaitExpression", None
    if first.kind == "op" and first.value in ("++", "--") or last.kind == "op" and last.value in ("++", "--"):
        return "UpdateExpression", None
    if first.kind == "op" and first.value in ("-", "+", "!", "~") or head in ("typeof", "void", "delete"):
        return "UnaryExpression", None
    if last.kind == "op" and last.value == "!":
        return "TsNonNullExpression", None
    if "?." in ops:
        return "OptionalChainingExpression", None
    if head == "new" and all(x.kind != "group" or x.value != "(" for x in items[1:-1]):
        return "NewExpression", None
    if last.kind == "group" and last.value == "(":
        return "CallExpression", None
    if last.kind == "template":
        return "TaggedTemplateExpression", None
    return "MemberExpression", None


def split(items: list[Node]) -> Iterator[list[Node]]:
    """Parts between commas; nothing after a last comma. Commas of type arguments don't part."""
    part: list[Node] = []
    for x in items:
        if x.kind == "op" and x.value == ",":
            yield part
            part = []
        else:
            part.append(x)
    if part:
        yield part


def _generic(items: list[Node], call: int) -> int:
    """Where the type arguments in front of the bracket ``call`` begin, or 0."""
    if call < 3 or items[call].value != "(" or items[call - 1].value not in (">", ">>", ">>>"):
        return 0
    depth = 0
    for k in range(call - 1, 0, -1):
        x = items[k]
        if x.kind == "op" and set(x.value) == {">"}:
            depth += len(x.value)
        elif x.kind == "op" and x.value == "<":
            depth -= 1
            if not depth:
                return k if items[k - 1].kind == "name" else 0
        elif x.kind not in ("name", "group", "string", "number") and x.value not in (".", ",", "|", "&", "=>", "?", ":"):
            return 0
    return 0


@dataclass
class Binding:
    source: str
    imported: str  # '*' for a namespace, 'default', or a name


class Analyzer:
    """One file. ``run`` fills imports, usages and calls."""

    def __init__(self, path: str, source: str, targets: frozenset[str] = frozenset(), known: frozenset[str] = frozenset()):
        self.path, self.source, self.targets, self.known = path, source, targets, known
        self.imports: list[dict] = []
        self.usages: list[dict] = []
        self.calls: list[dict] = []
        self.bound: dict[str, Binding] = {}
        self.starts = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")]
        self.lines = source.split("\n")

    def run(self) -> Analyzer:
        tree = Reader(self.source, self.path[self.path.rfind(".") :] in MARKED).read()
        rest = self.take_imports(tree)
        self.walk(rest)
        return self

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1

    def snippet(self, offset: int) -> str:
        line = self.place(offset)[0]
        return "\n".join(self.lines[max(0, line - 3) : line + 2])

    def take_imports(self, items: list[Node]) -> list[Node]:
        """Notes the import statements; what is left is code."""
        rest, k = [], 0
        while k < len(items):
            x = items[k]
            follows = items[k + 1] if k + 1 < len(items) else None
            begins = not rest or rest[-1].kind != "op" or rest[-1].value != "."
            if x.kind == "name" and x.value == "import" and begins and follows and not (follows.kind == "group" and follows.value == "(") and follows.value != ".":
                k = self.import_statement(items, k + 1)
            else:
                rest.append(x)
                k += 1
        return rest

    def import_statement(self, items: list[Node], k: int) -> int:
        clause = []
        while k < len(items) and items[k].kind != "string":
            clause.append(items[k])
            k += 1
        if k == len(items):
            raise SyntaxProblem("import without source")
        source = items[k].value
        k += 1
        if k + 1 < len(items) and items[k].value in ("with", "assert") and items[k + 1].kind == "group":
            k += 2
        if is_external(source, self.known):
            self.note_import(source, clause)
        return k

    def note_import(self, source: str, clause: list[Node]) -> None:
        type_only = len(clause) > 1 and clause[0].value == "type" and clause[0].kind == "name" and clause[1].value not in (",", "from")
        clause = clause[1:] if type_only else clause
        names: list[tuple[str, str, str, bool]] = []
        for part in split([x for x in clause if not (x is clause[-1] and x.value == "from")]):
            if part[0].kind == "group":
                names += [self.specifier(s) for s in split(part[0].items)]
            elif part[0].value == "*":
                names.append((part[-1].value, "*", "namespace", False))
            else:
                names.append((part[0].value, "default", "default", False))
        self.imports.append({"source": source, "specifiers": [{"local": a, "imported": b, "type": c} for a, b, c, _ in names], "typeOnly": type_only})
        if not type_only and is_target(source, self.targets):
            self.bound |= {local: Binding(source, imported) for local, imported, _, types in names if not types}

    @staticmethod
    def specifier(part: list[Node]) -> tuple[str, str, str, bool]:
        types = len(part) > 1 and part[0].value == "type" and part[1].value != "as"
        part = part[1:] if types else part
        return part[-1].value, part[0].value, "named", types

    def walk(self, items: list[Node]) -> None:
        for k, x in enumerate(items):
            if x.kind == "markup":
                self.element(x)
            elif x.kind == "group":
                if x.value == "(":
                    self.call(items, k)
                self.walk(x.items)
            elif x.kind == "template":
                self.walk(x.items)
            elif x.kind == "name" and x.value == "new":
                self.bare_new(items, k)

    def element(self, x: Node) -> None:
        name, source = self.component(x.value)
        if name:
            line, column = self.place(x.start)
            self.usages.append({"file": self.path, "line": line, "column": column, "componentName": name, "importedFrom": source, "props": [self.prop(a) for a in x.attributes if a.kind == "attribute"], "selfClosing": x.closed, **VERSION})
        else:
            for a in x.attributes:
                self.walk(a.items)
        self.walk(x.items)

    def component(self, name: str) -> tuple[str | None, str | None]:
        head, *more = name.split(".")
        found = self.bound.get(head)
        if not found or len(more) > 1 or ":" in name:
            return None, None
        if not more:
            return (None, None) if found.imported == "*" else (head, found.source)
        return f"{head if found.imported in ('*', 'default') else found.imported}.{more[0]}", found.source

    def prop(self, a: Node) -> dict:
        value, dynamic = "true", False
        if a.items:
            v = a.items[0]
            if v.kind == "string":
                value = v.value
            elif v.kind == "markup":
                value, dynamic = "[jsx]", True
            else:
                kind, plain = kind_of(v.items)
                dynamic = kind not in LITERAL
                value = f"[{plain if kind == 'Identifier' else kind}]" if dynamic else plain
        return {"name": a.value, "value": value, "isDynamic": dynamic, "sourceSnippet": self.snippet(a.start) if dynamic else None}

    def chain(self, items: list[Node], end: int) -> tuple[int, list[str]] | None:
        """(first item, names) of the member chain that ends in front of ``end``; None if it isn't one of plain names."""
        names: list[str] = []
        k = end - 1
        while k >= 0:
            x = items[k]
            if x.kind == "group" and x.value == "[" and len(x.items) == 1 and x.items[0].kind == "string" and k:
                names.append(x.items[0].value)
                k -= 1
                continue
            if x.kind != "name":
                return None
            names.append(x.value)
            if k and items[k - 1].kind == "op" and items[k - 1].value == ".":
                k -= 2
                continue
            if k and items[k - 1].kind == "op" and items[k - 1].value == "?.":
                return None
            return k, names[::-1]
        return None

    def callee(self, names: list[str]) -> tuple[str | None, str | None]:
        found = self.bound.get(names[0])
        if not found or len(names) > 3 or len(names) == 1 and found.imported == "*":
            return None, None
        return ".".join(names[1:] if len(names) == 3 and found.imported != "*" else names), found.source

    def call(self, items: list[Node], k: int) -> None:
        found = self.chain(items, _generic(items, k) or k)
        if not found:
            return
        first, names = found
        name, source = self.callee(names)
        if not name:
            return
        before = items[first - 1] if first else None
        after = items[k + 1] if k + 1 < len(items) else None
        if before and before.kind == "name" and before.value in ("function", "get", "set", "class", "interface"):
            return
        if len(names) == 1 and after and after.kind == "group" and after.value == "{" and (before is None or before.value in ("{", "}", ",", ";", "*", "async", "static") or before.kind == "group"):
            return  # a method's head
        new = bool(before and before.kind == "name" and before.value == "new")
        self.note_call(("new " if new else "") + name, source, before.start if new else items[first].start, items[k].items)

    def bare_new(self, items: list[Node], k: int) -> None:
        """``new X`` without arguments."""
        end = k + 1
        while end < len(items) and (items[end].kind == "name" and (end == k + 1 or items[end - 1].value == ".") or items[end].value == "." and items[end].kind == "op"):
            end += 1
        if end == k + 1 or end < len(items) and (items[end].kind == "group" and items[end].value in "([" or items[end].value == "<" or items[end].kind == "template"):
            return
        found = self.chain(items, end)
        if found and found[0] == k + 1:
            name, source = self.callee(found[1])
            if name:
                self.note_call("new " + name, source, items[k].start, [])

    def note_call(self, name: str, source: str, start: int, inside: list[Node]) -> None:
        line, column = self.place(start)
        args = [self.argument(i, part) for i, part in enumerate(split(inside))]
        self.calls.append({"file": self.path, "line": line, "column": column, "functionName": name, "importedFrom": source, "args": args, **VERSION})

    def argument(self, index: int, part: list[Node]) -> dict:
        spread = bool(part) and part[0].kind == "op" and part[0].value == "..."
        part = part[1:] if spread else part
        kind, value = kind_of(part)
        literal = kind in LITERAL
        return {"index": index, "type": LABELS.get(kind, kind), "value": value, "isSpread": spread, "sourceSnippet": None if literal or not part else self.snippet(part[0].start)}


def analyze(path: str, source: str | None, root: str = "", targets: frozenset[str] = frozenset(), known: frozenset[str] = frozenset()) -> dict:
    """The analysis of one file; a file that can't be read or parsed keeps its row, with the error."""
    relative = path[len(root) :].lstrip("/") if root and path.startswith(root) else path
    out = {"filePath": path, "relativePath": relative, "imports": [], "componentUsages": [], "functionCalls": [], "errors": []}
    if source is None:
        return out | {"errors": ["Read error: no content"]}
    try:
        done = Analyzer(path, source, targets, known).run()
    except Exception as e:  # noqa: BLE001 - whatever one file does, the others are read
        return out | {"errors": [f"Parse error: {e}"]}
    return out | {"imports": done.imports, "componentUsages": done.usages, "functionCalls": done.calls}
