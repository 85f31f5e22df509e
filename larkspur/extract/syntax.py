"""A small reader of JavaScript and TypeScript: source text to a tree of tokens, brackets, templates and markup.

It knows just enough grammar to tell strings, templates, regular expressions, comments and markup from operators. It
keeps every position, builds no expression tree, and raises ``SyntaxProblem`` where brackets or quotes don't close.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
OPERATOR = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^!~<>=?:;,.@#]")
SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S)
MARKUP_NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$\-\u0080-\uffff]*")
CLOSERS = {"(": ")", "[": "]", "{": "}"}
#: Words after which an operand follows, not an operator.
BEFORE_OPERAND = frozenset("return typeof case default else in of new delete void throw await yield instanceof do extends export import".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


class SyntaxProblem(ValueError):
    pass


@dataclass
class Node:
    """kind: name, number, string, regex, op, group, template, markup, text. ``items`` are what a bracket holds."""

    kind: str
    value: str
    start: int
    end: int
    items: list = field(default_factory=list)
    attributes: list = field(default_factory=list)
    closed: bool = False


def cooked(raw: str) -> str:
    """The value of a string literal's inside."""

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "ux" and len(x) > 1:
            return chr(int(x[1:].strip("{}"), 16))
        return ESCAPES.get(x, x)

    return re.sub(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|[\s\S])", one, raw) if "\\" in raw else raw


class Reader:
    def __init__(self, source: str, markup: bool):
        self.source, self.markup, self.at = source, markup, 0

    def read(self) -> list[Node]:
        if self.source.startswith("#!"):
            self.at = self.source.find("\n") if "\n" in self.source else len(self.source)
        return self.sequence("")

    def fail(self, what: str) -> SyntaxProblem:
        return SyntaxProblem(f"{what} at {self.at}")

    def skip(self) -> None:
        while m := SPACE.match(self.source, self.at):
            self.at = m.end()
        if self.source.startswith("/*", self.at):
            raise self.fail("unclosed comment")

    @staticmethod
    def operand_may_follow(items: list[Node]) -> bool:
        if not items:
            return True
        last = items[-1]
        if last.kind == "name":
            return last.value in BEFORE_OPERAND
        if last.kind == "group":
            return last.value == "{"
        return last.kind == "op" and last.value not in ("++", "--")

    def sequence(self, closer: str) -> list[Node]:
        items: list[Node] = []
        text = self.source
        while True:
            self.skip()
            if self.at >= len(text):
                if closer:
                    raise self.fail(f"no {closer}")
                return items
            c = text[self.at]
            if c == closer:
                return items
            if c in ")]}":
                raise self.fail(f"stray {c}")
            items.append(self.one(c, items))

    def one(self, c: str, items: list[Node]) -> Node:
        text, start = self.source, self.at
        if m := NAME.match(text, start):
            self.at = m.end()
            return Node("name", m[0], start, self.at)
        if c in "\"'":
            return self.string(c)
        if c == "`":
            return self.template()
        if c in CLOSERS:
            self.at += 1
            inner = self.sequence(CLOSERS[c])
            self.at += 1
            return Node("group", c, start, self.at, inner)
        if c.isdigit() or c == "." and text[start + 1 : start + 2].isdigit():
            m = NUMBER.match(text, start)
            self.at = m.end()
            return Node("number", m[0], start, self.at)
        if c == "/" and self.operand_may_follow(items):
            return self.regex()
        if c == "<" and self.markup and self.operand_may_follow(items) and self.is_markup():
            return self.element()
        m = OPERATOR.match(text, start)
        if not m:
            raise self.fail(f"unexpected {c!r}")
        self.at = m.end()
        return Node("op", m[0], start, self.at)

    def string(self, quote: str) -> Node:
        start, i = self.at, self.at + 1
        while i < len(self.source) and self.source[i] != quote:
            if self.source[i] == "\n":
                break
            i += 2 if self.source[i] == "\\" else 1
        if i >= len(self.source) or self.source[i] != quote:
            raise self.fail("unclosed string")
        self.at = i + 1
        return Node("string", cooked(self.source[start + 1 : i]), start, self.at)

    def template(self) -> Node:
        start = self.at
        self.at += 1
        parts = []
        while True:
            if self.at >= len(self.source):
                raise self.fail("unclosed template")
            c = self.source[self.at]
            if c == "\\":
                self.at += 2
            elif c == "`":
                self.at += 1
                return Node("template", "`", start, self.at, parts)
            elif self.source.startswith("${", self.at):
                begin = self.at
                self.at += 2
                inner = self.sequence("}")
                self.at += 1
                parts.append(Node("group", "{", begin, self.at, inner))
            else:
                self.at += 1

    def regex(self) -> Node:
        start, i, in_class = self.at, self.at + 1, False
        while i < len(self.source) and (in_class or self.source[i] != "/"):
            c = self.source[i]
            if c == "\n":
                raise self.fail("unclosed regular expression")
            in_class = c == "[" or in_class and c != "]"
            i += 2 if c == "\\" else 1
        if i >= len(self.source):
            raise self.fail("unclosed regular expression")
        i += 1
        while i < len(self.source) and self.source[i].isalpha():
            i += 1
        self.at = i
        return Node("regex", self.source[start:i], start, i)

    def is_markup(self) -> bool:
        rest = self.source[self.at + 1 : self.at + 200]
        if rest.lstrip().startswith(">"):
            return True
        # <T,>(..) and <T extends ..>(..) are type parameters
        return bool(MARKUP_NAME.match(rest)) and not re.match(r"[\w$]+\s*(?:,|extends\s|=\s*\w[^>]*>\s*\()", rest)

    def markup_name(self) -> str:
        m = MARKUP_NAME.match(self.source, self.at)
        if not m:
            raise self.fail("no name")
        self.at = m.end()
        name = m[0]
        while self.source[self.at : self.at + 1] in (".", ":"):
            mark = self.source[self.at]
            self.at += 1
            m = MARKUP_NAME.match(self.source, self.at)
            if not m:
                raise self.fail("no name")
            self.at = m.end()
            name += mark + m[0]
        return name

    def expect(self, mark: str) -> None:
        if not self.source.startswith(mark, self.at):
            raise self.fail(f"no {mark}")
        self.at += len(mark)

    def element(self) -> Node:
        start = self.at
        self.at += 1
        self.skip()
        node = Node("markup", "", start, start)
        if self.source[self.at] != ">":
            node.value = self.markup_name()
            self.skip()
            if self.source.startswith("<", self.at):  # type arguments
                self.type_arguments()
            self.attributes(node)
        if self.source.startswith("/", self.at):
            self.at += 1
            self.skip()
            self.expect(">")
            node.closed, node.end = True, self.at
            return node
        self.expect(">")
        self.children(node)
        node.end = self.at
        return node

    def type_arguments(self) -> None:
        depth = 0
        while self.at < len(self.source):
            depth += {"<": 1, ">": -1}.get(self.source[self.at], 0)
            self.at += 1
            if not depth:
                self.skip()
                return
        raise self.fail("no >")

    def attributes(self, node: Node) -> None:
        while True:
            self.skip()
            c = self.source[self.at : self.at + 1]
            if c in ("", ">", "/"):
                if not c:
                    raise self.fail("unclosed tag")
                return
            start = self.at
            if c == "{":
                self.at += 1
                inner = self.sequence("}")
                self.at += 1
                node.attributes.append(Node("spread", "", start, self.at, inner))
                continue
            name = self.markup_name()
            self.skip()
            value = []
            if self.source.startswith("=", self.at):
                self.at += 1
                self.skip()
                value = [self.attribute_value()]
            node.attributes.append(Node("attribute", name, start, self.at, value))

    def attribute_value(self) -> Node:
        start, c = self.at, self.source[self.at : self.at + 1]
        if c and c in "\"'":
            end = self.source.find(c, start + 1)
            if end < 0:
                raise self.fail("unclosed string")
            self.at = end + 1
            return Node("string", self.source[start + 1 : end], start, self.at)
        if c == "{":
            self.at += 1
            inner = self.sequence("}")
            self.at += 1
            return Node("group", "{", start, self.at, inner)
        if c == "<":
            return self.element()
        raise self.fail("no value")

    def children(self, node: Node) -> None:
        while True:
            if self.at >= len(self.source):
                raise self.fail(f"unclosed <{node.value}>")
            c = self.source[self.at]
            if c == "<":
                if re.match(r"<\s*/", self.source[self.at : self.at + 20]):
                    self.at = self.source.index("/", self.at) + 1
                    self.skip()
                    name = self.markup_name() if self.source[self.at : self.at + 1] != ">" else ""
                    if name != node.value:
                        raise self.fail(f"</{name}> closes <{node.value}>")
                    self.skip()
                    self.expect(">")
                    return
                node.items.append(self.element())
            elif c == "{":
                start = self.at
                self.at += 1
                inner = self.sequence("}")
                self.at += 1
                node.items.append(Node("group", "{", start, self.at, inner))
            else:
                self.at += 1
