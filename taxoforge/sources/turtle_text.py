"""Turtle documents, the whole grammar, as triples whose terms are written as in N-Triples."""

from __future__ import annotations

import re
from collections.abc import Iterator

_RDF = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#{}>"
_XSD = "^^<http://www.w3.org/2001/XMLSchema#{}>"
_TOKEN = re.compile(
    r"[ \t\r\n]+|#[^\n]*"
    r'|(?P<text>"""(?:[^"\\]|\\.|"{1,2}(?!"))*"""|"(?:[^"\\\n]|\\.)*"' + r"|'''(?:[^'\\]|\\.|'{1,2}(?!'))*'''|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<iri><[^>]*>)|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<mark>\^\^|[;,\[\]()]|\.(?![0-9]))"
    r"|(?P<name>(?:[^\s.;,\[\]()\"'<#^@]|\.(?=[^\s;,\[\]()\"'<#^@.]))+)",
    re.S,
)
_NUMBERS = ((r"[+-]?\d+", "integer"), (r"[+-]?\d*\.\d+", "decimal"), (r"[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+", "double"))
_BARE_QUOTE = re.compile(r'\\.|"', re.S)


class TurtleText:
    """The triples of a Turtle document. ValueError where it is none; ``name`` begins the names of its blank nodes."""

    def __init__(self, text: str, name: str = "b"):
        self.text, self.at, self.name, self.blank = text, 0, name, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.kind, self.token = "", ""
        self.step()

    def step(self) -> str:
        """Go on to the next token; gives the one before."""
        last = self.token
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise ValueError(f"no term at {self.at}: {self.text[self.at : self.at + 40]!r}")
            self.at = m.end()
            if m.lastgroup:
                self.kind, self.token = m.lastgroup, m[0]
                return last
        self.kind, self.token = "end", ""
        return last

    def need(self, mark: str) -> None:
        if self.token != mark:
            raise ValueError(f"{mark!r} expected before {self.at}, found {self.token!r}")
        self.step()

    def fresh(self) -> str:
        self.blank += 1
        return f"_:{self.name}{self.blank}"

    def triples(self) -> Iterator[tuple[str, str, str]]:
        while self.kind != "end":
            if self.token.lower() in ("@prefix", "@base", "prefix", "base"):
                self.directive()
                continue
            out: list[tuple[str, str, str]] = []
            bracket = self.token == "["
            subject = self.node(out)
            if not (bracket and self.token == "."):
                self.predicates(subject, out)
            self.need(".")
            yield from out

    def directive(self) -> None:
        word = self.step()
        name = self.step() if word.lower().endswith("prefix") else ""
        iri = self.step()[1:-1]
        if name:
            self.prefixes[name[:-1]] = iri
        else:
            self.base = iri
        if word.startswith("@"):
            self.need(".")

    def predicates(self, subject: str, out: list) -> None:
        while True:
            predicate = self.node(out)
            out.append((subject, predicate, self.node(out)))
            while self.token == ",":
                self.step()
                out.append((subject, predicate, self.node(out)))
            if self.token != ";":
                return
            while self.token == ";":
                self.step()
            if self.token in (".", "]"):
                return

    def node(self, out: list) -> str:
        """The term here; what brackets hold goes to ``out``."""
        kind, x = self.kind, self.step()
        if kind == "iri":
            return x if re.match(r"<[A-Za-z][A-Za-z0-9+.-]*:", x) else f"<{self.base}{x[1:]}"
        if kind == "text":
            return self.literal(x)
        if x == "[":
            me = self.fresh()
            if self.token != "]":
                self.predicates(me, out)
            self.need("]")
            return me
        if x == "(":
            return self.collection(out)
        if kind != "name":
            raise ValueError(f"a term expected before {self.at}, found {x!r}")
        if x == "a":
            return _RDF.format("type")
        if x in ("true", "false"):
            return f'"{x}"' + _XSD.format("boolean")
        for pattern, number in _NUMBERS:
            if re.fullmatch(pattern, x):
                return f'"{x}"' + _XSD.format(number)
        space, colon, local = x.partition(":")
        return f"<{self.prefixes[space]}{local}>" if colon and space in self.prefixes else x

    def collection(self, out: list) -> str:
        items = []
        while self.token != ")":
            items.append(self.node(out))
        self.step()
        rest = _RDF.format("nil")
        for item in reversed(items):
            me = self.fresh()
            out += [(me, _RDF.format("first"), item), (me, _RDF.format("rest"), rest)]
            rest = me
        return rest

    def literal(self, x: str) -> str:
        quotes = 3 if len(x) >= 6 and x[:3] == x[0] * 3 else 1
        body = x[quotes:-quotes]
        if quotes == 3 or x[0] == "'":
            body = _BARE_QUOTE.sub(lambda m: '\\"' if m[0] == '"' else m[0], body)
        if self.kind == "tag":
            return f'"{body}"' + self.step()
        if self.token == "^^":
            self.step()
            return f'"{body}"^^{self.node([])}'
        return f'"{body}"'
