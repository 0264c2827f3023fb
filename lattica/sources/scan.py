"""One scan over the text of a script: tokens, and what they import, export, call and name.

The scanner knows comments, strings, nested templates and regular expressions, so text that merely
looks like code (a glob in a string, an import in a comment) is never taken for it. Templates are
strings with `*` for their substitutions; the code inside these is scanned as well. There is no
grammar: brackets are paired, and a clause is read from the tokens around its keyword.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from lattica import schemas as S

_TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
      | (?P<name>[A-Za-z_$\u0080-￿][\w$]*)
      | (?P<number>\d[\w.]*)
      | (?P<mark>=>|\.\.\.|\?\.(?!\d)|.)""",
    re.VERBOSE | re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_OPEN, _CLOSE = "([{", ")]}"
_BEFORE_REGEX = frozenset("return typeof case do else in of void delete throw new await yield".split())
_DECLARES = ("const", "let", "var")
_LITERALS = frozenset("true false null undefined this super".split())
_NOT_CALLED = frozenset(S.CODE_WORDS) | {"function", "super", "constructor", "with", "yield", "of", "in", "delete"}
_HEADS = frozenset("if for while switch catch with".split())
LONGEST_EXPORT = 100  # longer names are left out


@dataclass
class Token:
    kind: str  # name, string, template, number, regex, mark
    value: str
    at: int


@dataclass
class Code:
    """Tokens of a stretch of code, and the partner of each bracket (the end, if it has none)."""

    tokens: list[Token] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)

    def value(self, i: int) -> str:
        """A mark's or name's text; empty for other tokens and beyond the ends."""
        return self.tokens[i].value if 0 <= i < len(self.tokens) and self.tokens[i].kind in ("name", "mark") else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def closing(self, i: int) -> int:
        return self.partner.get(i, len(self.tokens))

    def parts(self, i: int, end: int) -> list[tuple[int, int]]:
        """Spans of what stands between commas, brackets skipped."""
        out, start = [], i
        while i < end:
            if self.value(i) == ",":
                out.append((start, i))
                start = i + 1
            i = self.closing(i) + 1 if i in self.partner else i + 1
        return [(a, b) for a, b in [*out, (start, end)] if a < b]


def scan(text: str) -> list[Code]:
    """The code of a text, and that of each template substitution in it."""
    out: list[Code] = []
    _stretch(text, 0, False, out)
    return out


def _stretch(text: str, i: int, inside: bool, out: list[Code]) -> int:
    """Scans to the end, or to the bracket that closes a substitution; returns where it ended."""
    code = Code()
    out.append(code)
    opened: list[int] = []
    n = len(text)
    while i < n:
        c = text[i]
        if c == "`":
            value, i, at = *_template(text, i, out), i
            code.tokens.append(Token("template", value, at))
            continue
        if c == "/" and text[i + 1 : i + 2] not in ("/", "*") and _regex_may_stand(code) and (m := _REGEX.match(text, i)):
            code.tokens.append(Token("regex", m.group(), i))
            i = m.end()
            continue
        m = _TOKEN.match(text, i)
        kind, value = m.lastgroup, m.group()
        if kind != "blank":
            if kind == "mark" and value in _OPEN:
                opened.append(len(code.tokens))
            elif kind == "mark" and value in _CLOSE:
                if not opened and inside and value == "}":
                    return m.end()
                if opened:
                    code.partner[opened.pop()] = len(code.tokens)
            code.tokens.append(Token(kind, value[1:-1] if kind == "string" else value, i))
        i = m.end()
    for k in opened:
        code.partner[k] = len(code.tokens)
    return n


def _regex_may_stand(code: Code) -> bool:
    if not code.tokens:
        return True
    t = code.tokens[-1]
    if t.kind == "name":
        return t.value in _BEFORE_REGEX
    return t.kind == "mark" and t.value not in (")", "]", "}", "<", ".", "?.")


def _template(text: str, i: int, out: list[Code]) -> tuple[str, int]:
    """The value of the template at i, and where it ends."""
    parts, i, n = [], i + 1, len(text)
    while i < n and text[i] != "`":
        if text[i] == "\\":
            parts.append(text[i : i + 2])
            i += 2
        elif text.startswith("${", i):
            parts.append("*")
            i = _stretch(text, i + 2, True, out)
        else:
            parts.append(text[i])
            i += 1
    return "".join(parts).strip(), i + 1


class _Reader:
    """Collects what a text's tokens say."""

    def __init__(self, text: str) -> None:
        self.ends = [i for i, c in enumerate(text) if c == "\n"]
        self.imports: list[dict] = []
        self.exports: dict[str, int] = {}
        self.callees: set[str] = set()
        self.used: set[str] = set()
        self.calls: list[dict] = []
        self.required: list[tuple[str, str | None, list[str]]] = []
        self.imported: list[tuple[str, str | None, list[str]]] = []
        for code in scan(text):
            for i, t in enumerate(code.tokens):
                if t.kind == "name":
                    self.name(code, i)
                elif t.kind == "mark" and t.value in "[{":
                    self.literal(code, i)
        self.imports.sort(key=lambda x: x["at"])

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1 if at else 1

    def add_import(self, path: str, at: int) -> None:
        if path:
            self.imports.append({"path": path, "line": self.line(at), "at": at})

    def export(self, name: str, at: int) -> None:
        if len(name) < LONGEST_EXPORT:
            self.exports.setdefault(name, self.line(at))

    def name(self, code: Code, i: int) -> None:
        t = code.tokens[i]
        member = code.value(i - 1) in (".", "?.")
        if not member and t.value == "import":
            self.import_clause(code, i)
        elif not member and t.value == "export":
            self.export_clause(code, i)
        elif not member and t.value == "require" and code.value(i + 1) == "(" and code.kind(i + 2) == "string" and code.value(i + 3) == ")":
            self.add_import(code.tokens[i + 2].value, t.at)
            self.require_binding(code, i)
        elif not member and t.value in ("exports", "module"):
            self.assigned_exports(code, i)
        self.call(code, i)

    def import_clause(self, code: Code, i: int) -> None:
        at, j = code.tokens[i].at, i + 1
        if code.value(j) == "(":
            if code.kind(j + 1) == "string" and code.value(j + 2) in (")", ","):
                self.add_import(code.tokens[j + 1].value, at)
            return
        if code.kind(j) == "string":
            self.add_import(code.tokens[j].value, at)
            return
        if code.value(j) == "type" and code.value(j + 1) not in ("from", ","):
            j += 1
        first, named = None, []
        while j < len(code.tokens) and code.value(j) != "from":
            if code.value(j) == "{":
                end = code.closing(j)
                named = [code.value(b - 1) for _, b in code.parts(j + 1, end)]
                j = end
            elif code.value(j) == "*" and code.value(j + 1) == "as":
                first = code.value(j + 2)
                j += 2
            elif code.kind(j) == "name" and first is None:
                first = code.value(j)
            elif code.value(j) != ",":
                return
            j += 1
        if code.kind(j + 1) == "string":
            path = code.tokens[j + 1].value
            self.add_import(path, at)
            self.imported.append((path, first or (named[0] if named else None), named))

    def export_clause(self, code: Code, i: int) -> None:
        at, j = code.tokens[i].at, i + 1
        if code.value(j) == "type" and code.value(j + 1) in ("{", "*"):
            j += 1
        if code.value(j) in ("*", "{"):
            j = code.closing(j) + 1 if code.value(j) == "{" else j + 3 if code.value(j + 1) == "as" else j + 1
            if code.value(j) == "from" and code.kind(j + 1) == "string":
                self.add_import(code.tokens[j + 1].value, at)
            return
        if code.value(j) == "async":
            j += 1
        if code.value(j) == "function":
            j += 2 if code.value(j + 1) == "*" else 1
            if code.kind(j) == "name":
                self.export(code.value(j), code.tokens[j].at)
        elif code.value(j) in _DECLARES and code.value(j + 1) != "enum":
            for a, b in code.parts(j + 1, self.statement_end(code, j + 1)):
                if code.kind(a) == "name" and (b - a == 1 or code.value(a + 1) in ("=", ":", "!")):
                    self.export(code.value(a), code.tokens[a].at)

    def statement_end(self, code: Code, j: int) -> int:
        """The end of a declaration: a semicolon, or a line that begins with a name where a value has ended."""
        while j < len(code.tokens):
            if code.value(j) == ";":
                return j
            if code.kind(j) == "name" and self.line(code.tokens[j].at) > self.line(code.tokens[j - 1].at) and (code.kind(j - 1) not in ("mark", "") or code.value(j - 1) in (")", "]", "}")) and code.value(j - 1) not in (*_DECLARES, *_BEFORE_REGEX):
                return j
            j = code.closing(j) + 1 if j in code.partner else j + 1
        return j

    def require_binding(self, code: Code, i: int) -> None:
        if code.value(i - 1) != "=":
            return
        path = code.tokens[i + 2].value
        if code.kind(i - 2) == "name" and code.value(i - 3) in (*_DECLARES, ","):
            self.required.append((path, code.value(i - 2), []))
        elif code.value(i - 2) == "}":
            start = next((k for k, v in code.partner.items() if v == i - 2), None)
            if start is not None and code.value(start - 1) in _DECLARES:
                parts = [(a, b) for a, b in code.parts(start + 1, i - 2) if code.kind(a) == "name"]
                if parts:
                    self.required.append((path, code.value(parts[0][0]), [code.value(a + 2) if code.value(a + 1) == ":" else code.value(a) for a, _ in parts]))

    def assigned_exports(self, code: Code, i: int) -> None:
        if code.value(i + 1) != "." or code.kind(i + 2) != "name" or code.value(i + 3) != "=" or code.value(i + 4) == "=":
            return
        if code.value(i) == "exports":
            self.export(code.value(i + 2), code.tokens[i + 2].at)
        elif code.value(i + 2) != "exports":
            return
        if code.value(i + 4) == "{":
            for a, b in code.parts(i + 5, code.closing(i + 4)):
                if code.kind(a) == "name" and (b - a == 1 or code.value(a + 1) == ":"):
                    self.export(code.value(a), code.tokens[a].at)

    def call(self, code: Code, i: int) -> None:
        """A name before an argument list, alone or as the member of another name."""
        opening = self.arguments_after(code, i)
        if opening is None:
            return
        name, start = code.value(i), i
        if code.value(i - 1) in (".", "?."):
            start = i - 2
            if code.kind(start) != "name" or code.value(start - 1) in (".", "?."):
                start = None  # a member of something else than a name
        elif name in _NOT_CALLED or code.value(i - 1) in ("function", "*") and code.value(i - 2) in ("function", ""):
            return
        new = start is not None and code.value(start - 1) == "new"
        end = code.closing(opening)
        if code.value(end + 1) == "{" and not new and start == i:
            return  # a method's or function's head
        parts = code.parts(opening + 1, end)
        for a, b in parts:
            if code.kind(a) == "name" and code.value(a) not in _LITERALS and (b - a == 1 or b - a == 3 and code.value(a + 1) in (".", "?.") and code.kind(a + 2) == "name"):
                self.used.add(code.value(a))
        if start is None:
            return
        holder = code.value(start)
        if holder in _LITERALS or start < i and holder in _NOT_CALLED:
            return
        self.callees.update({holder, name})
        if new:
            return
        args = [d for a, b in parts if (d := self.argument(code, a, b)) is not None]
        if any(d["kind"] == "string" and d["value"] for d in args):
            self.calls.append({"callee": name if start == i else f"{holder}.{name}", "line": self.line(code.tokens[start].at), "args": args})

    def arguments_after(self, code: Code, i: int) -> int | None:
        """Where the argument list behind a name opens; type arguments may stand between."""
        j = i + 1
        if code.value(j) == "<":
            j += 1
            while code.kind(j) in ("name", "string") or code.value(j) in (".", ",", "[", "]", "|"):
                j += 1
            if code.value(j) != ">":
                return None
            j += 1
        elif code.value(j) == "?." and code.value(j + 1) == "(":
            j += 1
        return j if code.value(j) == "(" else None

    def argument(self, code: Code, a: int, b: int) -> dict | None:
        """A string, an identifier or another argument; none for an empty template."""
        t = code.tokens[a]
        if b - a == 1 and t.kind == "string":
            return {"kind": "string", "value": t.value}
        if b - a == 1 and t.kind == "template":
            return {"kind": "string", "value": t.value} if t.value else None
        chain = (b - a) % 2 == 1 and all(code.kind(k) == "name" if (k - a) % 2 == 0 else code.value(k) in (".", "?.") for k in range(a, b))
        if chain and (b - a > 1 or t.value not in _LITERALS):
            return {"kind": "identifier", "value": "".join(x.value for x in code.tokens[a:b])}
        return {"kind": "other", "value": ""}

    def literal(self, code: Code, i: int) -> None:
        """Names that stand as values in an array or object."""
        before = code.value(i - 1)
        if code.tokens[i].value == "[":
            if code.kind(i - 1) in ("name", "string", "template") and before not in _BEFORE_REGEX or before in (")", "]", "?."):
                return  # a subscript
        elif before not in ("(", "[", ",", "=", ":", "?", "return", "&", "|") or self.is_pattern(code, i):
            return  # a block, a class or a pattern
        if before in _DECLARES or code.value(code.closing(i) + 1) == "=" and code.value(code.closing(i) + 2) not in ("=", ">"):
            return
        for a, b in code.parts(i + 1, code.closing(i)):
            at = a + 2 if code.tokens[i].value == "{" and code.value(a + 1) == ":" and b - a == 3 else a if b - a == 1 else None
            if at is not None and code.kind(at) == "name" and code.value(at) not in _LITERALS:
                self.used.add(code.value(at))

    def is_pattern(self, code: Code, i: int) -> bool:
        """Whether a brace stands among a function's parameters."""
        around = [k for k, v in code.partner.items() if k < i < v and code.value(k) == "("]
        if not around or any(k < m < i < code.closing(m) for k in [max(around)] for m in code.partner if code.value(m) in ("{", "[")):
            return False
        k = max(around)
        after = code.value(code.closing(k) + 1)
        return after == "=>" or after == "{" and code.kind(k - 1) == "name" and code.value(k - 1) not in _HEADS


def extract(source: str) -> dict:
    """Imports, exports, calls and names of one source text."""
    r = _Reader(source)
    bindings: dict[str, str] = {}
    names: dict[str, set[str]] = {}
    for path, first, named in (*r.required, *r.imported):
        if first:
            bindings[path] = first
        if named:
            names.setdefault(path, set()).update(n for n in named if n)
    drop = {"require", *_NOT_CALLED}
    return {
        "raw_imports": [{"path": x["path"], "line": x["line"]} for x in r.imports],
        "exports": list(r.exports.items()),
        "callsites": sorted(r.callees - drop),
        "ref_usages": sorted(r.used - drop),
        "calls": r.calls,
        "bindings": list(bindings.items()),
        "names": [(k, sorted(v)) for k, v in names.items()],
    }
