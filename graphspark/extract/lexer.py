"""Tokens of JavaScript, TypeScript and Go with matched brackets; tolerant of anything that doesn't close."""

from __future__ import annotations

import re
from dataclasses import dataclass

_COMMON = r"""
  (?P<space>[^\S\n]+) | (?P<line>\n) | (?P<comment>//[^\n]* | /\*.*?(?:\*/|\Z))
"""
_JS = re.compile(_COMMON + r"""
  | (?P<string>"(?:\\.|[^"\\\n])*"? | '(?:\\.|[^'\\\n])*'?)
  | (?P<number>\d[\w.]*)
  | (?P<name>[\#@]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)
  | (?P<punct>=>|\.\.\.|\?\.(?!\d)|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|.)
""", re.X | re.S)  # fmt: skip
_GO = re.compile(_COMMON + r"""
  | (?P<string>"(?:\\.|[^"\\\n])*"? | `[^`]*`? | '(?:\\.|[^'\\\n])*'?)
  | (?P<number>\d[\w.]*)
  | (?P<name>[A-Za-z_\u0080-\U0010ffff]\w*)
  | (?P<punct>:=|\.\.\.|<-|&\^=|<<=|>>=|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)
""", re.X | re.S)  # fmt: skip
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: After these a slash starts a regular expression, not a division.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    col: int
    #: A line end lies between this token and the one before.
    fresh: bool
    #: Index of the matching bracket; of an opening one without a partner, the number of tokens.
    match: int = -1


class Tokens(list[Token]):
    """The tokens of a source; nested code of templates stands where the template does."""

    def __init__(self, source: str, language: str):
        super().__init__()
        self.source = source
        self.rule = _GO if language == "go" else _JS
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.line, self.fresh = 0, True
        self._scan(0, len(source), None)
        self._pair()

    def _scan(self, at: int, end: int, until: str | None) -> int:
        """Reads up to ``end`` or, in a template, up to the bracket that closes the nested code."""
        depth, source = 0, self.source
        while at < end:
            if self.rule is _JS and source[at] == "`":
                at = self._template(at, end)
                continue
            m = None
            if self.rule is _JS and source[at] == "/" and self._regex_here():
                m = _REGEX.match(source, at)
                kind = "regex"
            if m is None:
                m = self.rule.match(source, at)
                kind = m.lastgroup
            text = m[0]
            if until and text == "{":
                depth += 1
            elif until and text == until:
                if depth == 0:
                    return at
                depth -= 1
            if kind == "line":
                self.fresh = True
            elif kind not in ("space", "comment"):
                self._add(kind, at, m.end())
            elif "\n" in text:
                self.fresh = True
            at = m.end()
        return at

    def _add(self, kind: str, start: int, end: int) -> None:
        while self.line + 1 < len(self.line_starts) and self.line_starts[self.line + 1] <= start:
            self.line += 1
        head = self.source[self.line_starts[self.line] : start]
        col = len(head) if head.isascii() else len(head.encode())
        self.append(Token(kind, self.source[start:end], start, end, self.line + 1, col, self.fresh))
        self.fresh = False

    def _template(self, at: int, end: int) -> int:
        start, source = at, self.source
        nested: list[tuple[int, int]] = []
        at += 1
        while at < end and source[at] != "`":
            if source[at] == "\\":
                at += 2
            elif source.startswith("${", at):
                depth, inner = 1, at + 2
                at += 2
                while at < end and depth:  # a template inside nested code is rare: count brackets alone
                    depth += {"{": 1, "}": -1}.get(source[at], 0)
                    at += 1
                nested.append((inner, at - 1))
            else:
                at += 1
        at = min(end, at + 1)
        self._add("string", start, at)
        for a, b in nested:
            self._scan(a, b, None)
        self.fresh = False
        return at

    def _regex_here(self) -> bool:
        if not self:
            return True
        last = self[-1]
        if last.kind == "name":
            return last.text in _BEFORE_REGEX
        return last.kind == "punct" and last.text not in (")", "]", "}")

    def _pair(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self):
            if t.kind != "punct":
                continue
            if t.text in OPEN:
                stack.append(i)
                t.match = len(self)
            elif t.text in CLOSE:
                while stack and self[stack[-1]].text != CLOSE[t.text]:
                    if t.text != "}":
                        break
                    stack.pop()
                if stack and self[stack[-1]].text == CLOSE[t.text]:
                    t.match = stack.pop()
                    self[t.match].match = i

    def text(self, a: int, b: int) -> str:
        """The source from token ``a`` to the end of token ``b - 1``."""
        return self.source[self[a].start : self[min(b, len(self)) - 1].end] if a < min(b, len(self)) else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self) and self[i].text in texts and self[i].kind != "string"

    def kind(self, i: int) -> str:
        return self[i].kind if 0 <= i < len(self) else ""

    def at(self, i: int) -> tuple[int, int]:
        return self[i].line, self[i].col

    def end(self, i: int) -> tuple[int, int]:
        """Where token ``i`` ends."""
        t = self[min(i, len(self) - 1)]
        lines = t.text.count("\n")
        return (t.line, t.col + len(t.text.encode())) if not lines else (t.line + lines, len(t.text.rpartition("\n")[2].encode()))

    def over(self, i: int) -> int:
        """The index after token ``i`` or, at an opening bracket, after its partner."""
        return self[i].match + 1 if self[i].kind == "punct" and self[i].text in OPEN else i + 1

    def split(self, a: int, b: int, by: str = ",") -> list[tuple[int, int]]:
        """Ranges between separators that are in no bracket."""
        out, start, i = [], a, a
        while i < b:
            if self.is_(i, by):
                out.append((start, i))
                start = i + 1
            i = self.over(i)
        if start < b:
            out.append((start, b))
        return [(x, min(y, b)) for x, y in out if x < y]
