"""Facts of JavaScript and TypeScript from tokens: declarations first, then uses, in two walks of the same rules.

The code of an edge is the text of the construct itself.
"""

from __future__ import annotations

from graphspark.extract.facts import Facts, Scope
from graphspark.extract.lexer import Tokens

# Words that are no symbols.
KEYWORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get"
    " if implements import in instanceof interface is keyof let module namespace never new null number object of override private protected public readonly return satisfies set static string super"
    " switch symbol this throw true try type typeof undefined unique unknown var void while with yield".split()
)
MODIFIERS = frozenset("public private protected readonly static abstract override async declare get set accessor".split())
CONTROL = frozenset("if for while switch catch with".split())
INDIRECT = frozenset("bind call apply".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


def extract(facts: Facts) -> None:
    _run(facts, typed=False)


def extract_typescript(facts: Facts) -> None:
    _run(facts, typed=True)


def _run(facts: Facts, typed: bool) -> None:
    tokens = Tokens(facts.source, "typescript" if typed else "javascript")
    for linking in (False, True):
        _Walk(facts, tokens, typed, linking).block(0, len(tokens), ())


class _Walk:
    def __init__(self, facts: Facts, tokens: Tokens, typed: bool, linking: bool):
        self.facts, self.t, self.typed, self.linking = facts, tokens, typed, linking

    # Facts

    def node(self, kind: str, name: str, scope: Scope, a: int, b: int | None = None, annotation: str = "", is_param: bool = False) -> str:
        return self.facts.node(kind, name, scope, self.t.at(a), self.t.end((b or a + 1) - 1), annotation, is_param)

    def edge(self, kind: str, source: str, target: str, a: int, b: int, **meta: object) -> None:
        if self.linking:
            self.facts.edge(kind, source, target, self.t.at(a), self.t.text(a, b), **meta)

    def owner(self, scope: Scope) -> str:
        return self.facts.id(*scope)

    def imports(self, name: str, a: int, b: int) -> None:
        self.edge("imports", self.facts.id(), self.facts.external(name, self.t.at(a)), a, b)

    def reads(self, name: str, scope: Scope, i: int, b: int | None = None) -> None:
        if found := self.facts.resolve(name, scope):
            self.edge("reads", self.owner(scope), found, i, b or i + 1)

    # Blocks and statements

    def block(self, i: int, end: int, scope: Scope) -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end, scope))

    def statement(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        word = t[i].text if t.kind(i) == "name" else ""
        after = lambda k: t.kind(i + k) == "name"
        if word == "async" and t.is_(i + 1, "function"):
            return self.function(i, i + 1, end, scope)
        if word == "function":
            return self.function(i, i, end, scope)
        if word in ("class", "abstract") and (after(1) or t.is_(i + 1, "{")):
            return self.class_(i, i + (2 if word == "abstract" else 1), end, scope)
        if word in ("const", "let", "var") and (after(1) or t.is_(i + 1, "{", "[")):
            if t.is_(i + 1, "enum"):
                return self.enum(i + 1, end, scope)
            return self.variables(i, end, scope)
        if word == "import" and not t.is_(i + 1, "(", "."):
            return self.import_(i, end, scope)
        if word == "export":
            return self.export(i, end, scope)
        if word == "return":
            stop = self.statement_end(i, end)
            if t.kind(i + 1) == "name" and stop == i + 2 and not t[i + 1].fresh and t[i + 1].text not in KEYWORDS:
                name = t[i + 1].text
                self.edge("returns", self.owner(scope), self.facts.resolve(name, scope) or self.facts.id(*scope, name), i, stop)
            self.expression(i + 1, stop, scope)
            return stop
        if word == "catch" and t.is_(i + 1, "("):
            for a, b in t.split(i + 2, min(t[i + 1].match, end)):
                self.pattern(a, b, scope)
            return t.over(i + 1)
        if self.typed and word == "interface" and after(1):
            return self.interface(i, end, scope)
        if self.typed and word == "type" and after(1) and t.is_(self.type_parameters(i + 2), "="):
            return self.alias(i, end, scope)
        if self.typed and word in ("namespace", "module", "declare") and (after(1) or t.kind(i + 1) == "string"):
            return i + (1 if word == "declare" else 2)
        if self.typed and word == "enum" and after(1):
            return self.enum(i, end, scope)
        if word in CONTROL and t.is_(i + 1, "("):
            stop = min(t[i + 1].match, end)
            self.block(i + 2, stop, scope)
            return stop + 1
        if t.is_(i, "{"):
            stop = min(t[i].match, end)
            self.block(i + 1, stop, scope)
            return stop + 1
        if t.is_(i, ";", ",", ")", "]", "}") or word in ("else", "do", "try", "finally", "case", "default", "throw", "break", "continue"):
            return i + 1
        stop = self.statement_end(i, end)
        self.expression(i, stop, scope)
        return stop

    def statement_end(self, i: int, end: int) -> int:
        """Where an expression statement ends: a semicolon, or a line that can't go on."""
        t, start = self.t, i
        while i < end:
            if t.is_(i, ";", "}"):
                return i
            if i > start and t[i].fresh and self.breaks(i):
                return i
            i = t.over(i)
        return min(i, end)

    def breaks(self, i: int) -> bool:
        """A new statement starts at token ``i``, the first of its line."""
        t = self.t
        if t[i].kind == "punct" and t[i].text not in ("{", "++", "--", "!", "~", "...", "["):
            return False
        if t[i].text in ("instanceof", "in", "as", "satisfies") and t[i].kind == "name":
            return False
        last = t[i - 1]
        return not (last.kind == "punct" and last.text not in (")", "]", "}", "++", "--") or last.text in ("return", "typeof", "new", "await", "of", "in", "extends", "case", "else") and last.kind == "name")

    # Declarations

    def type_parameters(self, i: int) -> int:
        """The index after ``<...>`` if there is one at ``i``."""
        t = self.t
        if not t.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(t) and k < i + 200:
            depth += {"<": 1, ">": -1}.get(t[k].text, 0) if t[k].kind == "punct" else 0
            if depth == 0:
                return k + 1
            if t.is_(k, ";", "{", "}") and depth == 1 and t.is_(k, ";"):
                return i
            k = t.over(k)
        return i

    def function(self, first: int, i: int, end: int, scope: Scope, kind_name: str | None = None) -> int:
        """``function [*] name (...) {...}``; without a name it belongs to its surroundings."""
        t = self.t
        i += 1
        if t.is_(i, "*"):
            i += 1
        name = kind_name
        if t.kind(i) == "name":
            name = name or t[i].text
            i += 1
        i = self.type_parameters(i)
        if not t.is_(i, "("):
            return i
        close = t[i].match
        body, returns = self.signature_end(close + 1, end)
        stop = min(t[body].match, end - 1) + 1 if body < end and t.is_(body, "{") else max(body, close + 1)
        inner = scope
        if name:
            node = self.node("Function", name, scope, first, stop, returns)
            self.edge("defines", self.owner(scope), node, first, stop)
            inner = (*scope, name)
        self.parameters(i + 1, min(close, end), inner)
        if t.is_(body, "{"):
            self.block(body + 1, stop - 1, inner)
        return stop

    def signature_end(self, i: int, end: int) -> tuple[int, str]:
        """From behind the parameters to the body: its index and the return type between."""
        t = self.t
        if not t.is_(i, ":"):
            return i, ""
        start = i = i + 1
        while i < end and not t.is_(i, ";", "=>", ",", ")", "="):
            if t.is_(i, "{") and i > start and not (t.is_(i - 1, "|", "&", "<", ":", "=>", ",")):
                break
            if t[i].fresh and i > start and t.kind(i) == "name" and t.kind(i - 1) != "punct":
                break
            i = t.over(i)
        return i, t.text(start, min(i, end))

    def parameters(self, a: int, b: int, scope: Scope) -> None:
        for x, y in self.t.split(a, b):
            self.pattern(x, y, scope, is_param=True)

    def pattern(self, a: int, b: int, scope: Scope, is_param: bool = False) -> list[str]:
        """Declares what a binding pattern names; default values are expressions."""
        t, out = self.t, []
        while a < b and (t[a].text in MODIFIERS and t.kind(a + 1) == "name" and a + 1 < b or t.is_(a, "...") or t.text(a, a + 1).startswith("@")):
            a += 1
        default = next((k for k in self.top(a, b) if t.is_(k, "=")), b)
        colon = next((k for k in self.top(a, default) if t.is_(k, ":")), default)
        if t.is_(a, "{", "["):
            for x, y in t.split(a + 1, min(t[a].match, b)):
                key = next((k for k in self.top(x, y) if t.is_(k, ":")), None)
                out += self.pattern(key + 1 if key is not None and t.is_(a, "{") else x, y, scope, is_param)
        elif t.kind(a) == "name" and a < b and t[a].text not in ("this",):
            annotation = t.text(colon + 1, default) if self.typed and colon < default else ""
            self.node("Variable", t[a].text, scope, a, None, annotation, is_param)
            out.append(t[a].text)
        if default < b:
            self.expression(default + 1, b, scope)
        return out

    def top(self, a: int, b: int):
        while a < b:
            yield a
            a = self.t.over(a)

    def variables(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        stop = self.statement_end(i, end)
        inside_for = next((k for k in self.top(i + 1, stop) if t.is_(k, "of", "in") and t.kind(k) == "name"), None)
        if inside_for is not None:
            for name in self.pattern(i + 1, inside_for, scope):
                self.edge("assigns", self.owner(scope), self.facts.id(*scope, name), i, stop)
            self.expression(inside_for + 1, stop, scope)
            return stop
        for a, b in t.split(i + 1, stop):
            equals = next((k for k in self.top(a, b) if t.is_(k, "=")), b)
            names = self.pattern(a, equals, scope)
            for name in names:
                self.edge("assigns", self.owner(scope), self.facts.id(*scope, name), a, b)
            if equals < b:
                module = self.required(equals + 1, b)
                if module:
                    for name in self.picked(a, equals) or [""]:
                        self.imports(f"{module}.{name}" if name else module, a, b)
                self.value(names[0] if len(names) == 1 and t.kind(a) == "name" else None, equals + 1, b, scope)
        return stop

    def picked(self, a: int, b: int) -> list[str]:
        """Keys of an object pattern."""
        t = self.t
        return [t[x].text for x, _ in t.split(a + 1, min(t[a].match, b)) if t.kind(x) == "name"] if t.is_(a, "{") else []

    def required(self, a: int, b: int) -> str:
        for k in range(a, min(b, a + 8)):
            if t_is(self.t, k, "require") and self.t.is_(k + 1, "(") and self.t.kind(k + 2) == "string":
                return self.t[k + 2].text.strip("'\"`")
        return ""

    def value(self, name: str | None, a: int, b: int, scope: Scope) -> None:
        """A value that gets a name: functions and classes put their inside into the scope of the name."""
        t = self.t
        inner = (*scope, name) if name else scope
        k = a + 1 if t.is_(a, "async") else a
        if t.is_(k, "function"):
            i = k + 1 + t.is_(k + 1, "*")
            i += t.kind(i) == "name"
            if t.is_(i, "("):
                self.parameters(i + 1, min(t[i].match, b), inner)
                body, _ = self.signature_end(t[i].match + 1, b)
                if t.is_(body, "{"):
                    self.block(body + 1, min(t[body].match, b), inner)
                    self.expression(t.over(body), b, scope)
                return
        arrow = self.arrow(k, b)
        if arrow is not None:
            self.arrow_body(k, arrow, b, inner)
            return
        if t.is_(a, "class") and name:
            self.class_(a, a, b, scope, name)
            return
        self.expression(a, b, scope)

    def arrow(self, a: int, b: int) -> int | None:
        """The index of ``=>`` if an arrow function starts at ``a``."""
        t = self.t
        i = self.type_parameters(a)
        if t.kind(i) == "name" and t[i].text not in KEYWORDS and t.is_(i + 1, "=>"):
            return i + 1 if i + 1 < b else None
        if t.is_(i, "(") and t[i].match < b:
            after, _ = self.signature_end(t[i].match + 1, b)
            return after if t.is_(after, "=>") and after < b else None
        return None

    def arrow_body(self, a: int, arrow: int, b: int, scope: Scope) -> int:
        t = self.t
        i = self.type_parameters(a)
        if t.is_(i, "("):
            self.parameters(i + 1, t[i].match, scope)
        else:
            self.pattern(i, arrow, scope, is_param=True)
        if t.is_(arrow + 1, "{"):
            stop = min(t[arrow + 1].match, b)
            self.block(arrow + 2, stop, scope)
            return stop + 1
        self.expression(arrow + 1, b, scope)
        return b

    def class_(self, first: int, i: int, end: int, scope: Scope, name: str | None = None) -> int:
        t = self.t
        i += t.is_(i, "class")
        if t.kind(i) == "name" and not t.is_(i, "extends", "implements"):
            name = name or t[i].text
            i = self.type_parameters(i + 1)
        brace = next((k for k in range(i, min(end, i + 60)) if t.is_(k, "{")), None)
        if brace is None or not name:
            return i
        self.expression(i, brace, scope)
        stop = min(t[brace].match, end - 1) + 1
        node = self.node("Class", name, scope, first, stop)
        self.edge("defines", self.owner(scope), node, first, stop)
        self.members(brace + 1, stop - 1, (*scope, name))
        return stop

    def members(self, i: int, end: int, scope: Scope) -> None:
        t = self.t
        while i < end:
            first = i
            while i < end and (t[i].text in MODIFIERS or t.is_(i, "*") or t[i].text.startswith("@")) and not t.is_(i + 1, "(", "=", ";", ":", "?"):
                i += 1
            name = t[i].text if t.kind(i) in ("name", "string") else ""
            if not name:
                i = t.over(i)
                continue
            k = i + 1 + t.is_(i + 1, "?", "!")
            k = self.type_parameters(k)
            if t.is_(k, "("):
                close = min(t[k].match, end)
                body, returns = self.signature_end(close + 1, end)
                stop = min(t[body].match, end - 1) + 1 if body < end and t.is_(body, "{") else max(body, close + 1)
                node = self.node("Function", name, scope, first, stop, returns)
                self.edge("defines", self.owner(scope), node, first, stop)
                self.parameters(k + 1, close, (*scope, name))
                if t.is_(body, "{"):
                    self.block(body + 1, stop - 1, (*scope, name))
                i = stop
                continue
            stop = self.statement_end(i, end)
            equals = next((x for x in self.top(k, stop) if t.is_(x, "=")), stop)
            annotation = t.text(k + 1, equals) if t.is_(k, ":") else ""
            node = self.node("Variable", name, scope, first, stop, annotation)
            self.edge("defines", self.owner(scope), node, first, stop)
            if equals < stop:
                self.value(name, equals + 1, stop, scope)
            i = max(stop, i + 1)

    def interface(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        brace = next((k for k in range(i + 2, min(end, i + 60)) if t.is_(k, "{")), None)
        if brace is None:
            return i + 2
        stop = min(t[brace].match, end - 1) + 1
        node = self.node("Class", t[i + 1].text, scope, i, stop)
        self.edge("defines", self.owner(scope), node, i, stop)
        self.type_members(brace + 1, stop - 1, (*scope, t[i + 1].text))
        return stop

    def type_members(self, i: int, end: int, scope: Scope) -> None:
        t = self.t
        while i < end:
            first = i
            stop = i + 1
            while stop < end and not t.is_(stop, ";", ",") and not (t[stop].fresh and not t.is_(stop, "|", "&", "?", ":", "=>") and not t.is_(stop - 1, "|", "&", ":", "=>")):
                stop = t.over(stop)
            stop = min(stop, end)
            i += t.is_(i, "readonly") and t.kind(i + 1) == "name"
            if t.kind(i) in ("name", "string"):
                k = i + 1 + t.is_(i + 1, "?")
                method = t.is_(self.type_parameters(k), "(")
                annotation = t.text(next((x for x in self.top(k, stop) if t.is_(x, ":")), stop) + 1, stop)
                node = self.node("Function" if method else "Variable", t[i].text.strip("'\""), scope, first, stop, annotation)
                self.edge("defines", self.owner(scope), node, first, stop)
                if method:
                    k = self.type_parameters(k)
                    self.parameters(k + 1, min(t[k].match, stop), (*scope, t[i].text))
            i = max(stop, first + 1)
            i += t.is_(i, ";", ",") and i < end

    def alias(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        equals = self.type_parameters(i + 2)
        stop = self.statement_end(equals + 1, end)
        node = self.node("Class", t[i + 1].text, scope, i, stop)
        self.edge("defines", self.owner(scope), node, i, stop)
        if t.is_(equals + 1, "{"):
            self.type_members(equals + 2, min(t[equals + 1].match, end), (*scope, t[i + 1].text))
        return stop

    def enum(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        if not t.is_(i + 2, "{"):
            return i + 2
        stop = min(t[i + 2].match, end - 1) + 1
        node = self.node("Class", t[i + 1].text, scope, i, stop)
        self.edge("defines", self.owner(scope), node, i, stop)
        inner = (*scope, t[i + 1].text)
        for a, b in t.split(i + 3, stop - 1):
            self.edge("defines", node, self.node("Variable", t[a].text.strip("'\""), inner, a, b), a, b)
        return stop

    # Modules

    def import_(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        stop = i + 1
        while stop < end and t.kind(stop) != "string" and not t.is_(stop, ";"):
            stop = t.over(stop)
        stop = min(stop + 1, end)
        module = t[stop - 1].text.strip("'\"") if t.kind(stop - 1) == "string" else ""
        k = i + 1 + (t.is_(i + 1, "type") and not t.is_(i + 2, "from", ","))
        names: list[tuple[str, str, int]] = []  # what is imported, its local name, where
        while k < stop - 1:
            if t.is_(k, "{"):
                for a, b in t.split(k + 1, min(t[k].match, stop)):
                    a += t.is_(a, "type") and b - a > 1 and t.kind(a + 1) == "name" and not t.is_(a + 1, "as")
                    names.append((t[a].text, t[b - 1].text, b - 1))
                k = t.over(k)
            elif t.is_(k, "*") and t.is_(k + 1, "as"):
                names.append(("", t[k + 2].text, k + 2))
                k += 3
            elif t.kind(k) == "name" and not t.is_(k, "from"):
                names.append((t[k].text, t[k].text, k))
                k += 1
            else:
                k += 1
        if module and not names:
            self.imports(module, i, stop)
        for name, local, where in names:
            self.imports(f"{module}.{name}" if name else module, i, stop)
            self.node("Variable", local, scope, where)
            self.edge("assigns", self.facts.id(), self.facts.id(*scope, local), i, stop)
        return stop

    def export(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        k = i + 1 + t.is_(i + 1, "default", "declare") + (t.is_(i + 1, "type") and t.is_(i + 2, "{"))
        if t.is_(k, "{"):
            close = min(t[k].match, end)
            if t.is_(close + 1, "from"):
                module = t[close + 2].text.strip("'\"") if t.kind(close + 2) == "string" else ""
                for a, _ in t.split(k + 1, close):
                    self.imports(f"{module}.{t[a].text}", i, close + 3)
                return min(end, close + 3)
            for a, _ in t.split(k + 1, close):
                self.reads(t[a].text, scope, a)
            return close + 1
        if t.is_(k, "*"):
            stop = self.statement_end(k, end)
            if t.kind(stop - 1) == "string":
                self.imports(t[stop - 1].text.strip("'\""), i, stop)
            return stop
        return k

    # Expressions

    def expression(self, i: int, end: int, scope: Scope) -> None:
        end = min(end, len(self.t))
        while i < end:
            i = max(i + 1, self.term(i, end, scope))

    def term(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        if t.kind(i) == "punct":
            arrow = self.arrow(i, end) if t.is_(i, "(", "<") else None
            if arrow is not None:
                return self.arrow_body(i, arrow, self.operand_end(arrow + 1, end), scope)
            if t.is_(i, "{"):
                return self.object_(i, end, scope)
            return i + 1
        if t.kind(i) != "name":
            return i + 1
        word = t[i].text
        if word == "async" and t.is_(i + 1, "function"):
            return self.function(i, i + 1, end, scope)
        if word == "function":
            return self.function(i, i, end, scope)
        if word == "class" and (t.kind(i + 1) == "name" or t.is_(i + 1, "{")):
            return self.class_(i, i, end, scope)
        arrow = self.arrow(i + 1 if word == "async" else i, end)
        if arrow is not None:
            return self.arrow_body(i + 1 if word == "async" else i, arrow, self.operand_end(arrow + 1, end), scope)
        if word == "new" and t.kind(i + 1) == "name":
            return self.access(i, i + 1, end, scope, new=True)
        if word in KEYWORDS and word not in ("this", "super") or (word in KEYWORDS and not t.is_(i + 1, ".", "?.")):
            return i + 1
        return self.access(i, i, end, scope)

    def operand_end(self, i: int, end: int) -> int:
        for k in self.top(i, end):
            if self.t.is_(k, ",", ";", ")", "]", "}"):
                return k
        return end

    def object_(self, i: int, end: int, scope: Scope) -> int:
        """An object literal: shorthand names are reads, methods and functions keep the scope."""
        t = self.t
        stop = min(t[i].match, end)
        for a, b in t.split(i + 1, stop):
            k = a
            while k < b and (t[k].text in ("async", "get", "set") and t.kind(k + 1) == "name" or t.is_(k, "*")):
                k += 1
            if b - k == 1 and t.kind(k) == "name":
                self.reads(t[k].text, scope, k)
            elif t.kind(k) in ("name", "string", "number") and t.is_(k + 1, ":"):
                self.expression(k + 2, b, scope)
            elif t.kind(k) == "name" and t.is_(k + 1, "(") and t.is_(t[k + 1].match + 1, "{"):
                self.parameters(k + 2, t[k + 1].match, scope)
                self.block(t[k + 1].match + 2, min(t[t[k + 1].match + 1].match, b), scope)
            else:
                self.block(a, b, scope)
        return stop + 1

    def access(self, first: int, i: int, end: int, scope: Scope, new: bool = False) -> int:
        """A chain ``a.b.c`` and what is done with it: call, assignment or read."""
        t = self.t
        parts, k = [t[i].text], i + 1
        while t.is_(k, ".", "?.") and t.kind(k + 1) == "name" and k + 1 < end:
            parts.append(t[k + 1].text)
            k += 2
        root = parts[0]
        after = self.type_parameters(k) if self.typed or new else k
        if t.is_(after, "(") and after < end or (t.is_(k, "?.") and t.is_(k + 1, "(")):
            paren = after if t.is_(after, "(") else k + 1
            self.call(first, parts, paren, end, scope)
            self.followed(root, scope, i, len(parts))
            self.arguments(paren, end, scope)
            return t.over(paren)
        if k < end and t.kind(k) == "punct" and t[k].text in ASSIGN:
            return self.assignment(i, parts, k, end, scope)
        if new:
            self.called(first, ".".join(parts), k, scope, [])
        self.followed(root, scope, i, len(parts))
        return k

    def followed(self, root: str, scope: Scope, i: int, n: int) -> None:
        if root not in ("this", "super"):
            self.reads(root, scope, i, i + 2 * n - 1)

    def call(self, first: int, parts: list[str], paren: int, end: int, scope: Scope) -> None:
        if parts == ["require"] and self.t.kind(paren + 1) == "string":
            if not self.t.is_(first - 1, "="):
                self.imports(self.t[paren + 1].text.strip("'\"`"), first, min(self.t[paren].match + 1, end))
            return
        if len(parts) > 1 and parts[-1] in INDIRECT:
            parts = parts[:-1]
        self.called(first, ".".join(parts), self.t[paren].match + 1, scope, self.described(paren, end))

    def called(self, first: int, name: str, stop: int, scope: Scope, args: list[dict]) -> None:
        found = self.facts.resolve(name, scope)
        if found is None and name.startswith("this."):
            for k in range(len(scope), 0, -1):
                if self.facts.nodes.get(self.facts.id(*scope[:k]), {}).get("kind") == "Class":
                    own = self.facts.id(*scope[:k], name.removeprefix("this."))
                    found = own if own in self.facts.nodes else None
                    break
        target = found or (self.facts.external(name, self.t.at(first)) if self.linking else "")
        self.edge("calls", self.owner(scope), target, first, stop, args=args, unknown=None if found else True)

    def described(self, paren: int, end: int) -> list[dict]:
        """Arguments by position, counted without separators."""
        t, out = self.t, []
        for n, (a, b) in enumerate(t.split(paren + 1, min(t[paren].match, end))):
            spread = t.is_(a, "...")
            a += spread
            simple = t.kind(a) == "name" and t[a].text not in KEYWORDS
            if simple and b - a == 1:
                out.append({"index": n, "name": t[a].text, "kind": "starred" if spread else "name"})
            elif simple and all(t.is_(k, ".") if (k - a) % 2 else t.kind(k) == "name" for k in range(a, b)):
                out.append({"index": n, "name": t[a].text, "kind": "attr", "full": t.text(a, b)})
            else:
                out.append({"index": n, "name": "", "kind": "other"})
        return out

    def arguments(self, paren: int, end: int, scope: Scope) -> None:
        for a, b in self.t.split(paren + 1, min(self.t[paren].match, end)):
            self.expression(a, b, scope)

    def assignment(self, i: int, parts: list[str], op: int, end: int, scope: Scope) -> int:
        t = self.t
        stop = self.operand_end(op + 1, end)
        owner, root = self.owner(scope), parts[0]
        exported = parts[:2] == ["module", "exports"] or root == "exports"
        if exported:
            name = parts[-1] if parts[-1] != "exports" else ""
            if t.is_(op + 1, "{"):
                self.object_(op + 1, end, scope)
                return t.over(op + 1)
            if name and (t.is_(op + 1, "function", "async") or self.arrow(op + 1, stop) is not None):
                node = self.node("Function", name, scope, i, stop)
                self.edge("defines", owner, node, i, stop)
                self.edge("reads", self.facts.id(), node, i, stop)
                self.value(name, op + 1, stop, scope)
                return stop
            if name and (found := self.facts.resolve(name, scope)):
                self.edge("reads", self.facts.id(), found, i, stop)
        elif len(parts) > 1 and root not in ("this", "super") and (t.is_(op + 1, "function") or (t.is_(op + 1, "async") and t.is_(op + 2, "function"))):
            inner = tuple(p for p in parts[:-1] if p != "prototype")
            node = self.node("Function", parts[-1], inner, i, stop)
            self.edge("defines", self.facts.resolve(".".join(inner), ()) or owner, node, i, stop)
            self.value(parts[-1], op + 1, stop, inner)
            return stop
        elif len(parts) > 1:
            if found := self.facts.resolve(root, scope):
                self.edge("writes", owner, found, i, stop)
        elif found := self.facts.resolve(root, scope):
            self.edge("assigns", owner, found, i, stop)
        if module := self.required(op + 1, stop):
            self.imports(module, i, stop)
        self.value(None, op + 1, stop, scope)
        return stop


def t_is(tokens: Tokens, i: int, text: str) -> bool:
    return tokens.kind(i) == "name" and tokens[i].text == text
