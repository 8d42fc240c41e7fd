"""Facts of Go source from tokens, in two walks of the same rules: declarations, then uses."""

from __future__ import annotations

from graphspark.extract.facts import Facts, Scope
from graphspark.extract.lexer import Tokens

# Words that are no symbols.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


def extract(facts: Facts) -> None:
    tokens = Tokens(facts.source, "go")
    for linking in (False, True):
        _Walk(facts, tokens, linking).file()


class _Walk:
    def __init__(self, facts: Facts, tokens: Tokens, linking: bool):
        self.facts, self.t, self.linking = facts, tokens, linking

    def node(self, kind: str, name: str, scope: Scope, a: int, b: int | None = None, annotation: str = "", is_param: bool = False) -> str:
        return self.facts.node(kind, name, scope, self.t.at(a), self.t.end((b or a + 1) - 1), annotation, is_param)

    def edge(self, kind: str, source: str, target: str, a: int, b: int, **meta: object) -> None:
        if self.linking:
            self.facts.edge(kind, source, target, self.t.at(a), self.t.text(a, b), **meta)

    def owner(self, scope: Scope) -> str:
        return self.facts.id(*scope)

    def line_end(self, i: int, end: int) -> int:
        """Where a statement ends: a semicolon or a line end that no operator carries on."""
        t, start = self.t, i
        while i < end:
            if t.is_(i, ";") or (i > start and t[i].fresh and not (t[i - 1].kind == "punct" and t[i - 1].text not in (")", "]", "}", "++", "--"))):
                return i
            i = t.over(i)
        return min(i, end)

    def file(self) -> None:
        t, i = self.t, 0
        while i < len(t):
            word = t[i].text if t.kind(i) == "name" else ""
            if word == "import":
                i = self.group(i, self.import_)
            elif word == "func" and (t.kind(i + 1) == "name" or t.is_(i + 1, "(")):
                i = self.function(i)
            elif word == "type":
                i = self.group(i, lambda a, b: self.type_(a, b, ()))
            elif word in ("var", "const"):
                i = self.group(i, lambda a, b: self.variables(a, b, ()))
            else:
                i = t.over(i)

    def group(self, i: int, each) -> int:
        """``keyword spec`` or ``keyword ( spec ... )``."""
        t = self.t
        if t.is_(i + 1, "("):
            k, close = i + 2, min(t[i + 1].match, len(t))
            while k < close:
                stop = max(k + 1, self.line_end(k, close))
                each(k, stop)
                k = stop + t.is_(stop, ";")
            return close + 1
        stop = self.line_end(i + 1, len(t))
        each(i + 1, stop)
        return max(stop, i + 1)

    def import_(self, a: int, b: int) -> None:
        for k in range(a, b):
            if self.t.kind(k) == "string":
                path = self.t[k].text.strip('"`')
                self.edge("imports", self.facts.id(), self.facts.external(path, self.t.at(k)), k, k + 1)
                local = self.t[a].text if k > a and self.t.kind(a) == "name" and self.t[a].text != "_" else ""
                if local:
                    self.node("Variable", local, (), a)
                    self.edge("assigns", self.facts.id(), self.facts.id(local), a, b)

    def function(self, i: int) -> int:
        t, first = self.t, i
        scope: Scope = ()
        receiver: tuple[int, int] | None = None
        i += 1
        if t.is_(i, "("):
            receiver = (i + 1, min(t[i].match, len(t)))
            types = [t[k].text for k in range(*receiver) if t.kind(k) == "name"]
            generic = next((k for k in range(*receiver) if t.is_(k, "[")), receiver[1])
            types = [t[k].text for k in range(receiver[0], generic) if t.kind(k) == "name"] or types
            scope = (types[-1],) if types else ()
            i = t[i].match + 1
        if t.kind(i) != "name":
            return i
        name = t[i].text
        i += 1
        if t.is_(i, "["):
            i = t.over(i)
        if not t.is_(i, "("):
            return i
        close = min(t[i].match, len(t))
        body = close + 1
        while body < len(t) and not t.is_(body, "{") and not t[body].fresh:
            body = t.over(body) if not t.is_(body, "interface", "struct") else t.over(body + 1)
        stop = min(t[body].match, len(t) - 1) + 1 if t.is_(body, "{") else body
        node = self.node("Function", name, scope, first, stop, t.text(close + 1, body))
        self.edge("defines", self.owner(scope), node, first, stop)
        inner = (*scope, name)
        if receiver:
            self.parameters(*receiver, inner)
        self.parameters(i + 1, close, inner)
        if t.is_(body, "{"):
            self.block(body + 1, stop - 1, inner)
        return stop

    def parameters(self, a: int, b: int, scope: Scope) -> None:
        """``a, b int, c ...string``: names before the next type share it; a list of types alone has no names."""
        t = self.t
        parts = t.split(a, b)
        if not any(y - x > 1 and t.kind(x) == "name" and not t.is_(x + 1, ".") for x, y in parts):
            return
        pending: list[int] = []
        for x, y in parts:
            if t.kind(x) != "name":
                continue
            pending.append(x)
            if y - x > 1:
                for k in pending:
                    self.node("Variable", t[k].text, scope, k, None, t.text(x + 1, y).removeprefix("..."), is_param=True)
                pending = []

    def type_(self, a: int, b: int, scope: Scope) -> None:
        t = self.t
        if t.kind(a) != "name":
            return
        name, k = t[a].text, a + 1
        if t.is_(k, "[") and t.kind(k + 1) == "name" and t[k].match > k + 2:
            k = t.over(k)
        k += t.is_(k, "=")
        kind = "Class" if t.is_(k, "struct", "interface") else "TypeAlias"
        node = self.node(kind, name, scope, a, b, "" if kind == "Class" else t.text(k, b))
        self.edge("defines", self.owner(scope), node, a, b)
        if kind == "Class" and t.is_(k + 1, "{"):
            i, close = k + 2, min(t[k + 1].match, len(t))
            while i < close:
                stop = max(i + 1, self.line_end(i, close))
                if t.is_(k, "interface") and t.kind(i) == "name" and t.is_(i + 1, "("):
                    member = self.node("Function", t[i].text, (*scope, name), i, stop, t.text(t.over(i + 1), stop))
                    self.edge("defines", node, member, i, stop)
                    self.parameters(i + 2, min(t[i + 1].match, stop), (*scope, name, t[i].text))
                elif t.is_(k, "struct") and t.kind(i) == "name" and stop - i > 1 and not t.is_(i + 1, "."):
                    names, j = [i], i + 1
                    while t.is_(j, ",") and t.kind(j + 1) == "name":
                        names.append(j + 1)
                        j += 2
                    tag = stop - (t.kind(stop - 1) == "string")
                    for n in names:
                        self.edge("defines", node, self.node("Variable", t[n].text, (*scope, name), n, stop, t.text(j, tag)), n, stop)
                i = stop + t.is_(stop, ";")

    def variables(self, a: int, b: int, scope: Scope) -> None:
        t = self.t
        equals = next((k for k in self.top(a, b) if t.is_(k, "=")), b)
        names = [k for k in range(a, equals) if t.kind(k) == "name" and (k == a or t.is_(k - 1, ","))]
        kind = t.text(names[-1] + 1, equals) if names else ""
        for k in names:
            if t[k].text != "_":
                node = self.node("Variable", t[k].text, scope, k, None, kind)
                self.edge("assigns", self.owner(scope), node, a, b)
        self.expression(equals + 1, b, scope)

    def top(self, a: int, b: int):
        while a < b:
            yield a
            a = self.t.over(a)

    # Statements

    def block(self, i: int, end: int, scope: Scope) -> None:
        t = self.t
        while i < end:
            word = t[i].text if t.kind(i) == "name" else ""
            if word in ("var", "const"):
                i = self.group(i, lambda a, b: self.variables(a, b, scope))
            elif word == "type":
                i = self.group(i, lambda a, b: self.type_(a, b, scope))
            elif t.is_(i, "{"):
                stop = min(t[i].match, end)
                self.block(i + 1, stop, scope)
                i = stop + 1
            elif word in ("if", "for", "switch", "select", "else", "case", "default") or t.is_(i, ";", ":"):
                i = self.header(i, end, scope)
            elif word == "return":
                stop = self.line_end(i, end)
                for a, b in t.split(i + 1, stop):
                    if b - a == 1 and t.kind(a) == "name" and t[a].text not in KEYWORDS:
                        name = t[a].text
                        self.edge("returns", self.owner(scope), self.facts.resolve(name, scope) or self.facts.id(*scope, name), i, stop)
                self.expression(i + 1, stop, scope)
                i = max(stop, i + 1)
            else:
                stop = max(i + 1, self.line_end(i, end))
                self.simple(i, stop, scope)
                i = stop

    def header(self, i: int, end: int, scope: Scope) -> int:
        """What stands before the block of an if, for, switch or case."""
        t = self.t
        if t.is_(i, ";", ":", "else", "default"):
            return i + 1
        close = ":" if t.is_(i, "case") else "{"
        stop = i + 1
        while stop < end and not t.is_(stop, close):
            stop = t.over(stop)
        for a, b in t.split(i + 1, min(stop, end), ";"):
            self.simple(a, b, scope)
        return stop

    def simple(self, a: int, b: int, scope: Scope) -> None:
        """An assignment, a short declaration or an expression."""
        t = self.t
        op = next((k for k in self.top(a, b) if t.kind(k) == "punct" and t[k].text in ASSIGN), None)
        if op is None:
            self.expression(a, b, scope)
            return
        for x, y in t.split(a, op):
            name = t[x].text if t.kind(x) == "name" else ""
            if not name or name == "_" or name in KEYWORDS:
                self.expression(x, y, scope)
            elif y - x == 1:
                if t.is_(op, ":="):
                    self.node("Variable", name, scope, x)
                if found := self.facts.resolve(name, scope):
                    self.edge("assigns", self.owner(scope), found, a, b)
            elif found := self.facts.resolve(name, scope):
                self.edge("writes", self.owner(scope), found, a, b)
                self.expression(x + 1, y, scope)
        self.expression(op + 1, b, scope)

    # Expressions

    def expression(self, i: int, end: int, scope: Scope) -> None:
        end = min(end, len(self.t))
        while i < end:
            i = max(i + 1, self.term(i, end, scope))

    def term(self, i: int, end: int, scope: Scope) -> int:
        t = self.t
        if t.is_(i, "func") and t.kind(i) == "name" and t.is_(i + 1, "("):
            close = t[i + 1].match
            self.parameters(i + 2, min(close, end), scope)
            body = close + 1
            while body < end and not t.is_(body, "{"):
                body = t.over(body)
            if body >= end:
                return body
            self.block(body + 1, min(t[body].match, end), scope)
            return t.over(body)
        if t.kind(i) != "name" or t[i].text in KEYWORDS:
            return i + 1
        parts, k = [t[i].text], i + 1
        while t.is_(k, ".") and t.kind(k + 1) == "name" and k + 1 < end:
            parts.append(t[k + 1].text)
            k += 2
        if t.is_(k, ":") and len(parts) == 1 and not t.is_(i - 1, "case", "?"):
            return k + 1  # a key or a label
        if t.is_(k, "(") and k < end:
            self.called(i, parts, t.over(k), scope, self.described(k, end))
            self.read(parts[0], scope, i, k)
            self.expression(k + 1, min(t[k].match, end), scope)
            return t.over(k)
        if t.is_(k, "{") and k < end and self.literal(parts, i, scope):
            self.called(i, parts, t.over(k), scope, [])
            for a, b in t.split(k + 1, min(t[k].match, end)):
                self.expression(a, b, scope)
            return t.over(k)
        self.read(parts[0], scope, i, k)
        return k

    def literal(self, parts: list[str], i: int, scope: Scope) -> bool:
        """``T{...}``: a type that the file knows, an exported one, or one behind ``&`` or ``]``."""
        found = self.facts.resolve(parts[-1], ())
        known = found is not None and self.facts.nodes[found]["kind"] in ("Class", "TypeAlias")
        return known or self.t.is_(i - 1, "&", "]") or parts[-1][:1].isupper()

    def read(self, name: str, scope: Scope, i: int, k: int) -> None:
        if found := self.facts.resolve(name, scope):
            self.edge("reads", self.owner(scope), found, i, k)

    def called(self, i: int, parts: list[str], stop: int, scope: Scope, args: list[dict]) -> None:
        name = ".".join(parts)
        found = self.facts.resolve(name, scope)
        if found is None and len(parts) == 2 and scope:
            # A method of the receiver's own type.
            own = self.facts.nodes.get(self.facts.id(*scope, parts[0]))
            method = self.facts.id(scope[0], parts[1])
            if own and own["is_param"] and own["type_annotation"].lstrip("*").partition("[")[0] == scope[0] and method in self.facts.nodes:
                found = method
        target = found or (self.facts.external(name, self.t.at(i)) if self.linking else "")
        self.edge("calls", self.owner(scope), target, i, stop, args=args, unknown=None if found else True)

    def described(self, paren: int, end: int) -> list[dict]:
        t, out = self.t, []
        for n, (a, b) in enumerate(t.split(paren + 1, min(t[paren].match, end))):
            a += t.is_(a, "&", "*")
            spread = t.is_(b - 1, "...")
            b -= spread
            simple = t.kind(a) == "name" and t[a].text not in KEYWORDS
            if simple and b - a == 1:
                out.append({"index": n, "name": t[a].text, "kind": "starred" if spread else "name"})
            elif simple and all(t.is_(k, ".") if (k - a) % 2 else t.kind(k) == "name" for k in range(a, b)):
                out.append({"index": n, "name": t[a].text, "kind": "attr", "full": t.text(a, b)})
            else:
                out.append({"index": n, "name": "", "kind": "other"})
        return out
