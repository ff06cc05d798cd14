"""Syntax facts of one source file; the rules over them are DataFrame code.

A fact is a dict; ``FACTS`` is its schema. Facts carry ``seq``, their order in
the file. Every parser is tolerant: broken code yields the facts that can be read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from orrery.sources.lexer import VAR, Token, tokens

FACTS = (
    "fact string, kind string, name string, receiver string, decl string, form string, operand string, operand_last string,"
    " value string, rel string, target string, base string, methods array<string>,"
    " args array<struct<kind:string,lit:string,raw:string,has_lit:boolean,text:string,items:array<string>>>"
)
FIELDS = ["fact", "kind", "name", "receiver", "decl", "form", "operand", "operand_last", "value", "rel", "target", "base", "methods", "args"]
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "func", "function", "sizeof", "typeof", "nameof", "lock", "using", "foreach", "fixed", "synchronized", "super", "this", "await", "throw", "case", "select", "range", "import", "when", "base", "in", "of", "else", "try", "do", "and", "or", "not"}


def fact(kind_of: str, **fields) -> dict:
    return {f: fields.get(f) for f in FIELDS} | {"fact": kind_of}


def arg(kind: str, text: str, lit: str | None = None, raw: str | None = None, has_lit: bool = False, items: list[str] | None = None) -> dict:
    return {"kind": kind, "lit": lit, "raw": raw if raw is not None else VAR, "has_lit": has_lit, "text": text, "items": items}


class Source:
    """Tokens of a file, with readers for the shapes that facts need."""

    def __init__(self, src: str, lang: str):
        self.src, self.lang = src, lang
        self.t = tokens(src, lang)
        self.decl_names: set[int] = set()
        self.bodies: list[tuple[int, int, str]] = []

    def text(self, a: int, b: int) -> str:
        """Source of tokens a to b, b excluded."""
        return self.src[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind != "str" and self.t[i].text in texts

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def close(self, i: int) -> int:
        """Index of the bracket that closes the one at i."""
        return min(self.t[i].pair if self.t[i].pair >= 0 else len(self.t), len(self.t))

    def parts(self, a: int, b: int, by: str = ",") -> list[tuple[int, int]]:
        """Token ranges between ``by`` at this depth."""
        out, begin, i = [], a, a
        while i < b:
            if self.t[i].kind == "other" and self.t[i].text in "([{" and self.t[i].pair > i:
                i = min(self.t[i].pair, b)
            elif self.is_(i, by):
                out.append((begin, i))
                begin = i + 1
            i += 1
        if begin < b or out:
            out.append((begin, b))
        return [x for x in out if x[1] > x[0]]

    def args(self, i: int) -> list[dict]:
        """Arguments of the call whose bracket opens at i."""
        out = []
        for a, b in self.parts(i + 1, self.close(i)):
            if self.lang == "csharp" and self.kind(a) == "id" and self.is_(a + 1, ":"):
                a += 2
            if a < b:
                out.append(self.arg(a, b))
        return out

    def arg(self, a: int, b: int) -> dict:
        text, one = self.text(a, b), self.t[a]
        if b - a == 1 and one.kind == "str":
            static = one.value is not None and not one.template
            return arg("lit" if static else "template", text, one.value if static else None, one.raw, one.literal)
        pieces = self.parts(a, b, "+")
        if len(pieces) > 1 and not self._has_operator(a, b):
            raw = "".join(self.t[x].raw if y - x == 1 and self.t[x].kind == "str" else VAR for x, y in pieces)
            return arg("concat", text, None, raw, any(y - x == 1 and self.t[x].literal for x, y in pieces))
        if self.is_(a, "new") and self.kind(a + 1) == "id":
            j, name = self.dotted(a + 1)
            j = self.skip_generic(j)
            return arg("new", name.split(".")[-1], items=[x["lit"] for x in self.args(j)[:1] if x["kind"] == "lit"] if self.is_(j, "(") else [])
        if self.is_(a, "[") or (self.lang == "java" and self.is_(a, "{")):
            inner = self.parts(a + 1, self.close(a))
            return arg("list", text, items=[self.t[x].value for x, y in inner if y - x == 1 and self.t[x].kind == "str" and self.t[x].value is not None])
        if self.is_(a, "{") and self.lang in ("typescript", "javascript"):
            return arg("object", text, items=[v for k, v in self.properties(a) if k == "topic"])
        return arg("other", text)

    def _has_operator(self, a: int, b: int) -> bool:
        i = a
        while i < b:
            if self.t[i].kind == "other" and self.t[i].text in "([{" and self.t[i].pair > i:
                i = self.t[i].pair
            elif self.t[i].kind == "other" and self.t[i].text in ("?", ":", "&&", "||", "==", "!=", "-", "*", "/", "%", "=>", "="):
                return True
            i += 1
        return False

    def properties(self, i: int) -> list[tuple[str, str]]:
        """Static string properties of the braces at i."""
        out = []
        for a, b in self.parts(i + 1, self.close(i)):
            if b - a == 3 and self.is_(a + 1, ":") and self.kind(a + 2) == "str" and self.t[a + 2].value is not None and not self.t[a + 2].template:
                out.append((self.t[a].value if self.kind(a) == "str" else self.t[a].text, self.t[a + 2].value))
        return out

    def dotted(self, i: int) -> tuple[int, str]:
        """A dotted name from i on, and the index behind it."""
        name = self.t[i].text
        while self.is_(i + 1, ".") and self.kind(i + 2) == "id":
            i += 2
            name += "." + self.t[i].text
        return i + 1, name

    def skip_generic(self, i: int) -> int:
        """Index behind <...> if it opens at i and reads like type arguments."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < min(len(self.t), i + 60):
            depth += {"<": 1, ">": -1}.get(self.t[j].text, 0) if self.kind(j) == "other" else 0
            if not depth:
                return j + 1
            if self.kind(j) == "other" and self.t[j].text not in ("<", ">", ",", ".", "[", "]", "?", "|", "&", "*"):
                return i
            j += 1
        return i

    def operand(self, dot: int) -> tuple[str, str]:
        """Text of what stands before the dot, and its last segment."""
        i = dot - 1
        while i >= 0:
            if self.is_(i, ")", "]", "}") and 0 <= self.t[i].pair < i:
                i = self.t[i].pair - 1
                if self.kind(i) == "id" and self.t[i].text not in ("return", "await", "new", "in", "of"):
                    continue
                if self.is_(i, ")", "]"):
                    continue
                i += 1
                break
            if self.kind(i) in ("id", "str", "num"):
                if self.is_(i - 1, ".", "?.") or (self.lang != "go" and self.is_(i - 1, "::")):
                    i -= 2
                    continue
                break
            i += 1
            break
        i = max(i, 0)
        if self.is_(i - 1, "new"):
            i -= 1
        last = self.t[dot - 1]
        return self.text(i, dot), last.text if last.kind == "id" else ""

    def enclosing(self, i: int) -> str | None:
        """Innermost declaration whose body holds token i."""
        best = None
        for a, b, name in self.bodies:
            if a < i < b and (best is None or a > best[0]):
                best = (a, name)
        return best[1] if best else None

    def calls(self) -> Iterator[dict]:
        """Calls, constructions, subscripts, members and static strings, in source order."""
        t = self.t
        for i, x in enumerate(t):
            if x.kind == "str":
                if x.value is not None and not (self.lang == "csharp" and x.template):
                    yield fact("string", value=x.value)
                continue
            if x.kind != "id":
                continue
            member = self.is_(i - 1, ".", "?.")
            if x.text == "new" and not member and self.kind(i + 1) == "id" and self.lang != "go":
                j, name = self.dotted(i + 1)
                j = self.skip_generic(j)
                if self.is_(j, "("):
                    yield fact("call", form="new", name=name.split(".")[-1], value=name, args=self.args(j), decl=self.enclosing(i))
                continue
            if self.lang in ("typescript", "javascript") and x.text == "process" and not member and self.is_(i + 1, ".") and self.is_(i + 2, "env"):
                if self.is_(i + 3, ".") and self.kind(i + 4) == "id":
                    yield fact("call", form="member", operand="process.env", name=t[i + 4].text)
                elif self.is_(i + 3, "[") and self.kind(i + 4) == "str" and t[i + 4].value is not None and not t[i + 4].template:
                    yield fact("call", form="subscript", operand="process.env", name=t[i + 4].value)
            if self.lang == "csharp" and self.is_(i + 1, "[") and self.kind(i + 2) == "str" and self.is_(i + 3, "]") and t[i + 2].value is not None:
                yield fact("call", form="subscript", operand_last=x.text, name=t[i + 2].value)
            if i in self.decl_names or x.text in NOT_CALLS and not member:
                continue
            j = i + 1
            if self.lang in ("typescript", "javascript"):
                j = self.skip_generic(j)
            if self.is_(j, "?.") and self.is_(j + 1, "("):
                j += 1
            if not self.is_(j, "(") or self._is_new(i) or self.is_(i - 1, "@"):
                continue
            operand, last = self.operand(i - 1) if member else ("", "")
            yield fact("call", form="call", name=x.text, operand=operand, operand_last=last, args=self.args(j), decl=self.enclosing(i))

    def _is_new(self, i: int) -> bool:
        while self.is_(i - 1, ".") and self.kind(i - 2) == "id":
            i -= 2
        return self.is_(i - 1, "new")


def go_facts(src: str) -> Iterator[dict]:
    s = Source(src, "go")
    t, i, out = s.t, 0, []
    while i < len(t):
        if s.is_(i, "import"):
            end = s.close(i + 1) if s.is_(i + 1, "(") else next((k for k in (i + 1, i + 2) if s.kind(k) == "str"), i)
            out += [fact("import", value=x.value) for x in t[i + 1 : end + 1] if x.kind == "str"]
            i = end
        elif s.is_(i, "func"):
            j, receiver = i + 1, None
            if s.is_(j, "("):
                inner = s.text(j + 1, s.close(j)).split()
                receiver = inner[-1].removeprefix("*") if inner else ""
                typed = re.match(r"(?s)(?:\w+\s+)?\*?(.+)\Z", s.text(j + 1, s.close(j)).strip())
                receiver = typed[1].strip() if typed else receiver
                j = s.close(j) + 1
            if s.kind(j) != "id":
                i += 1
                continue
            s.decl_names.add(j)
            name = t[j].text if receiver is None else f"{receiver}.{t[j].text}"
            k = j + 1
            while k < len(t) and not s.is_(k, "{") and not (t[k].kind == "id" and t[k].text in ("func", "type", "var", "const") and "\n" in src[t[k - 1].end : t[k].start]):
                k = s.close(k) + 1 if s.is_(k, "(", "[") else k + (2 if s.is_(k, "interface", "struct") and s.is_(k + 1, "{") and s.is_(s.close(k + 1), "}") else 1)
            out.append(fact("decl", kind="function" if receiver is None else "method", name=name, receiver=receiver))
            if s.is_(k, "{"):
                s.bodies.append((k, s.close(k), name))
                i = s.close(k)
            else:
                i = k
                continue
        elif s.is_(i, "type"):
            specs = _spec_starts(s, i + 1) if s.is_(i + 1, "(") else [i + 1]
            for j in specs:
                if s.kind(j) != "id":
                    continue
                k = j + 1
                if s.is_(k, "[") and s.kind(k + 1) == "id" and not s.is_(s.close(k) + 1, "]"):
                    k = s.close(k) + 1
                if not s.is_(k, "="):
                    out.append(fact("decl", kind="interface" if s.is_(k, "interface") else "class", name=t[j].text))
            i = s.close(i + 1) if s.is_(i + 1, "(") else i + 1
        elif t[i].kind == "other" and t[i].text in "([{" and t[i].pair > i:
            i = t[i].pair
        i += 1
    yield from out
    yield from s.calls()
    for i, x in enumerate(t):
        if x.kind == "id" and s.is_(i + 1, "{") and not s.is_(i - 1, "interface"):
            topic = next((v for k, v in s.properties(i + 1) if k in ("Topic", "topic")), None)
            if topic is not None:
                yield fact("call", form="composite", name=x.text, value=topic)


def _spec_starts(s: Source, i: int) -> list[int]:
    out, j, end = [], i + 1, s.close(i)
    while j < end:
        if s.kind(j) == "id" and (j == i + 1 or "\n" in s.src[s.t[j - 1].end : s.t[j].start] or s.is_(j - 1, ";")):
            out.append(j)
        j = s.close(j) + 1 if s.t[j].kind == "other" and s.t[j].text in "([{" else j + 1
    return out


def ts_facts(src: str, lang: str) -> Iterator[dict]:
    s = Source(src, lang)
    t, out, i = s.t, [], 0
    while i < len(t):
        if s.is_(i, "import") and not s.is_(i + 1, "("):
            j = i + 1
            while j < len(t) and t[j].kind != "str" and not s.is_(j, ";"):
                j = s.close(j) if s.is_(j, "{") else j
                j += 1
            if s.kind(j) == "str" and t[j].value is not None:
                out.append(fact("import", value=t[j].value))
            i = j
        elif s.is_(i, "export", "default", "declare", "async", "abstract"):
            pass
        elif s.is_(i, "class") and s.kind(i + 1) == "id":
            name, j = t[i + 1].text, s.skip_generic(i + 2)
            out.append(fact("decl", kind="class", name=name))
            rel, first = None, True
            while j < len(t) and not s.is_(j, "{"):
                if s.is_(j, "extends", "implements"):
                    rel, first = ("inherits" if t[j].text == "extends" else "implements"), True
                elif rel and s.kind(j) == "id" and (rel == "implements" or first):
                    j2, full = s.dotted(j)
                    out.append(fact("heritage", decl=name, target=full.split(".")[-1], rel=rel, value=full))
                    j, first = s.skip_generic(j2), False
                    continue
                elif s.is_(j, "("):
                    j = s.close(j)
                j += 1
            if j < len(t):
                out += _ts_members(s, j, name)
                i = s.close(j)
        elif s.is_(i, "interface") and s.kind(i + 1) == "id" and lang == "typescript":
            out.append(fact("decl", kind="interface", name=t[i + 1].text))
        elif s.is_(i, "function"):
            j = i + 2 if s.is_(i + 1, "*") else i + 1
            if s.kind(j) == "id":
                s.decl_names.add(j)
                out.append(fact("decl", kind="function", name=t[j].text))
                body = _body(s, j + 1)
                if body is not None:
                    s.bodies.append((body, s.close(body), t[j].text))
                    i = s.close(body)
        elif t[i].kind == "other" and t[i].text in "([{" and t[i].pair > i:
            i = t[i].pair
        i += 1
    yield from out
    yield from s.calls()


def _body(s: Source, j: int) -> int | None:
    """Index of the brace that opens the body behind a parameter list."""
    j = s.skip_generic(j)
    if not s.is_(j, "("):
        return None
    j = s.close(j) + 1
    typed = s.is_(j, ":")
    while j < len(s.t) and not s.is_(j, ";", "=>", "="):
        if s.is_(j, "{"):
            if not (typed and s.is_(j - 1, ":", "|", "&")):
                return j
            j = s.close(j)
        elif s.is_(j, "(", "["):
            j = s.close(j)
        elif s.is_(j, "}", ")"):
            return None
        j += 1
    return None


def _ts_members(s: Source, brace: int, name: str) -> list[dict]:
    out, j, end = [], brace + 1, s.close(brace)
    while j < end:
        x = s.t[j]
        if x.kind == "id" and not s.is_(j - 1, "@", ".") and x.text not in NOT_CALLS and s.is_(s.skip_generic(j + 1), "("):
            body = _body(s, j + 1)
            if body is not None and body < end:
                s.decl_names.add(j)
                full = f"{name}.{x.text}"
                out.append(fact("decl", kind="method", name=full, receiver=name))
                s.bodies.append((body, s.close(body), full))
                j = s.close(body) + 1
                continue
        if s.is_(j, "="):
            while j < end and not s.is_(j, ";"):
                if "\n" in s.src[s.t[j - 1].end : s.t[j].start] and not s.is_(j - 1, "=", "(", ",", "=>"):
                    j -= 1
                    break
                j = s.close(j) + 1 if s.t[j].kind == "other" and s.t[j].text in "([{" else j + 1
        elif x.kind == "other" and x.text in "([{":
            j = s.close(j)
        j += 1
    return out


JAVA_TYPES = {"class": "class", "enum": "class", "record": "class", "interface": "interface"}
CSHARP_TYPES = {"class": "class", "struct": "class", "record": "class", "enum": "class", "interface": "interface"}


def c_like_facts(src: str, lang: str) -> Iterator[dict]:
    """Java and C#: types at any nesting, their methods, annotations and routes."""
    s = Source(src, lang)
    out: list[dict] = []
    for i, x in enumerate(s.t):
        if lang == "java" and s.is_(i, "import"):
            j = i + 2 if s.is_(i + 1, "static") else i + 1
            if s.kind(j) == "id":
                out.append(fact("import", value=s.dotted(j)[1]))
        if lang == "csharp" and s.is_(i, "using") and s.kind(i + 1) == "id" and not s.is_(i - 1, "await", "="):
            j, name = s.dotted(i + 2 if s.is_(i + 1, "static") else i + 1)
            if s.is_(j, "=") and s.kind(j + 1) == "id":
                j, name = s.dotted(j + 1)
            if s.is_(j, ";"):
                out.append(fact("import", value=name))
    _types(s, 0, len(s.t), "", out)
    yield from out
    yield from s.calls()
    if lang == "java":
        for i in range(len(s.t)):
            if s.is_(i, "@") and s.is_(i + 1, "KafkaListener"):
                yield fact("call", form="annotation", name="KafkaListener", methods=_annotation(s, i)[1].get("topics", {}).get("items") or [])


def _annotation(s: Source, i: int) -> tuple[str, dict[str, dict], int]:
    """Name, arguments by key ("" for the first positional) and index behind an annotation or attribute at i."""
    j, name = s.dotted(i) if s.kind(i) == "id" else s.dotted(i + 1)
    values: dict[str, dict] = {}
    if s.is_(j, "("):
        for a, b in s.parts(j + 1, s.close(j)):
            key = ""
            if s.kind(a) == "id" and s.is_(a + 1, "=", ":"):
                key, a = s.t[a].text, a + 2
            if a < b:
                got = s.arg(a, b)
                if got["kind"] == "lit":
                    got["items"] = [got["lit"]]
                values.setdefault(key, got)
        j = s.close(j) + 1
    return name.split(".")[-1], values, j


def _lit(values: dict[str, dict], *keys: str) -> str | None:
    return next((values[k]["lit"] for k in keys if k in values and values[k]["kind"] == "lit"), None)


def _types(s: Source, a: int, b: int, base: str, out: list[dict]) -> None:
    """Type declarations between tokens a and b (member depth), with namespaces entered."""
    types = JAVA_TYPES if s.lang == "java" else CSHARP_TYPES
    notes: list[tuple[str, dict]] = []
    j = a
    while j < b:
        if s.lang == "java" and s.is_(j, "@") and s.kind(j + 1) == "id" and not s.is_(j + 1, "interface"):
            name, values, j = _annotation(s, j)
            notes.append((name, values))
            continue
        if s.lang == "csharp" and s.is_(j, "["):
            notes += _attributes(s, j)
            j = s.close(j) + 1
            continue
        if s.is_(j, "namespace") and s.lang == "csharp":
            k = s.dotted(j + 1)[0]
            if s.is_(k, "{"):
                _types(s, k + 1, s.close(k), base, out)
                j = s.close(k) + 1
                continue
            j = k
        elif s.kind(j) == "id" and s.t[j].text in types and s.kind(j + 1) == "id" and not s.is_(j - 1, "."):
            j = _type(s, j, types[s.t[j].text], base, notes, out)
            notes = []
            continue
        elif s.is_(j, ";"):
            notes = []
        elif s.t[j].kind == "other" and s.t[j].text in "([{" and s.t[j].pair > j:
            j = s.t[j].pair
            notes = []
        j += 1


def _attributes(s: Source, i: int) -> list[tuple[str, dict]]:
    out = []
    for a, _ in s.parts(i + 1, s.close(i)):
        if s.is_(a + 1, ":"):
            a += 2
        if s.kind(a) == "id":
            name, values, _ = _annotation(s, a)
            out.append((name.removesuffix("Attribute"), values))
    return out


def _type(s: Source, i: int, kind: str, base: str, notes: list, out: list[dict]) -> int:
    if s.lang == "csharp" and s.is_(i, "record") and s.is_(i + 1, "struct", "class"):
        i += 1
    name, j = s.t[i + 1].text, s.skip_generic(i + 2)
    out.append(fact("decl", kind=kind, name=name))
    if s.lang == "java":
        own = base + next((p for n, v in notes if n == "RequestMapping" and (p := _lit(v, "", "value") or _lit(v, "path"))), "")
    else:
        own = next((p for n, v in notes if n == "Route" and (p := _lit(v, "")) and p.startswith("/")), "")
    rel = None
    while j < len(s.t) and not s.is_(j, "{", ";"):
        if s.lang == "java" and s.is_(j, "extends", "implements", "permits"):
            rel = {"extends": "inherits" if kind == "class" else None, "implements": "implements"}.get(s.t[j].text)
        elif s.lang == "csharp" and s.is_(j, ":"):
            rel = "base"
        elif s.lang == "csharp" and s.is_(j, "where"):
            rel = None
        elif s.is_(j, "("):
            j = s.close(j)
        elif rel and s.kind(j) == "id":
            k, full = s.dotted(j)
            last = full.split(".")[-1]
            how = ("implements" if re.match("I[A-Z]", last) else "inherits") if rel == "base" else rel
            out.append(fact("heritage", decl=name, target=last, rel=how, value=full))
            j = s.skip_generic(k)
            continue
        j += 1
    if j >= len(s.t) or s.is_(j, ";"):
        return j + 1
    known = len(s.bodies)
    enum = s.lang == "java" and s.is_(i, "enum")
    _members(s, j, name, own, [] if enum else out)
    if enum:  # what a Java enum holds is no declaration
        del s.bodies[known:]
    return s.close(j) + 1


def _members(s: Source, brace: int, name: str, base: str, out: list[dict]) -> None:
    types = JAVA_TYPES if s.lang == "java" else CSHARP_TYPES
    notes: list[tuple[str, dict]] = []
    j, end = brace + 1, s.close(brace)
    while j < end:
        x = s.t[j]
        if s.lang == "java" and s.is_(j, "@") and s.kind(j + 1) == "id" and not s.is_(j + 1, "interface"):
            n, values, j = _annotation(s, j)
            notes.append((n, values))
            continue
        if s.lang == "csharp" and s.is_(j, "[") and s.is_(j - 1, "{", "}", ";", "]"):
            notes += _attributes(s, j)
            j = s.close(j) + 1
            continue
        if x.kind == "id" and x.text in types and s.kind(j + 1) == "id" and not s.is_(j - 1, ".", "=", "("):
            j = _type(s, j, types[x.text], base if s.lang == "java" else "", notes, out)
            notes = []
            continue
        open_ = s.skip_generic(j + 1)
        if x.kind == "id" and s.is_(open_, "(") and x.text not in NOT_CALLS and not s.is_(j - 1, ".", "=", "new", "@"):
            k = s.close(open_) + 1
            while k < end and not s.is_(k, "{", ";", "=>", "=", ","):
                k = s.close(k) + 1 if s.is_(k, "(", "[") else k + 1
            typed = s.kind(j - 1) == "id" and s.t[j - 1].text not in ("public", "private", "protected", "internal", "static") or s.is_(j - 1, ">", "]", "?")
            s.decl_names.add(j)
            full = f"{name}.{x.text}"
            if typed and x.text != name:
                out.append(fact("decl", kind="method", name=full, receiver=name))
                out += _routes(s, notes, base)
            notes = []
            if s.is_(k, "{"):
                if typed and x.text != name:
                    s.bodies.append((k, s.close(k), full))
                j = s.close(k) + 1
                continue
            if s.is_(k, "=>"):
                stop = k
                while stop < end and not s.is_(stop, ";"):
                    stop = s.close(stop) + 1 if s.t[stop].kind == "other" and s.t[stop].text in "([{" else stop + 1
                s.bodies.append((k, stop, full))
                k = stop
            j = k + 1
            continue
        if s.is_(j, "=") or s.is_(j, "=>"):
            while j < end and not s.is_(j, ";"):
                j = s.close(j) + 1 if s.t[j].kind == "other" and s.t[j].text in "([{" else j + 1
            notes = []
        elif s.is_(j, ";"):
            notes = []
        elif x.kind == "other" and x.text in "([{":
            j = s.close(j)
            notes = []
        j += 1


def _routes(s: Source, notes: list, base: str) -> list[dict]:
    out = []
    if s.lang == "java":
        for n, v in notes:
            path = _lit(v, "", "value")
            path = path if path is not None else _lit(v, "path")
            method = v["method"]["lit"] or v["method"]["text"] if "method" in v else None
            if re.fullmatch("(Get|Post|Put|Delete|Patch|Request)Mapping", n):
                out.append(fact("route", name=n, target=method, base=base, value=path or ""))
        return out
    verb = [(n[4:].upper(), v) for n, v in notes if n in ("HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "HttpHead", "HttpOptions")]
    if verb:
        path = next((p for _, v in reversed(verb) if (p := _lit(v, "")) is not None), None)
        path = path if path is not None else next((p for n, v in notes if n == "Route" and (p := _lit(v, "")) is not None), "")
        out.append(fact("route", name=verb[-1][0], base=base, value=path))
    return out


def proto_facts(src: str) -> Iterator[dict]:
    s = Source(src, "protobuf")
    package = next((s.dotted(i + 1)[1] for i in range(len(s.t) - 1) if s.is_(i, "package") and s.kind(i + 1) == "id"), None)
    i = 0
    while i < len(s.t):
        if s.is_(i, "service") and s.kind(i + 1) == "id" and s.is_(i + 2, "{"):
            end = s.close(i + 2)
            rpcs = [s.t[j + 1].text for j in range(i + 3, end) if s.is_(j, "rpc") and s.kind(j + 1) == "id"]
            yield fact("schema", name=s.t[i + 1].text, value=package, methods=rpcs)
            i = end
        elif s.is_(i, "{"):
            i = s.close(i)
        i += 1


def top_blocks(lines: list[str]) -> list[int]:
    """Line numbers at which top-level statements begin: text at column 0 outside strings and brackets.

    A line that opens a statement ends brackets left open before it.
    """
    begins, depth, quote = [], 0, ""
    decorated = False
    for k, line in enumerate(lines):
        starts = re.match(r"(@|(async\s+def|def|class|import|from|if|for|while|with|try)\b)", line)
        if not quote and starts:
            depth = 0
        goes_on = re.match(r"(else|elif|except|finally)\b", line)
        if not quote and depth == 0 and line[:1] not in ("", " ", "\t", "#", "\r", "\f") and not goes_on:
            if not decorated:
                begins.append(k)
            decorated = line.startswith("@")
        for piece in re.finditer(r"\\.|\"\"\"|\'\'\'|\"(?:\\.|[^\"\\])*\"|\'(?:\\.|[^\'\\])*\'|#.*|[\[\](){}]", line) if not quote else ():
            found = piece.group()
            if found in ('\"\"\"', "\'\'\'"):
                rest = line[piece.end() :]
                if found not in rest:
                    quote = found
                    break
            elif found in "([{":
                depth += 1
            elif found in ")]}":
                depth = max(0, depth - 1)
        else:
            if quote and quote in line:
                quote = ""
            continue
    return begins


def python_tree(src: str) -> ast.Module:
    """The module's tree. Where it doesn't parse, each top-level statement is read by itself, and loses the lines that don't parse."""
    try:
        return ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        lines = src.replace("\0", " ").split("\n")
    body = []
    edges = [*top_blocks(lines), len(lines)]
    for begin, end in zip(edges, edges[1:], strict=False):
        block = lines[begin:end]
        while any(x.strip() not in ("", "pass") for x in block):  # each turn takes a line away
            try:
                tree = ast.parse("\n".join(block))
                body += ast.increment_lineno(tree, begin).body
                break
            except SyntaxError as e:
                at = min(max((e.lineno or 1) - 1, 0), len(block) - 1)
                if block[at].strip() in ("", "pass"):
                    at = next((k for k in (*range(at - 1, -1, -1), *range(len(block) - 1, at, -1)) if block[k].strip() not in ("", "pass")), 0)
                indent = block[at][: len(block[at]) - len(block[at].lstrip())]
                block[at] = indent + "pass"
            except (ValueError, RecursionError):
                break
    return ast.Module(body, [])


def python_facts(src: str) -> Iterator[dict]:
    tree = python_tree(src)
    text = lambda n: ast.get_source_segment(src, n) or ast.unparse(n)
    static = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    owner: dict[ast.AST, str] = {}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def own(node: ast.AST, name: str) -> None:
        for x in ast.walk(node):
            owner[x] = name

    for node in tree.body:
        if isinstance(node, functions):
            yield fact("decl", kind="function", name=node.name)
            for x in node.body:
                own(x, node.name)
        elif isinstance(node, ast.ClassDef):
            yield fact("decl", kind="class", name=node.name)
            for b in node.bases:
                if isinstance(b, (ast.Name, ast.Attribute)):
                    yield fact("heritage", decl=node.name, target=b.id if isinstance(b, ast.Name) else b.attr, rel="inherits", value=ast.unparse(b))
            for m in node.body:
                if isinstance(m, functions):
                    name = f"{node.name}.{m.name}"
                    yield fact("decl", kind="method", name=name, receiver=node.name)
                    for x in m.body:
                        own(x, name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield fact("import", value=a.name)
        elif isinstance(node, ast.ImportFrom):
            yield fact("import", value="." * node.level + (node.module or ""))

    def pieces(n: ast.AST) -> tuple[str, bool]:
        if static(n) is not None:
            return n.value, n.value != ""
        if isinstance(n, ast.JoinedStr):
            got = [pieces(v) for v in n.values]
            return "".join(g[0] for g in got), any(g[1] for g in got)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
            (a, x), (b, y) = pieces(n.left), pieces(n.right)
            return a + b, x or y
        return VAR, False

    def read(n: ast.AST) -> dict:
        raw, has = pieces(n)
        if static(n) is not None:
            return arg("lit", text(n), n.value, raw, has)
        if isinstance(n, ast.List):
            return arg("list", text(n), items=[v for v in map(static, n.elts) if v is not None])
        return arg("template" if isinstance(n, ast.JoinedStr) else "concat" if isinstance(n, ast.BinOp) else "other", text(n), None, raw, has)

    def call(n: ast.Call, form: str) -> dict | None:
        if isinstance(n.func, ast.Name):
            name, operand = n.func.id, ""
        elif isinstance(n.func, ast.Attribute):
            name, operand = n.func.attr, text(n.func.value)
        else:
            name, operand = "", ""
        methods = next(([v for v in map(static, k.value.elts) if v is not None] for k in n.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), None)
        return fact("call", form=form, name=name, operand=operand, operand_last=operand.split(".")[-1], args=[read(a) for a in n.args], methods=methods, decl=owner.get(n))

    order = lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0))
    inside = {id(v) for n in ast.walk(tree) if isinstance(n, ast.JoinedStr) for v in n.values}
    for n in sorted(ast.walk(tree), key=order):
        if isinstance(n, (*functions, ast.ClassDef)):
            for d in n.decorator_list:
                if isinstance(d, ast.Call):
                    yield call(d, "decorator")
        elif isinstance(n, ast.Call):
            yield call(n, "call")
        elif isinstance(n, ast.Subscript) and static(n.slice) is not None:
            yield fact("call", form="subscript", operand=text(n.value), name=n.slice.value)
        elif static(n) is not None and id(n) not in inside:
            yield fact("string", value=n.value)


def facts(src: str, lang: str) -> list[dict]:
    """All facts of a file, in order."""
    got = {
        "go": lambda: go_facts(src),
        "python": lambda: python_facts(src),
        "typescript": lambda: ts_facts(src, "typescript"),
        "javascript": lambda: ts_facts(src, "javascript"),
        "java": lambda: c_like_facts(src, "java"),
        "csharp": lambda: c_like_facts(src, "csharp"),
        "protobuf": lambda: proto_facts(src),
    }.get(lang)
    return list(got()) if got else []


__all__ = ["FACTS", "FIELDS", "Token", "facts"]
