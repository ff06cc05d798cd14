"""Tokens of Go, TypeScript/JavaScript, Java, C# and proto sources, with brackets matched.

The lexer never fails: what it can't read becomes a one-character token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

VAR = "\0VAR\0"
IDENT = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$]*")
NUMBER = re.compile(r"\d[\w.]*")
BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
CLOSES = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, other
    text: str
    start: int
    end: int
    value: str | None = None  # of a static string
    raw: str | None = None  # of any string: literal text with VAR for the rest
    literal: bool = False  # whether any literal text was seen
    template: bool = False  # written as a template or an interpolated string
    pair: int = -1  # index of the matching bracket


def _fragments(body: str) -> str:
    """Literal text without escape sequences."""
    return re.sub(r"\\(u\{[^}]*\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)", "", body, flags=re.S)


def _until(src: str, at: int, quote: str, escapes: bool = True) -> int:
    """Index behind the closing quote; a one-line string ends at the line's end at last."""
    while at < len(src):
        c = src[at]
        if escapes and c == "\\":
            at += 2
        elif src.startswith(quote, at):
            return at + len(quote)
        elif c == "\n" and len(quote) == 1 and quote != "`":
            return at
        else:
            at += 1
    return len(src)


def _interpolated(src: str, at: int, quote: str, mark: str, double: bool, verbatim: bool = False) -> tuple[int, str, bool, bool]:
    """End, raw, whether there is literal text, whether anything is interpolated."""
    out, literal, var = [], False, False
    while at < len(src):
        if verbatim and src.startswith('""', at) and quote == '"':
            at += 2
        elif src.startswith(quote, at):
            return at + len(quote), "".join(out), literal, var
        elif not verbatim and src[at] == "\\":
            at += 2
        elif double and src.startswith(("{{", "}}"), at):
            at += 2
        elif src.startswith(mark, at):
            depth, at = 1, at + len(mark)
            while at < len(src) and depth:
                if src[at] in "\"'`":
                    at = _until(src, at + 1, src[at])
                    continue
                depth += {"{": 1, "}": -1}.get(src[at], 0)
                at += 1
            out.append(VAR)
            var = True
        else:
            out.append(src[at])
            literal = True
            at += 1
    return len(src), "".join(out), literal, var


def _string(src: str, at: int, lang: str) -> Token | None:
    c = src[at]
    if lang == "go":
        if c == "`":
            end = _until(src, at + 1, "`", escapes=False)
        elif c == '"':
            end = _until(src, at + 1, '"')
        elif c == "'":
            return Token("other", "'", at, _until(src, at + 1, "'"))
        else:
            return None
        value = src[at:end].strip('"`')
        return Token("str", src[at:end], at, end, value, value, True)
    if lang == "csharp" and c in '$@"':
        head = re.compile(r'(\$@|@\$|\$|@)?("""|")').match(src, at)
        if not head:
            return None
        mark, quote = head[1] or "", head[2]
        verbatim = "@" in mark or quote == '"""'
        if "$" in mark:
            end, raw, literal, _ = _interpolated(src, head.end(), quote, "{", True, verbatim)
            return Token("str", src[at:end], at, end, None, raw, literal, True)
        if verbatim:
            end = head.end()
            while True:
                end = _until(src, end, quote, escapes=False) if quote == '"""' else (src.find('"', end) + 1 or len(src))
                if quote == '"' and src.startswith('"', end):
                    end += 1
                    continue
                break
            return Token("str", src[at:end], at, end, None, VAR, False)
    if lang in ("typescript", "javascript") and c == "`":
        end, raw, literal, var = _interpolated(src, at + 1, "`", "${", False)
        return Token("str", src[at:end], at, end, None if var else raw, raw, literal, True)
    if c == '"' or (c == "'" and lang in ("typescript", "javascript", "protobuf")):
        quote = '"""' if lang == "java" and src.startswith('"""', at) else c
        end = _until(src, at + len(quote), quote)
        closed = src[end - len(quote) : end] == quote and end - at >= 2 * len(quote)
        value = _fragments(src[at + len(quote) : end - len(quote) if closed else end])
        return Token("str", src[at:end], at, end, value, value, value != "")
    if c == "'":
        return Token("other", "'", at, _until(src, at + 1, "'"))
    return None


def tokens(src: str, lang: str) -> list[Token]:
    out: list[Token] = []
    open_: list[int] = []
    at = 0
    while at < len(src):
        if m := BLANK.match(src, at):
            at = m.end()
            continue
        token = _string(src, at, lang)
        if token is None and src[at] == "/" and lang in ("typescript", "javascript"):
            before = out[-1] if out else None
            if before is None or before.text in ("return", "typeof", "case", "in", "of") or (before.kind == "other" and before.text not in (")", "]", "}")):
                if m := REGEX.match(src, at):
                    token = Token("other", "/regex/", at, m.end())
        if token is None:
            if m := IDENT.match(src, at):
                token = Token("id", m[0], at, m.end())
            elif m := NUMBER.match(src, at):
                token = Token("num", m[0], at, m.end())
            else:
                size = 2 if src.startswith(("=>", "?.", "::", "->", ":=", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+="), at) else 1
                token = Token("other", src[at : at + size], at, at + size)
        if token.text in CLOSES:
            open_.append(len(out))
        elif token.text in (")", "]", "}"):
            for k in range(len(open_) - 1, max(-1, len(open_) - 4), -1):
                if CLOSES[out[open_[k]].text] == token.text:
                    token.pair = open_[k]
                    out[open_[k]].pair = len(out)
                    del open_[k:]
                    break
        out.append(token)
        at = token.end
    for k in open_:
        out[k].pair = len(out)
    return out
