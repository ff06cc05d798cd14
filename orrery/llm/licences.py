"""Licence scans: Aho-Corasick phrases, and licence expressions by shunting-yard.

Texts are lower-cased in A-Z and cut into words of digits, a-z and anything
beyond ASCII. One automaton over the words finds all phrases of ``PHRASES`` at
once. Behind each identifier tag the rest of the line is read as a licence
expression: a shunting-yard parser puts and/or/with and parentheses in postfix
order, which is evaluated to the licences named and to whether the terms can be
met permissively (any side of *or*, both sides of *and*; *with* keeps its left).

Edge cases: a null or empty text has no words, null places, empty labels and
score 0. A malformed expression yields the licences it names and counts as not
permissive. Repeated rows come back as often as they came; an empty table gives
no rows; other columns are not read. A phrase is counted at every place, also
where places overlap.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from orrery.llm.text import map_texts

#: The phrases whose places and labels are the base results.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices. Each is a label and the evidence it gives, from 0 to 1.
PHRASES = {
    "apache license version 2 0": ("apache-2.0", 1.0),
    "general public license version 2": ("gpl-2.0", 1.0),
    "general public license version 3": ("gpl-3.0", 1.0),
    "gnu general public license": ("gpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.9),
    "isc license": ("isc", 0.9),
    "boost software license": ("bsl", 0.9),
    "cc by": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 1.0),
    "cc by nc": ("cc-by-nc", 1.0),
    "cc by nd": ("cc-by-nd", 1.0),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 1.0),
    "creative commons attribution sharealike": ("cc-by-sa", 1.0),
    "dedicated to the public domain": ("public-domain", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.7),
    "licensed under": ("notice", 0.5),
    "released under the": ("notice", 0.5),
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache", "bsd", "isc", "bsl", "zlib", "unlicense", "cc0", "cc-by", "public-domain", "0bsd")
RESTRICTED = ("cc-by-nc", "cc-by-nd", "cc-by-sa")

KEPT_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(KEPT_BYTES).split()


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found: dict[str, tuple[int, str | None, list[tuple[str, float]]]] = {}
    for phrase in {*BASE_PHRASES, *PHRASES, TAG}:
        own = [PHRASES[phrase]] if phrase in PHRASES else []
        if phrase in BASE_PHRASES:
            own.append((BASE_PHRASES[phrase], 0.9))
        found[phrase] = (len(phrase.split()), BASE_PHRASES.get(phrase), own)
    out = ahocorasick.Automaton()
    for phrase, value in found.items():
        out.add_word(f" {phrase} ", (phrase == TAG, *value))
    out.make_automaton()
    return out


def postfix(expression: str) -> list[str]:
    """The expression's operands and operators in postfix order.

    Reading ends before a word that cannot follow, as in prose behind a tag.
    Raises ValueError for unbalanced parentheses or a missing operand.
    """
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        low = token.lower().rstrip(".") or token
        if token == "(":
            if not operand_next:
                break
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("a parenthesis closes behind an operator")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif low in RANK:
            if operand_next:
                raise ValueError("an operator has no left side")
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(low)
            operand_next = False
    if operand_next:
        raise ValueError("the expression ends where an operand is due")
    while held:
        if held[-1] == "(":
            raise ValueError("a parenthesis stays open")
        out.append(held.pop())
    return out


def named(expression: str) -> list[str]:
    """The licences that a malformed expression names before a word that cannot follow; what is behind a *with* is none."""
    out: list[str] = []
    depth, operand_next, after = 0, True, ""
    for token in TOKEN.findall(expression):
        low = token.lower().rstrip(".")
        if token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if not depth:
                break
            depth, operand_next = depth - 1, False
        elif low in RANK:
            operand_next, after = True, low
        elif not operand_next:
            break
        else:
            if low and after != "with":
                out.append(low)
            operand_next = False
    return out


def is_permissive(licence: str) -> bool:
    return licence.startswith(PERMISSIVE) and not licence.startswith(RESTRICTED)


def evaluate(expression: str) -> tuple[str, list[str], bool]:
    """Normal form, licences named, and whether permissive terms can be chosen."""
    stack: list[tuple[str, list[str], bool, int]] = []
    try:
        steps = postfix(expression)
    except ValueError:
        return "malformed", named(expression), False
    for step in steps:
        if step not in RANK:
            stack.append((step, [step], is_permissive(step), 4))
            continue
        b, a = stack.pop(), stack.pop()
        shown = [x[0] if x[3] >= RANK[step] else f"({x[0]})" for x in (a, b)]
        names = a[1] if step == "with" else a[1] + b[1]
        good = {"or": a[2] or b[2], "and": a[2] and b[2], "with": a[2]}[step]
        stack.append((f"{shown[0]} {step} {shown[1]}", names, good, RANK[step]))
    return stack[0][0], stack[0][1], stack[0][2]


def tag_line(raw: bytes, word: int, begins: list[int]) -> str:
    """The rest of the line from word number ``word`` on, parentheses before it included."""
    if word >= len(begins):
        return ""
    at = begins[word]
    while at and raw[at - 1 : at] in (b"(", b" "):
        at -= 1
    end = raw.find(b"\n", at)
    return raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace")


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    words = words_of(text)
    joined = b" ".join([b"", *words, b""])
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    expressions, good = [], []
    at, spaces, raw, begins = 0, 0, b"", []
    for end, (is_tag, size, base_label, own) in automaton().iter(joined.decode("latin-1")):
        spaces += joined.count(b" ", at, end)
        at = end
        start = spaces - size
        if base_label:
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(base_label)
        for label, weight in own:
            score = max(score, weight)
            if label != "notice":
                labels.add(label)
        if is_tag:
            if not begins:
                raw = text.encode("utf-8", "surrogatepass")
                begins = [m.start() for m in WORD.finditer(raw)]
            line = tag_line(raw, start + size, begins)
            if not line:
                continue
            normal, names, fine = evaluate(line)
            expressions.append(normal)
            good.append(fine)
            labels.update(n.replace(",", "") for n in names)
            score = 1.0
    if labels and not good:
        good = [all(map(is_permissive, labels))]
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(expressions), all(good) if good else None


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(cols, texts):
        rows = list(zip(*map(scan, texts), strict=True))
        return {key: cols[key], **{f.split()[0]: list(v) for f, v in zip(FIELDS.split(", "), rows, strict=True)}}

    return map_texts(docs, run, f"`{key}` {dict(docs.dtypes)[key]}, {FIELDS}", [key], text)


def op4(docs: DataFrame) -> DataFrame:
    return scanned(docs)
