"""TypeScript files as token relations: a lexer with matched brackets, no type checker.

Accuracy limits against a full parser: a regular expression is told from a division by the token
before it, and the angle brackets of generics are plain operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Words that are never names.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let static yield async await of as implements interface package private protected public abstract readonly declare type namespace".split()
)
LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<punct>\.\.\.|\?\.|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^!~<>=?:;,.(){}\[\]@\#])""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


@dataclass
class Token:
    kind: str  # name, keyword, string, template, number, regex, punct
    text: str
    line: int
    holes: int = 0  # of a template
    match: int = -1  # of a bracket: the index of its partner


def _template(text: str, at: int) -> tuple[int, int]:
    """End and number of ${} of a template that begins at a backtick."""
    i, holes = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, holes
        elif text.startswith("${", i):
            holes += 1
            depth, i = 1, i + 2
            while i < len(text) and depth:
                c = text[i]
                if c == "`":
                    i, _ = _template(text, i)
                    continue
                if c in "\"'" and (m := LEX.match(text, i)) and m.lastgroup == "string":
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return len(text), holes


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    stack: list[int] = []
    at, line = 0, 1
    while at < len(text):
        start, holes = at, 0
        if text[at] == "`":
            at, holes = _template(text, at)
            kind = "template"
        elif text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (not out or out[-1].kind in ("punct", "keyword") and out[-1].text not in (")", "]", "}")) and (m := REGEX.match(text, at)):
            at, kind = m.end(), "regex"
        elif m := LEX.match(text, at):
            at, kind = m.end(), m.lastgroup
        else:
            at, kind = at + 1, "punct"
        piece = text[start:at]
        if kind not in ("space", "comment"):
            token = Token("keyword" if kind == "name" and piece in KEYWORDS else kind, piece, line, holes)
            if kind == "punct" and piece in "([{":
                stack.append(len(out))
            elif kind == "punct" and piece in ")]}" and stack:
                token.match = stack.pop()
                out[token.match].match = len(out)
            out.append(token)
        line += piece.count("\n")
    return out


def normalised(tokens: list[Token]) -> list[str]:
    """Names become one placeholder; everything else stays."""
    return ["$" if t.kind == "name" else t.text for t in tokens]


def split_arguments(tokens: list[Token], opening: int) -> list[tuple[int, int]]:
    """Ranges of the comma-separated parts inside a bracket."""
    out, start, i = [], opening + 1, opening + 1
    end = tokens[opening].match
    if end < 0:
        return out
    while i < end:
        if tokens[i].match > i:
            i = tokens[i].match
        elif tokens[i].text == "," and tokens[i].kind == "punct":
            out.append((start, i))
            start = i + 1
        i += 1
    return [*out, (start, end)] if start < end else out


def properties(tokens: list[Token], opening: int) -> dict[str, tuple[int, int]]:
    """Names of an object literal to the ranges of their values; a spread is ..., a shorthand has an empty range."""
    out = {}
    for a, b in split_arguments(tokens, opening):
        key = tokens[a]
        if key.text == "...":
            out["..."] = (a + 1, b)
        elif a + 1 < b and tokens[a + 1].text == ":":
            out[key.text.strip("\"'")] = (a + 2, b)
        else:
            out.setdefault(key.text + "()", (a, a))
    return out


def specifiers(tokens: list[Token]) -> list[str]:
    """Modules of imports and re-exports, but not of type-only ones."""
    out = []
    for i, t in enumerate(tokens):
        if t.text not in ("import", "export") or t.kind != "keyword" or (i and tokens[i - 1].text == "."):
            continue
        if i + 1 < len(tokens) and (tokens[i + 1].text == "(" or tokens[i + 1].text == "type" and i + 2 < len(tokens) and tokens[i + 2].text not in ("from", ",")):
            continue
        if t.text == "import" and i + 1 < len(tokens) and tokens[i + 1].kind == "string":
            out.append(tokens[i + 1].text[1:-1])
            continue
        k = i + 1
        if k < len(tokens) and t.text == "export" and tokens[k].text not in ("*", "{"):
            continue
        while k < len(tokens) and tokens[k].text not in (";", "from") and not (tokens[k].kind == "keyword" and tokens[k].text in ("import", "export", "const", "function", "class")):
            k = tokens[k].match if tokens[k].match > k else k
            k += 1
        if k + 1 < len(tokens) and tokens[k].text == "from" and tokens[k + 1].kind == "string":
            out.append(tokens[k + 1].text[1:-1])
    return out


def token_table(files: DataFrame) -> DataFrame:
    """(file, text) to (file, words, lines): normalised tokens and their lines, one row per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [tokenize(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"file": pdf["file"], "words": [normalised(x) for x in found], "lines": [[t.line for t in x] for x in found]})

    return files.select("file", "text").mapInPandas(run, "file string, words array<string>, lines array<int>")


def import_table(files: DataFrame) -> DataFrame:
    """(file, text) to (file, specifier)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, s) for f, t in zip(pdf["file"], pdf["text"], strict=True) for s in specifiers(tokenize(t or ""))]
            yield pd.DataFrame(rows, columns=["file", "specifier"])

    return files.select("file", "text").mapInPandas(run, "file string, specifier string")
