"""Rules over the tokens of TypeScript files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import finding_id
from lodestone.operators.rules import RANK
from lodestone.sources.typescript import Token, properties, specifiers, split_arguments, tokenize

#: The names that each rule looks for.
SHIELDS = {"createBlackhole", "blackholeExpress", "blackholeFastify", "defineConfig"}
RAW_TAGS = {"raw", "unsafeHtml", "rawHtml", "html_raw"}
QUERY_METHODS, UNSAFE_TAGS = {"query", "execute", "raw", "unsafe"}, {"unsafe", "unsafeSql", "rawSql"}
CONTROLLERS = {"Controller", "inject", "Service"}
MUTATIONS = {"Post", "Put", "Patch", "Delete"}
GUARDS = {"UseGuards", "Auth", "AuthGuard", "Authorize", "RequireAuth", "Roles", "RequireRoles"}
ENTRIES = ("src/main.ts", "src/index.ts", "src/bootstrap.ts", "main.ts", "index.ts")
POLYFILLS, HEAD = {"reflect-metadata", "core-js/reflect"}, 50
SEVERITY = {
    "sql_interpolation": "high", "csrf_disabled": "high", "missing_guard_on_mutation_route": "high", "xss_html_raw_output": "medium",
    "reflect_metadata_missing": "medium", "cookie_missing_flags": "low", "raw_error_not_structured": "low",
}


def calls(tokens: list[Token]) -> Iterator[tuple[int, int]]:
    """(name, opening bracket) of each call or new."""
    for i in range(1, len(tokens)):
        if tokens[i].text == "(" and tokens[i - 1].kind == "name":
            yield i - 1, i


def tagged(tokens: list[Token], names: set[str]) -> Iterator[int]:
    """Templates with holes after one of the tags."""
    return (i - 1 for i in range(1, len(tokens)) if tokens[i].kind == "template" and tokens[i].holes and tokens[i - 1].kind == "name" and tokens[i - 1].text in names)


def start_of(tokens: list[Token], i: int) -> int:
    """The first token of a chain a.b().c that ends at i."""
    while i > 0:
        if tokens[i - 1].text in (".", "?.") and i > 1:
            i -= 2
            if 0 <= tokens[i].match < i:
                i = tokens[i].match
                if i and tokens[i - 1].kind == "name":
                    i -= 1
        else:
            break
    return i


def is_false(tokens: list[Token], span: tuple[int, int]) -> bool:
    return span[1] - span[0] == 1 and tokens[span[0]].text == "false"


def concatenates(tokens: list[Token], a: int, b: int) -> bool:
    """A plain string next to a name around a + at the top of an argument."""
    flat = []
    i = a
    while i < b:
        flat.append(tokens[i])
        i = tokens[i].match if tokens[i].match > i else i
        i += 1
    operands, now = [], []
    for t in flat:
        if t.text == "+" and t.kind == "punct":
            operands.append(now)
            now = []
        else:
            now.append(t)
    operands.append(now)
    text = [len(o) == 1 and (o[0].kind == "string" or o[0].kind == "template" and not o[0].holes) for o in operands]
    name = [bool(o) and all(t.kind == "name" or t.text in (".", "?.", "this") for t in o) for o in operands]
    return any(text[k] and name[k + 1] or name[k] and text[k + 1] for k in range(len(operands) - 1))


def sql_interpolation(tokens: list[Token], file: str) -> list[int]:
    out = [tokens[start_of(tokens, i)].line for i in tagged(tokens, UNSAFE_TAGS)]
    for name, opening in calls(tokens):
        if tokens[name].text in QUERY_METHODS and name and tokens[name - 1].text in (".", "?."):
            if any(b - a == 1 and tokens[a].kind == "template" and tokens[a].holes or concatenates(tokens, a, b) for a, b in split_arguments(tokens, opening)):
                out.append(tokens[start_of(tokens, name)].line)
    return out


def csrf_disabled(tokens: list[Token], file: str) -> list[int]:
    out = []
    for name, opening in calls(tokens):
        if tokens[name].text not in SHIELDS:
            continue
        for a, _ in split_arguments(tokens, opening):
            if tokens[a].text != "{" or (span := properties(tokens, a).get("csrf")) is None:
                continue
            if is_false(tokens, span):
                out.append(tokens[span[0]].line)
            elif span[0] < span[1] and tokens[span[0]].text == "{" and (inner := properties(tokens, span[0]).get("enabled")) and is_false(tokens, inner):
                out.append(tokens[inner[0]].line)
    return out


def xss_html_raw_output(tokens: list[Token], file: str) -> list[int]:
    return [tokens[start_of(tokens, i)].line for i in tagged(tokens, RAW_TAGS)]


def cookie_missing_flags(tokens: list[Token], file: str) -> list[int]:
    out = []
    for name, opening in calls(tokens):
        word = tokens[name].text
        if not name or tokens[name - 1].text not in (".", "?.") or not (word in ("cookie", "setCookie") or word == "set" and re.search(r"cookies?$", tokens[name - 2].text, re.I)):
            continue
        options = next((properties(tokens, a) for a, _ in split_arguments(tokens, opening) if tokens[a].text == "{"), None)
        if options is None or "..." not in options and (not {"secure", "sameSite"} <= options.keys() or "httpOnly" in options and is_false(tokens, options["httpOnly"])):
            out.append(tokens[start_of(tokens, name)].line)
    return out


def decorators(tokens: list[Token], before: int) -> set[str]:
    """Names of the decorators that end right before a token."""
    found, i = set(), before
    while i > 0:
        if tokens[i - 1].kind == "keyword" and tokens[i - 1].text not in ("class",):
            i -= 1
            continue
        j = tokens[i - 1].match - 1 if tokens[i - 1].text == ")" and tokens[i - 1].match >= 0 else i - 1
        if j >= 1 and tokens[j].kind == "name" and tokens[j - 1].text == "@":
            found.add(tokens[j].text)
            i = j - 1
        else:
            break
    return found


def classes(tokens: list[Token]) -> Iterator[tuple[set[str], int]]:
    """(decorators, opening brace of the body) of each class."""
    for i, t in enumerate(tokens):
        if t.text == "class" and t.kind == "keyword":
            body = next((k for k in range(i + 1, len(tokens)) if tokens[k].text == "{"), None)
            if body is not None and tokens[body].match > 0:
                yield decorators(tokens, i), body


def missing_guard_on_mutation_route(tokens: list[Token], file: str) -> list[int]:
    out = []
    for own, body in classes(tokens):
        if not ("/controllers/" in file.replace("\\", "/") or own & CONTROLLERS) or own & GUARDS:
            continue
        i, first = body + 1, None
        names: set[str] = set()
        while i < tokens[body].match:
            if tokens[i].text == "@" and tokens[i + 1].kind == "name":
                first = i if first is None else first
                names.add(tokens[i + 1].text)
                i += 2
                i = tokens[i].match + 1 if tokens[i].text == "(" and tokens[i].match > i else i
                continue
            if tokens[i].text in ("{", ";"):
                if names & MUTATIONS and not names & GUARDS and tokens[i].text == "{":
                    out.append(tokens[first].line)
                first, names = None, set()
            i = tokens[i].match if tokens[i].match > i else i
            i += 1
    return out


def raw_error_not_structured(tokens: list[Token], file: str) -> list[int]:
    if "/controllers/" not in file.replace("\\", "/") and not any(own & CONTROLLERS for own, _ in classes(tokens)):
        return []
    return [t.line for t, n in zip(tokens, tokens[1:]) if t.text == "new" and n.text == "Error" and n.kind == "name"]


def reflect_metadata_missing(tokens: list[Token], file: str) -> list[int]:
    head = [t for t in tokens if t.line <= HEAD]
    required = any(head[k].text == "require" and head[k + 1].text == "(" and head[k + 2].text[1:-1] in POLYFILLS for k in range(len(head) - 2))
    return [] if required or POLYFILLS & set(specifiers(head)) else [1]


CHECKS: dict[str, Callable[[list[Token], str], list[int]]] = {
    f.__name__: f for f in (sql_interpolation, csrf_disabled, missing_guard_on_mutation_route, xss_html_raw_output, reflect_metadata_missing, cookie_missing_flags, raw_error_not_structured)
}


def scan_code(files: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """(file, text) to findings (id, severity, rank, check, file, line, excerpt). The entry file is the first of its candidates that exists."""
    if unknown := set(selected or ()) - CHECKS.keys():
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
    order = F.array_position(F.array(*[F.lit(e) for e in ENTRIES]), F.col("file"))
    entry = files.filter(order > 0).agg(F.min_by("file", order).alias("entry"))
    marked = files.join(F.broadcast(entry))  # one row
    active = {k: f for k, f in CHECKS.items() if not selected or k in selected}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text, first in zip(pdf["file"], pdf["text"], pdf["entry"], strict=True):
                tokens, lines = tokenize(text or ""), (text or "").split("\n")
                for name, check in active.items():
                    if name == "reflect_metadata_missing" and file != first:
                        continue
                    try:
                        places = check(tokens, file)
                    except (IndexError, ValueError, KeyError, RecursionError):  # one broken file does not stop the others
                        continue
                    for line in places:
                        flat = lines[line - 1].replace("\r", "").strip().replace("\t", "    ")
                        rows.append((name, SEVERITY[name], RANK[SEVERITY[name]], file, line, flat if len(flat) <= 120 else flat[:119] + "…"))
            yield pd.DataFrame(rows, columns=["check", "severity", "rank", "file", "line", "excerpt"])

    found = marked.select("file", "text", "entry").mapInPandas(run, "check string, severity string, rank int, file string, line int, excerpt string")
    return found.select(finding_id(F.col("check"), F.col("file"), F.col("line"), F.col("excerpt")).alias("id"), "severity", "rank", "check", "file", "line", "excerpt")
