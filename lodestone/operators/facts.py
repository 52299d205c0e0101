"""Facts of an application, read from the tokens of its TypeScript files: one row per fact.

Each kind has its own function from tokens to rows; facts() runs them over files and returns
(kind, file, line, name, detail), detail being a JSON object. Routes carry the composed prefix,
middleware and guards of the groups around them, the outermost first.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.code_rules import calls, decorators
from lodestone.sources.typescript import Token, properties, split_arguments, tokenize

#: Verbs, relations, hooks, lifecycle methods, actions.
VERBS = {"get", "post", "put", "patch", "delete", "any", "head", "options"}
RELATIONS = {"HasMany", "HasOne", "BelongsTo", "ManyToMany"}
HOOKS = {f"{when}{what}" for when in ("Before", "After") for what in ("Save", "Create", "Update", "Delete", "Find")}
LIFECYCLE = ("register", "boot", "ready", "shutdown")
ACTIONS = ["list", "show", "create", "edit", "destroy"]
MISSING = object()


def literal(tokens: list[Token], a: int, b: int):
    """A value of strings, numbers, booleans, null, lists and objects; env("K", d) and process.env.K as references, the rest as text."""
    if a >= b:
        return None
    first = tokens[a]
    text = "".join(t.text for t in tokens[a:b])
    if b - a == 1:
        if first.kind == "string" or first.kind == "template" and not first.holes:
            return first.text[1:-1]
        if first.kind == "number":
            try:
                return json.loads(first.text.replace("_", ""))
            except ValueError:
                return {"unevaluated": True, "expression": text}
        if first.text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[first.text]
    if first.text == "-" and b - a == 2 and tokens[a + 1].kind == "number":
        return -literal(tokens, a + 1, b)
    if first.text == "[" and first.match == b - 1:
        return [literal(tokens, x, y) for x, y in split_arguments(tokens, a)]
    if first.text == "{" and first.match == b - 1:
        return {k: literal(tokens, *span) for k, span in properties(tokens, a).items() if not k.endswith("()")}
    if first.text == "env" and a + 1 < b and tokens[a + 1].text == "(" and tokens[a + 1].match == b - 1:
        args = [literal(tokens, x, y) for x, y in split_arguments(tokens, a + 1)]
        return {"env": args[0] if args else None, "default": args[1] if len(args) > 1 else None}
    if text.startswith("process.env."):
        return {"env": text.removeprefix("process.env."), "default": None}
    return {"unevaluated": True, "expression": text}


def chain(tokens: list[Token], opening: int) -> Iterator[tuple[str, int]]:
    """The calls that follow a call in its chain: name and opening bracket."""
    i = tokens[opening].match + 1
    while 0 < i + 2 < len(tokens) and tokens[i].text in (".", "?.") and tokens[i + 2].text == "(":
        yield tokens[i + 1].text, i + 2
        i = tokens[i + 2].match + 1


def strings(tokens: list[Token], opening: int) -> list[str]:
    return [v for a, b in split_arguments(tokens, opening) if isinstance(v := literal(tokens, a, b), str)]


def routes(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    groups = []
    for name, opening in calls(tokens):
        if tokens[name].text == "group":
            ctx: dict = {"prefix": "", "middleware": [], "guards": []}
            for method, at in chain(tokens, opening):
                found = strings(tokens, at)
                if method == "prefix" and found:
                    ctx["prefix"] = found[0] + ctx["prefix"]
                elif method == "middleware":
                    ctx["middleware"] = found + ctx["middleware"]
                elif method in ("guard", "guards"):
                    ctx["guards"] = found + ctx["guards"]
            groups.append((opening, tokens[opening].match, ctx))
    for name, opening in calls(tokens):
        if tokens[name].text not in VERBS or name < 2 or tokens[name - 1].text not in (".", "?.") or not tokens[name - 2].text.lower().endswith("router"):
            continue
        args = split_arguments(tokens, opening)
        if not args:
            continue
        path = literal(tokens, *args[0])
        path = path if isinstance(path, str) else "<" + "".join(t.text for t in tokens[slice(*args[0])]) + ">"
        controller, action = None, "<missing>" if len(args) < 2 else "<inline>"
        if len(args) > 1 and tokens[args[1][0]].text == "[":
            parts = split_arguments(tokens, args[1][0])
            controller = "".join(t.text for t in tokens[slice(*parts[0])]) if parts else None
            value = literal(tokens, *parts[1]) if len(parts) > 1 else None
            action = value if isinstance(value, str) else "<inline>"
        around = [c for lo, hi, c in groups if lo < name < hi]  # in order of their start, so outermost first
        yield tokens[name - 2].line, "".join(c["prefix"] for c in around) + path, {
            "method": tokens[name].text.upper(), "controller": controller, "action": action,
            "middleware": [m for c in around for m in c["middleware"]], "guards": [g for c in around for g in c["guards"]],
        }


def members(tokens: list[Token], body: int) -> Iterator[tuple[list[tuple[str, int | None]], int, bool]]:
    """(decorators with the bracket of their arguments, index of the name, is a method) of each member of a class."""
    i, found = body + 1, []
    while i < tokens[body].match:
        t = tokens[i]
        if t.text == "@" and tokens[i + 1].kind == "name":
            opening = i + 2 if tokens[i + 2].text == "(" else None
            found.append((tokens[i + 1].text, opening))
            i = tokens[opening].match + 1 if opening is not None else i + 2
        elif t.kind == "name" or t.kind == "keyword" and tokens[i + 1].text in ("(", ":", "=", "!", "?", ";"):
            method = tokens[i + 1].text in ("(", "<")
            yield found, i, method
            found = []
            while i < tokens[body].match and tokens[i].text != ";":
                if tokens[i].text == "{" and method:
                    i = tokens[i].match
                    break
                i = tokens[i].match if tokens[i].match > i else i
                i += 1
            i += 1
        else:
            i += 1


def class_list(tokens: list[Token]) -> Iterator[tuple[str, int, int]]:
    """(name, index of the word class, opening brace) of each class."""
    for i, t in enumerate(tokens):
        if t.text == "class" and t.kind == "keyword":
            body = next((k for k in range(i + 1, len(tokens)) if tokens[k].text == "{"), None)
            if body is not None and tokens[body].match > 0:
                yield (tokens[i + 1].text if tokens[i + 1].kind == "name" else "<anonymous>"), i, body


def decorator_arguments(tokens: list[Token], before: int, name: str) -> list | None:
    """Values of the arguments of a class's decorator, or None without it."""
    for k in range(max(0, before - 200), before):
        if tokens[k].text == name and k and tokens[k - 1].text == "@" and name in decorators(tokens, before):
            return [literal(tokens, a, b) for a, b in split_arguments(tokens, k + 1)] if tokens[k + 1].text == "(" else []
    return None


def entities(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    for name, at, body in class_list(tokens):
        args = decorator_arguments(tokens, at, "Entity")
        if args is None:
            continue
        columns, relations, hooks = [], [], []
        for found, i, _ in members(tokens, body):
            for decorator, opening in found:
                if decorator == "Column":
                    columns.append(tokens[i].text)
                elif decorator in RELATIONS:
                    spans = split_arguments(tokens, opening) if opening is not None else []
                    relations.append({"kind": decorator, "property": tokens[i].text, "target": "".join(t.text for t in tokens[slice(*spans[-1])]) if spans else None})
                elif decorator in HOOKS:
                    hooks.append({"kind": decorator, "method": tokens[i].text})
        yield tokens[at].line, name, {"table": args[0] if args and isinstance(args[0], str) else None, "columns": columns, "relations": relations, "hooks": hooks}


def own_names(tokens: list[Token]) -> dict:
    """Classes of a file and their event names."""
    named = {}
    for name, _, body in class_list(tokens):
        for _, i, method in members(tokens, body):
            if tokens[i].text == "EVENT_NAME" and not method and tokens[i + 1].text == "=":
                named[name] = literal(tokens, i + 2, i + 3)
    return named


def events(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    named = own_names(tokens)
    for name, opening in calls(tokens):
        word = tokens[name].text
        side = {"subscribe": "subscriber", "EventListener": "subscriber", "emit": "emitter", "dispatch": "emitter"}.get(word)
        if side is None or (word == "EventListener") != (tokens[name - 1].text == "@") or word != "EventListener" and tokens[name - 1].text not in (".", "?."):
            continue
        args = split_arguments(tokens, opening)
        if not args:
            continue
        a, b = args[0]
        value = literal(tokens, a, b)
        owner = tokens[a + 1].text if tokens[a].text == "new" else tokens[a].text
        event = value if isinstance(value, str) else named.get(owner)
        yield tokens[name].line, event or f"<{owner}>", {"side": side, "class": None if isinstance(value, str) else owner, "resolved": isinstance(event, str)}


def providers(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    for name, at, body in class_list(tokens):
        if not name.endswith("Provider"):
            continue
        inside = [(k, o) for k, o in calls(tokens) if body < k < tokens[body].match]
        bindings = [{"kind": tokens[k].text, "token": "".join(t.text for t in tokens[slice(*split_arguments(tokens, o)[0])]).strip("\"'")} for k, o in inside if tokens[k].text in ("bind", "singleton") and split_arguments(tokens, o)]
        yield tokens[at].line, name, {"lifecycle": {tokens[i].text: tokens[i].line for _, i, m in members(tokens, body) if m and tokens[i].text in LIFECYCLE}, "bindings": bindings}


def middleware(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    for _, _, body in class_list(tokens):
        for _, i, method in members(tokens, body):
            if method or tokens[i + 1].text != "=":
                continue
            if tokens[i].text == "globalMiddleware" and tokens[i + 2].text == "[":
                for k, (a, b) in enumerate(split_arguments(tokens, i + 2)):
                    yield tokens[a].line, "".join(t.text for t in tokens[a:b]), {"scope": "global", "order": k}
            elif tokens[i].text == "namedMiddleware" and tokens[i + 2].text == "{":
                for key, (a, b) in properties(tokens, i + 2).items():
                    yield tokens[a].line, "".join(t.text for t in tokens[a:b]), {"scope": "named", "alias": key}


def config(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    """The first defineConfig(argument), else the default export."""
    for name, opening in calls(tokens):
        if tokens[name].text == "defineConfig" and (args := split_arguments(tokens, opening)):
            yield tokens[name].line, "config", {"value": literal(tokens, *args[0])}
            return
    for i in range(len(tokens) - 2):
        if tokens[i].text == "export" and tokens[i + 1].text == "default" and tokens[i + 2].match > 0:
            yield tokens[i].line, "config", {"value": literal(tokens, i + 2, tokens[i + 2].match + 1)}
            return


def tasks(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    for name, _, body in class_list(tokens):
        for found, i, method in members(tokens, body):
            for decorator, opening in found:
                if method and decorator == "Schedule":
                    args = split_arguments(tokens, opening) if opening is not None else []
                    plain = bool(args) and args[0][1] - args[0][0] == 1 and tokens[args[0][0]].kind == "string"
                    at = opening - 2 if opening is not None else i
                    yield tokens[at].line, f"{name}.{tokens[i].text}", {"cron": literal(tokens, *args[0]) if plain else None, "confidence": "high" if plain else "medium" if args else "low"}
    for k, opening in calls(tokens):
        if tokens[k].text == "register" and k > 1 and tokens[k - 1].text in (".", "?.") and tokens[k - 2].text.lower().endswith("scheduler"):
            args = split_arguments(tokens, opening)
            value = literal(tokens, *args[0]) if args else None
            yield tokens[k].line, value if isinstance(value, str) else "<dynamic>", {"cron": None, "confidence": "high" if isinstance(value, str) else "medium" if args else "low"}


def resources(tokens: list[Token]) -> Iterator[tuple[int, str, dict]]:
    for name, opening in calls(tokens):
        if tokens[name].text != "defineResource":
            continue
        args = split_arguments(tokens, opening)
        value = literal(tokens, *args[0]) if args else None
        if not isinstance(value, dict) or "unevaluated" in value:
            yield tokens[name].line, "<dynamic>", {"actions": ACTIONS, "confidence": "low"}
            continue
        actions = value.get("actions")
        plain = actions is None or isinstance(actions, list) and all(isinstance(a, str) for a in actions)
        title = value.get("name")
        yield tokens[name].line, title if isinstance(title, str) else "<dynamic>", {"actions": actions if plain and actions else ACTIONS, "confidence": "high" if plain and isinstance(title, str) else "medium"}


KINDS = {"route": routes, "entity": entities, "event": events, "provider": providers, "middleware": middleware, "config": config, "task": tasks, "resource": resources}


def facts(files: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(file, text) to (kind, file, line, name, detail)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                try:
                    tokens = tokenize(text or "")
                    rows += [(k, file, line, name, json.dumps(detail)) for k in kinds for line, name, detail in KINDS[k](tokens)]
                except (IndexError, ValueError, KeyError, RecursionError) as e:  # one broken file does not stop the others
                    rows.append(("failed", file, 0, type(e).__name__, "{}"))
            yield pd.DataFrame(rows, columns=["kind", "file", "line", "name", "detail"])

    return files.select("file", "text").mapInPandas(run, "kind string, file string, line int, name string, detail string")


def event_names(files: DataFrame) -> DataFrame:
    """(file, text) to (class, event): classes with an event name of their own; the first file's counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                with contextlib.suppress(IndexError, ValueError, KeyError, RecursionError):  # facts lists such files
                    rows += [(file, name, event) for name, event in own_names(tokenize(text or "")).items() if isinstance(event, str)]
            yield pd.DataFrame(rows, columns=["file", "class", "event"])

    found = files.select("file", "text").mapInPandas(run, "file string, class string, event string")
    return found.groupBy("class").agg(F.min_by("event", "file").alias("event"))


def events_across(files: DataFrame) -> DataFrame:
    """Facts of kind event; an emitted class takes the event name it has in any file."""
    found = facts(files, ("event",))
    owner = F.when(F.get_json_object("detail", "$.resolved") == "false", F.get_json_object("detail", "$.class"))
    joined = found.withColumn("_class", owner).join(event_names(files).select(F.col("class").alias("_class"), F.col("event").alias("_event")), "_class", "left")
    detail = F.when(F.col("_event").isNotNull(), F.regexp_replace("detail", '"resolved": false', '"resolved": true')).otherwise(F.col("detail"))
    return joined.select("kind", "file", "line", F.coalesce("_event", "name").alias("name"), detail.alias("detail"))


def config_value(found: DataFrame, key: str) -> DataFrame:
    """(file, value) at a dotted key of each config, as JSON; a key that is not there, or beyond what was evaluated, has none."""
    path = "$.value" + "".join(f"['{part}']" for part in key.split(".") if part)
    return found.filter("kind = 'config'").select("file", F.get_json_object("detail", path).alias("value")).filter("value is not null")
