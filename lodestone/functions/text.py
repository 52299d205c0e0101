"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters, lower case, and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Letters and digits, lower-cased, without diacritics; null has none."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """Places where the words of a phrase stand one after the other."""
    first, *rest = phrase
    if not rest:
        return F.size(F.filter(words, lambda w: w == first))

    def here(w: Column, i: Column) -> Column:
        out = w == first
        for k, other in enumerate(rest, 1):
            out = out & F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return out

    return F.size(F.filter(words, here))


def query_phrases(query: str) -> list[list[str]]:
    """Parts of a query by white space; a part keeps letters, digits and - _ /, whose pieces must stand together."""
    import unicodedata

    out = []
    for part in query.split():
        kept = "".join(c for c in part if c.isalnum() or c in "-_/")
        plain = "".join(c for c in unicodedata.normalize("NFD", kept.lower()) if not unicodedata.combining(c))
        words = "".join(c if c.isalnum() else " " for c in plain).split()
        if words:
            out.append(words)
    return out


def file_hash(text: Column) -> Column:
    """The first 128 bits of SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def slug(title: Column) -> Column:
    """Runs of other characters than ASCII letters and digits become a dash; empty becomes x."""
    dashed = F.regexp_replace(F.lower(F.regexp_replace(title, "[^A-Za-z0-9]+", "-")), "^-|-$", "")
    return F.when(dashed == "", "x").otherwise(dashed)


def slug_path(path: Column) -> Column:
    """Slugs of the titles joined by >; a text before any heading is (root)."""
    return F.when(F.size(path) == 0, "(root)").otherwise(F.array_join(F.transform(path, slug), ">"))


def chunk_prefix(file: Column, content: Column) -> Column:
    """32 hex digits for a file: its path, a zero byte, its bytes."""
    return file_hash(F.concat(F.encode(file, "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")))


def content_hash(content: Column) -> Column:
    """The first eight bytes of SHA-256 as a little-endian number, in hex without leading zeros."""
    h = F.sha2(content, 256)
    flipped = F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    bare = F.regexp_replace(flipped, "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def excerpt(line: Column, cap: int = 120) -> Column:
    """A line without carriage returns, trimmed, tabs as four spaces; a longer one is cut and ends in an ellipsis."""
    flat = F.replace(F.trim(F.replace(line, F.lit("\r"), F.lit(""))), F.lit("\t"), F.lit("    "))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)


def finding_id(check: Column, file: Column, line: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", check, file, line.cast("string"), text)), 1, 16)


def trailing_json(output: Column) -> Column:
    """The last line of a program's output that is not blank, if it is a JSON object; else null."""
    lines = F.filter(F.transform(F.split(output, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  "))), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    return F.when(F.schema_of_variant(F.try_parse_json(last)).startswith("OBJECT"), last)


#: Suffixes of generated classes, by kind; the first kind makes the entity and these two.
SUFFIXES = {"controller": "Controller", "validator": "Validator"}


def predicted_paths(kind: str, module: Column, name: Column) -> Column:
    """The files that generating `name` in a module writes, as far as their names are known; a suffix is not doubled."""
    at = lambda stem: F.concat(F.lit("app/"), module, F.lit("/"), stem, F.lit(".ts"))
    ending = lambda s: at(F.when(name.endswith(s), name).otherwise(F.concat(name, F.lit(s))))
    made = {"module": [at(name), *map(ending, SUFFIXES.values())], "entity": [at(name)], **{k: [ending(s)] for k, s in SUFFIXES.items()}}
    return F.array(*made.get(kind, [])).cast("array<string>")


def redact(text: Column, root: str) -> Column:
    """Paths below root, passwords in urls and anything after them that would name a place."""
    return F.regexp_replace(F.replace(text, F.lit(root), F.lit("<root>")), r"(\w+://[^:/@\s]+):[^@\s]+@", "$1:***@")


def dot_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def loc(text: Column) -> Column:
    """Physical lines of code: not blank, not // and not inside block comments; code after a closing mark counts."""

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(raw)
        after = F.trim(F.substring_index(line, "*/", -1))
        closes = F.contains(line, F.lit("*/"))
        in_block = acc["open"]
        opens = ~in_block & line.startswith("/*")
        code = F.when(in_block | opens, closes & (after != "") & ~after.startswith("//")).otherwise((line != "") & ~line.startswith("//"))
        return F.struct(F.when(in_block | opens, ~closes).otherwise(F.lit(False)).alias("open"), (acc["n"] + code.cast("int")).alias("n"))

    return F.aggregate(F.split(text, "\n"), F.struct(F.lit(False).alias("open"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
