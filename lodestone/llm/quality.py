"""Line-first quality rules: each line is judged alone, failing lines go, then documents that lost too much go.

A line (the parts between \\n) that has a word fails if
  symbols     over half of its words end in two or more of ! # $ % & * (shouting, markup residue);
  navigation  it has three or more of | » › • · and they are a fifth or more of its words;
  runs        it has six words or more and over half of them equal the word before (stuffing);
  fragment    it has fewer than three words and does not end in . ! ? : ; " ' ) or an ellipsis;
  numbers     it has three words or more and none of them has a letter (counters, table residue);
  sharing     it has three words or more and over half of them name a service or an act of sharing;
  notice      it begins with a copyright sign or word and a year, or ends with the words all rights reserved;
  boilerplate it holds a phrase of consent banners, script warnings, subscriptions or placeholder text.
The phrases are English, German, French and Spanish. A-Z count as a-z, no other letter changes.
A document is kept unless it fails the base rule (fewer than 20 words, or over 30 % of its words in
repeated 8-word windows) or its failing lines hold over `max_lost` of its words.

Null and empty texts have no words, so they fail the base rule. Lines and texts are judged whole, however
long. Rows are judged one by one: a repeated row gets a repeated result, there are no ties, and an empty table
gives an empty one. Columns of the input other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import LOWER, UPPER, table, tidy

MIN_WORDS, MAX_REPEATED, WINDOW, MAX_LOST = 20, 30, 8, 0.4
#: Phrases of lines that are never prose, lower case.
BOILERPLATE = (
    "enable javascript", "javascript is disabled", "javascript is required", "javascript aktivieren", "activer javascript", "activar javascript", "your browser does not support",
    "accept all cookies", "we use cookies", "this site uses cookies", "this website uses cookies", "cookie policy", "wir verwenden cookies", "diese website verwendet cookies", "alle cookies akzeptieren",
    "nous utilisons des cookies", "accepter tous les cookies", "ce site utilise des cookies", "utilizamos cookies", "aceptar todas las cookies", "este sitio utiliza cookies",
    "sign up for our newsletter", "subscribe to our newsletter", "newsletter abonnieren", "abonnez-vous à notre newsletter", "suscríbete a nuestro boletín",
    "skip to content", "skip to main content", "zum inhalt springen", "aller au contenu", "saltar al contenido", "lorem ipsum",
)
#: Words of sharing bars, lower case.
SHARING = frozenset(("share", "tweet", "print", "email", "e-mail", "facebook", "twitter", "linkedin", "pinterest", "whatsapp", "reddit", "instagram", "telegram", "teilen", "drucken", "partager", "imprimer", "compartir", "imprimir"))
#: How a notice begins and ends, in lower case.
NOTICE = r"^[\x20\x09-\x0D]*(copyright|©|\(c\))[^0-9]{0,20}(19|20)[0-9][0-9]|all rights reserved\.?[\x20\x09-\x0D]*$"
BARS = "|»›•·"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "”", "’", "»", "。", "！", "？")
NOISE = ("!", "#", "$", "%", "&", "*")
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lost_words bigint, n_failed_lines bigint, n_lines_kept bigint, clean_md5 string, base_failed boolean, kept boolean"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    ranked = np.sort(mixed)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0  # windows with different hashes differ
    # Exact: number pairs, then pairs of pairs, then whole windows.
    span, code = 1, ids.astype(np.int64)
    while span < window:
        step = min(span, window - span)
        m = len(code) - step
        pair = code[:m] * (int(code.max()) + 1) + code[step : step + m]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


BOILERPLATE_IN, NOTICE_IN, LETTER = re.compile("|".join(map(re.escape, BOILERPLATE))).search, re.compile(NOTICE).search, re.compile(r"[^\W\d_]").search
TO_LOWER = str.maketrans(UPPER, LOWER)


def line_fails(line: str, words: list[str]) -> bool:
    n = len(words)
    if n == 0:
        return False
    if n < 3 and not words[-1].endswith(ENDS):
        return True
    if n >= 3 and LETTER(line) is None:
        return True
    bars = sum(map(line.count, BARS))
    if bars >= 3 and 5 * bars >= n:
        return True
    if 2 * sum([w[-1] in NOISE and w[-2:-1] in NOISE and len(w) > 1 for w in words]) > n:
        return True
    if n >= 6 and 2 * sum(map(str.__eq__, words, words[1:])) > n:
        return True
    low = line.translate(TO_LOWER) if not line.isascii() else line.lower()
    if n >= 3 and 2 * sum([w.strip(".,:;") in SHARING for w in WORD.findall(low)]) > n:
        return True
    return BOILERPLATE_IN(low) is not None or NOTICE_IN(low) is not None


def judge(text: str | None, max_lost: float = MAX_LOST) -> tuple:
    """The values of FIELDS, and the text without its failing lines."""
    text = text or ""
    words, lost, failed, again, seen, left = [], 0, 0, 0, set(), []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            left.append(line)
            continue
        again += line in seen
        seen.add(line)
        words += own
        if line_fails(line, own):
            lost += len(own)
            failed += 1
        else:
            left.append(line)
    n, repeated, rest = len(words), repeated_words(words), "\n".join(left)
    bad = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), again, repeated, lost, failed, len(left), hashlib.md5(rest.encode()).hexdigest(), bad, not bad and lost <= max_lost * n, rest


def clean(text: str | None) -> str:
    """The text without its failing lines."""
    return judge(text)[-1]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per input row: id_col, the counts of the base rules, what the line rules removed, base_failed and kept."""
    narrow = df.select(df[id_col], df[text_col].cast("string"))
    schema = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, {FIELDS}"
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [{"boolean": pa.bool_(), "string": pa.string()}.get(x.split()[1], pa.int64()) for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py(), max_lost)[:-1] for t in batch.column(1)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *names])

    return narrow.mapInArrow(tidy(run), schema)


def filter_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The rows that the rules keep, with all their columns, their texts without failing lines; no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(t.as_py(), max_lost)[-2:] for t in batch.column(at)]
            kept = batch.filter(pa.array([keep for keep, _ in judged], type=pa.bool_()))
            texts = pa.array([rest for keep, rest in judged if keep], type=kept.schema.field(at).type)
            yield kept.set_column(at, kept.schema.field(at), texts)

    return df.mapInArrow(tidy(run), df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda words: ", ".join("'" + w + "'" for w in words)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
lw AS (SELECT doc_id, p, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM ln),
lf AS (
  SELECT doc_id, p, line, w, len(w) AS n, len(line) - len(translate(line, '{BARS}', '')) AS bars, translate(line, '{UPPER}', '{LOWER}') AS low,
    len(list_filter(w, lambda x: regexp_matches(x, '[!#$%&*]{{2}}$'))) AS noisy,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS runs,
    len(list_filter(w, lambda x: list_contains([{quoted(sorted(SHARING))}], trim(translate(x, '{UPPER}', '{LOWER}'), '.,:;')))) AS shared
  FROM lw),
lv AS (
  SELECT *, n > 0 AND ((n < 3 AND NOT regexp_matches(w[-1], '[.!?:;"'')…”’»。！？]$')) OR (bars >= 3 AND 5 * bars >= n) OR (n >= 3 AND NOT regexp_matches(line, '\p{{L}}'))
    OR 2 * noisy > n OR (n >= 6 AND 2 * runs > n) OR (n >= 3 AND 2 * shared > n)
    OR regexp_matches(low, '{"|".join(BOILERPLATE)}') OR regexp_matches(low, '{NOTICE}')) AS failed,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS nth
  FROM lf),
per AS (SELECT doc_id, count(*) FILTER (WHERE n > 0 AND nth > 1) AS n_dup_lines, sum(n) FILTER (WHERE failed) AS lost, count(*) FILTER (WHERE failed) AS n_failed_lines,
    count(*) FILTER (WHERE NOT failed) AS n_lines_kept, md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT failed), '')) AS clean_md5,
    flatten(list(w ORDER BY p)) AS w FROM lv GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM per WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM twice, range(8) AS ks(k) GROUP BY doc_id),
a AS (
  SELECT d.doc_id, coalesce(len(per.w), 0) AS n_words, coalesce(len(array_to_string(per.w, '')), 0) AS word_chars,
    len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(r, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words, coalesce(n_failed_lines, 0) AS n_failed_lines, n_lines_kept, clean_md5
  FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_lost_words <= 0.4 * n_words AS kept
FROM a
"""


#: The rules again in SQL.
SQL = _sql()
