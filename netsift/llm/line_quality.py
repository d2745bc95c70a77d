"""Line-first cleaning: every line is judged by itself, failing lines go, and a document that loses too much is rejected.

Line rules, on the words (runs of anything but ASCII white space) of a line; a line without words neither fails nor counts:

* navigation: two words or more, and a fifth of all, are separators (``|``, ``»``, ``›``, ``•``, ``·``, ``→``);
* marks: two words or more, and a fifth of all, hold a run of two marks such as ``!!`` or ``$$``;
* shouting: of five words or more, half are capitals only;
* boilerplate: it has one of the fixed phrases of licences, notices and page furniture;
* punctuation: a line of fewer than eight words does not end like a sentence, a longer one has no sentence end at all.

A document is rejected when it has fewer than ``min_words`` words, when words in repeated three-word windows make up more
than half of its words, or when its failing lines hold more than ``max_lost`` percent of its words.

Rows: a null or empty text has no words and is rejected; repeated rows are judged alike, each by itself; one long line is
judged whole; an empty table gives an empty result; further columns are kept by ``clean`` and ignored by ``judge``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, tidy, windows, word_hashes

MIN_WORDS = 50
MAX_LOST = 30
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", "»", "›", "•", "·", "→"]
BOILERPLATE = [
    "licensed under", "released under", "all rights reserved", "copyright ©", "©", "cookie policy", "uses cookies", "accept cookies",
    "privacy policy", "terms of service", "terms of use", "click here", "sign up", "log in", "subscribe to our", "share this",
    "follow us on", "read more", "javascript is disabled", "enable javascript", "powered by", "skip to content", "back to top",
]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = r"[#*$%&<>!?=~^_+]{2}"
_END = r"[.!?;:…。！？][\"'”’)\]»]*$"
_INNER = r"[.!?…。！？]"
_marks, _end, _inner = re.compile(_MARKS), re.compile(_END), re.compile(_INNER)
_boilerplate = re.compile("|".join(re.escape(x) for x in BOILERPLATE))


def failing(line: str, words: list[str]) -> str | None:
    """Name of the first rule that the line fails; None for a good line."""
    n = len(words)
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and separators * 5 >= n:
        return "navigation"
    if _marks.search(line):
        marked = sum(_marks.search(w) is not None for w in words)
        if marked >= 2 and marked * 5 >= n:
            return "marks"
    if n >= 5 and sum(w.upper() == w and w.lower() != w for w in words) * 2 >= n:
        return "shouting"
    if _boilerplate.search(line.lower()):
        return "boilerplate"
    if not (_end.search(words[-1]) if n < 8 else _inner.search(line)):
        return "punctuation"
    return None


def judge_text(text: str) -> tuple[str, int, int, int]:
    """The text without failing lines; its words, lost words and lines that repeat an earlier one."""
    kept, n, lost, repeated, seen = [], 0, 0, 0, set()
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words:
            n += len(words)
            if line in seen:
                repeated += 1
            seen.add(line)
            if failing(line, words):
                lost += len(words)
                continue
        kept.append(line)
    return "\n".join(kept), n, lost, repeated


def repeat_words(hashes: np.ndarray) -> int:
    """Words that stand in a three-word window found twice or more."""
    three = windows(hashes, 3)
    if not len(three):
        return 0
    _, back, seen = np.unique(three, return_inverse=True, return_counts=True)
    often = seen[back] > 1
    inside = np.zeros(len(hashes), bool)
    for k in range(3):
        inside[k : k + len(often)] |= often
    return int(inside.sum())


def _rows(batch: pa.RecordBatch, min_words: int, max_lost: int, at: int, size: int):
    texts = [t or "" for t in column(batch.slice(at, size), "text")]
    hashes, offsets = word_hashes(texts)
    for k, text in enumerate(texts):
        cleaned, n, lost, repeated = judge_text(text)
        own = repeat_words(hashes[offsets[k] : offsets[k + 1]])
        failed = n < min_words or 100 * own > MAX_REPEATED * n
        yield text, cleaned, n, lost, repeated, own, failed, not failed and 100 * lost <= max_lost * n


def judge(documents: DataFrame, min_words: int = MIN_WORDS, max_lost: int = MAX_LOST) -> DataFrame:
    """The counts and the verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in range(9)]
                for text, _, n, lost, repeated, own, failed, kept in _rows(batch, min_words, max_lost, at, 500):
                    counts = Counter({s: text.count(s) for s in SYMBOLS})
                    chars = len(text) - sum(text.count(s) for s in " \t\n\x0b\x0c\r")
                    for x, y in zip(out, (n, chars, sum(counts.values()), repeated, own, lost, failed, kept)):
                        x.append(y)
                kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(at, 500).column(0), *(pa.array(x, t) for x, t in zip(out, kinds))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, base_failed boolean, kept boolean"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def clean(documents: DataFrame, min_words: int = MIN_WORDS, max_lost: int = MAX_LOST) -> DataFrame:
    """The documents that are kept, all their columns, with ``text`` (and ``n_chars``, if there) of the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, good, texts = batch.slice(at, 500), [], []
                for k, (_, cleaned, *_, kept) in enumerate(_rows(batch, min_words, max_lost, at, 500)):
                    if kept:
                        good.append(k)
                        texts.append(cleaned)
                part = part.take(pa.array(good, pa.int64()))
                for name, values in (("text", pa.array(texts, pa.string())), ("n_chars", pa.array([len(t) for t in texts], pa.int64()))):
                    if name in part.schema.names:
                        part = part.set_column(part.schema.get_field_index(name), name, values.cast(part.schema.field(name).type))
                yield part

    return documents.mapInArrow(run, documents.schema)


_LIST = ", ".join("'" + s + "'" for s in SEPARATORS)
_PHRASES = "|".join(re.escape(x).replace(r"\ ", " ") for x in BOILERPLATE)
ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, line, k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), filled AS (
  SELECT *, len(words) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again FROM lines WHERE len(words) > 0
), judged AS (
  SELECT doc_id, n, again,
    len(list_filter(words, lambda w: w IN ({_LIST}))) AS separators,
    len(list_filter(words, lambda w: regexp_matches(w, '{_MARKS}'))) AS marked,
    len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w)) AS loud,
    regexp_matches(lower(line), '{_PHRASES}') AS furniture,
    CASE WHEN n < 8 THEN regexp_matches(words[-1], '{_END.replace("'", "''")}') ELSE regexp_matches(line, '{_INNER}') END AS ends
  FROM filled
), per_doc AS (
  SELECT doc_id, sum(n) AS n_words, sum(again::INT) AS n_dup_lines,
    sum(CASE WHEN (separators >= 2 AND separators * 5 >= n) OR (marked >= 2 AND marked * 5 >= n) OR (n >= 5 AND loud * 2 >= n) OR furniture OR NOT ends
        THEN n ELSE 0 END) AS lost_words
  FROM judged GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL)
), three AS (
  SELECT doc_id, p, w, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), often AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM three WHERE w2 IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM often WHERE twice) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
    coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_words <= {MAX_LOST} * n_words AS kept
FROM base
"""
