"""Line-first quality rules: lines are judged one by one, failures go, and a document that loses too much of its text goes as a whole.

Words are maximal runs of anything but space and U+0009..U+000D. All counting is exact and runs over whole texts.

A line with words fails if it is full of marks, bars, separators or links, has no letter or digit, is in capitals, stutters,
has a phrase of boilerplate, or is one of a run of short lines without end marks (a menu). Failed lines go, and all their
words count as lost: a document that loses more than MAX_LOST_PERCENT of its words, one notice aside (see NOTICE_WORDS), or
all of them, is rejected. `cleaned` is what is left.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged alike, one by one;
a null doc_id passes through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fields_of, map_chunks, rows_of, text_of

SPACES = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Marks that fill junk lines; the bar is the navigation rule's.
MARKS = b"#*$%&<>!"
#: What stands between the entries of a navigation line, as words of their own.
SEPARATORS = ("|", "/", "\\", ">", "-", "»", "›", "·", "•")
#: Marks that a line of running text ends with.
ENDS = ".!?:;,\"')"
LINKS = ("http://", "https://", "www.")
#: Phrases of boilerplate lines, in ASCII lower case.
BOILERPLATE = (
    b"all rights reserved",
    b"licensed under",
    b"terms of service",
    b"privacy policy",
    b"cookie policy",
    b"accept cookies",
    b"enable javascript",
    b"subscribe to our newsletter",
    b"click here",
    b"lorem ipsum",
)
#: Phrases that make a line of at most SHORT_LINE words boilerplate.
SHORT_BOILERPLATE = (
    b"back to top",
    b"continue reading",
    b"copyright",
    b"follow us",
    b"log in",
    b"powered by",
    b"read more",
    b"share this",
    b"sign up",
    b"skip to content",
    b"terms of use",
)
SHORT_LINE = 10
#: Lines of at most MENU_WORDS words without an end mark, MENU_LINES or more in a row, are a menu.
MENU_WORDS = 3
MENU_LINES = 4
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
#: One boilerplate line of at most this many words, the longest of them, is a notice that a good text may have whatever its
#: length: it goes, and counts in n_lost_words, but the verdict doesn't hold it against the text.
NOTICE_WORDS = 15
WINDOW = 5

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_failed_lines long, n_left_words long, cleaned string"


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document, how many words stand in windows of `window` words that its text holds twice or more.

    codes: word numbers, equal for equal words; doc: each word's document, ascending.
    """
    out = np.zeros(n_docs, np.int64)
    if len(codes) < window:
        return out
    n = len(codes) - window + 1
    inside = doc[:n] == doc[window - 1 :]
    key = codes[:n].astype(np.uint64)
    for k in range(1, window):
        key = _mix(key) + codes[k : n + k].astype(np.uint64)
    key = _mix(key) + doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(inside)
    order = np.argsort(_mix(key[at]), kind="stable")
    ranked = _mix(key[at])[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    edge = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_SEPARATOR_WORDS = frozenset(x.encode() for x in SEPARATORS)
_END_BYTES = frozenset(ENDS.encode())
_LINK_STARTS = tuple(x.encode() for x in LINKS)
_WORDLIKE = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_CAPITAL = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))


def is_boilerplate(line: bytes, n: int) -> bool:
    """Licence and site phrases."""
    low = line.lower()
    return any(p in low for p in BOILERPLATE) or (n <= SHORT_LINE and any(p in low for p in SHORT_BOILERPLATE))


def is_junk(line: bytes, words: list[bytes]) -> bool:
    """The rules of a line that has words: marks, bars, separators, links, capitals, no letters or digits, stuttering."""
    n = len(words)
    marks = len(line) - len(line.translate(None, MARKS))
    if marks >= 3 and marks >= n:
        return True
    bars = line.count(b"|")
    if bars >= 3 and 4 * bars >= n:
        return True
    between = sum(w in _SEPARATOR_WORDS for w in words)
    if between >= 2 and 3 * between >= n:
        return True
    if b"://" in line or b"www." in line:
        if 2 * sum(w.startswith(_LINK_STARTS) for w in words) >= n:
            return True
    if _WORDLIKE.search(line) is None:
        return True
    if n >= 4:
        capitals = len(line) - len(line.translate(None, _CAPITAL))
        if capitals >= 10 and capitals > 4 * (len(line) - len(line.translate(None, _SMALL))):
            return True
        if len(set(words)) * 10 <= 9 * n and 10 * sum(map(bytes.__eq__, words[1:], words[:-1])) >= 4 * n:
            return True
    return False


def is_entry(words: list[bytes]) -> bool:
    """Whether a line may be an entry of a menu that has one to a line."""
    return len(words) <= MENU_WORDS and words[-1][-1] not in _END_BYTES


def _menus(entries: list[bool]) -> list[int]:
    """The places, among lines with words, of entries that stand MENU_LINES or more in a row."""
    out: list[int] = []
    start = 0
    for k in range(len(entries) + 1):
        if k == len(entries) or not entries[k]:
            if k - start >= MENU_LINES:
                out += range(start, k)
            start = k + 1
    return out


def _judge(carry: tuple[str, ...] = ()):
    def work(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lost_words", "n_failed_lines", "n_left_words", "cleaned")}
        numbers: dict[bytes, int] = {}
        codes: list[int] = []
        notices: list[int] = []
        number = numbers.setdefault
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            total = dups = notice = 0
            seen: set[bytes] = set()
            lines = raw.split(b"\n")
            sizes: list[int] = []  # words of each line that has any
            places: list[int] = []
            fails: list[bool] = []
            entries: list[bool] = []
            for at, line in enumerate(lines):
                words = line.split()
                if not words:
                    continue
                dups += line in seen
                seen.add(line)
                n = len(words)
                total += n
                sizes.append(n)
                places.append(at)
                entries.append(is_entry(words))
                junk = is_junk(line, words)
                phrase = not junk and is_boilerplate(line, n)
                fails.append(junk or phrase)
                if phrase and notice < n <= NOTICE_WORDS:
                    notice = n
                codes += [number(w, len(numbers)) for w in words]
            for k in _menus(entries):
                fails[k] = True
            gone = {p for p, f in zip(places, fails, strict=True) if f}
            lost = sum(n for n, f in zip(sizes, fails, strict=True) if f)
            notices.append(notice)
            out["n_words"].append(total)
            out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
            out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
            out["n_dup_lines"].append(dups)
            out["n_lost_words"].append(lost)
            out["n_failed_lines"].append(len(gone))
            out["n_left_words"].append(total - lost)
            out["cleaned"].append(b"\n".join([x for k, x in enumerate(lines) if k not in gone]).decode("utf-8", "surrogatepass") if gone else text)
        n = np.array(out["n_words"], np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        repeats = repeated_words(np.array(codes, np.int64), doc, len(n))
        failed_base = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        against = np.array(out["n_lost_words"], np.int64) - np.array(notices, np.int64)
        kept = ~failed_base & (100 * against <= MAX_LOST_PERCENT * n) & (np.array(out["n_left_words"]) > 0)
        return out | {"doc_id": batch.column("doc_id"), "n_repeat_words": repeats, "base_failed": failed_base, "kept": kept} | {c: batch.column(c) for c in carry}

    return work


def judge_documents(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the base counts, both verdicts, the text without its failed lines (`cleaned`), and columns to carry along."""
    docs = rows_of(documents, *dict.fromkeys(("doc_id", "text", *carry)))
    return map_chunks(docs if "text" in carry else docs.withColumn("text", text_of()), SCHEMA + fields_of(docs, carry), lambda: _judge(carry))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cleaned")


_PHRASES = " OR ".join(f"contains(low, '{p.decode()}')" for p in BOILERPLATE)
_SHORT_PHRASES = " OR ".join(f"contains(low, '{p.decode()}')" for p in SHORT_BOILERPLATE)
_SEPARATOR_LIST = ", ".join(f"'{x}'" for x in SEPARATORS)
_END_LIST = ", ".join("'" + x.replace("'", "''") + "'" for x in ENDS)
_LINK_TEST = " OR ".join(f"starts_with(w, '{x}')" for x in LINKS)

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l1 AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM l0),
l2 AS (SELECT r, i, len(lw) AS n, nth, row_number() OVER (PARTITION BY r ORDER BY i) AS place, low,
         len(regexp_replace(line, '[^#*$%&<>!]', '', 'g')) AS marks, len(regexp_replace(line, '[^|]', '', 'g')) AS bars,
         len(list_filter(lw, lambda w: list_contains([{_SEPARATOR_LIST}], w))) AS separators, len(list_filter(lw, lambda w: {_LINK_TEST})) AS links,
         len(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals, len(regexp_replace(line, '[^a-z]', '', 'g')) AS smalls,
         regexp_matches(line, '[0-9A-Za-z]') OR regexp_matches(line, '[^\x00-\x7F]') AS wordlike, len(lw) <= {MENU_WORDS} AND NOT list_contains([{_END_LIST}], right(lw[-1], 1)) AS entry,
         len(list_filter(range(2, len(lw) + 1), lambda k: lw[k] = lw[k - 1])) AS twins, len(list_distinct(lw)) AS kinds
       FROM l1 WHERE len(lw) > 0),
l3 AS (SELECT *, (marks >= 3 AND marks >= n) OR (bars >= 3 AND 4 * bars >= n) OR (separators >= 2 AND 3 * separators >= n) OR (links > 0 AND 2 * links >= n) OR NOT wordlike
         OR (n >= 4 AND capitals >= 10 AND capitals > 4 * smalls) OR (n >= 4 AND kinds * 10 <= 9 * n AND 10 * twins >= 4 * n) AS junk,
         {_PHRASES} OR (n <= {SHORT_LINE} AND ({_SHORT_PHRASES})) AS phrase, place - row_number() OVER (PARTITION BY r, entry ORDER BY i) AS island FROM l2),
l4 AS (SELECT r, nth, n, CASE WHEN phrase AND NOT junk AND n <= {NOTICE_WORDS} THEN n END AS notice, junk OR phrase OR (entry AND count(*) OVER (PARTITION BY r, entry, island) >= {MENU_LINES}) AS failed FROM l3),
l AS (SELECT r, coalesce(max(notice), 0) AS notice, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(n) FILTER (failed), 0)::BIGINT AS n_lost_words, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (NOT failed), 0)::BIGINT AS n_left_words FROM l4 GROUP BY r),
g AS (SELECT r, k, hash(ws[k], ws[k + 1], ws[k + 2], ws[k + 3], ws[k + 4]) AS gram, ws[k : k + 4] AS exact FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS k FROM w)),
t AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, gram, exact) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM t) GROUP BY r),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(l.n_lost_words, 0)::BIGINT AS n_lost_words, coalesce(l.n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(l.n_left_words, 0)::BIGINT AS n_left_words, coalesce(l.notice, 0) AS notice
      FROM w LEFT JOIN l USING (r) LEFT JOIN c USING (r))
SELECT * EXCLUDE (notice), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * (n_lost_words - notice) <= {MAX_LOST_PERCENT} * n_words AND n_left_words > 0 AS kept
FROM b
"""
