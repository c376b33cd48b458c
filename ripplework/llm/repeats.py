"""Removal of byte passages that stand anywhere else, by depth-limited most-significant-digit passes over suffixes.

Only the first WINDOW bytes of a suffix matter: suffixes that agree on them are the repeated windows. Writing a digit of
every suffix down would move many times the input, so the first pass takes few suffixes:

1. An anchor is a place whose GRAM leading bytes are least (by hash; leftmost of equals) among those that lie in one window
   of WINDOW bytes. Every window holds one, and equal windows hold it at the same place. Only the anchors' suffixes are
   sorted, by these leading bytes as one digit; the windows of an anchor go with it as one run. A digit that only one run
   has ends there: its windows stand nowhere else. A block sends at most ONE_DIGIT different runs of a digit there; its
   others are known to share the digit and go on to the last pass at once.
2. The second digit is the run's bytes as a whole. Runs that agree are equal window by window: all their windows repeat.
3. What is left are runs that share the first digit with others but not all their bytes, at the edges of passages. All
   suffixes that start in them are dealt and sorted by the digit of their leading WINDOW / 2 bytes and the digit of the
   next WINDOW / 2, which is the full depth; equal groups of two or more are repeats.

Equal windows agree on every digit wherever they stand, so nothing is missed. Digits are 64-bit hashes of their bytes, as no
order among unequal ones matters; groups of the last pass agree on two of them. Texts are named by 128 bits; equal texts
are one text with a count. Any byte under a repeated window goes.

A bucket is sorted in memory, so buckets are counted by the bytes that are dealt (BUCKET_BYTES each), not by input splits.

Defined cases: a null or empty text has no bytes; texts under WINDOW bytes stay whole; rows that share a doc_id are
separate documents; a null doc_id passes through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, materialize, rows_of, text_of
from .windows import Rolling, runs

WINDOW = 200
GRAM = 100
#: Windows of a longer text are taken in segments of this many; a cut run is settled by the last pass.
SEGMENT = 1 << 20
BLOCK_BYTES = 4 << 20
#: Rows that a block deals at once, a segment's more at most.
BLOCK_ROWS = 1 << 18
#: Bytes of packed rows in a bucket; a bucket takes its task some ten times as many.
BUCKET_BYTES = 8 << 20
MIN_BUCKETS = 16
#: Bytes of a packed row: two digits, the text's name, one or two numbers.
RUN_BYTES, START_BYTES = 40, 36
#: Different runs of one first digit that a block sends to the digit's bucket; two at least.
ONE_DIGIT = 8


def deal(bucket: np.ndarray, **columns: np.ndarray) -> dict[str, list]:
    """Rows of packed columns, one for each bucket that has any."""
    if not len(bucket):
        return {k: [] for k in ("bucket", *columns)}
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out: dict[str, list] = {"bucket": bucket[np.concatenate([[0], cuts])].tolist()}
    for name, values in columns.items():
        out[name] = [x.tobytes() for x in np.split(values[order], cuts)]
    return out


def _joined(part: pd.DataFrame, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(part[name]), kind)


def _segments(raws: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the segments, in the texts' concatenation."""
    text, begin, end, at = [], [], [], 0
    for i, raw in enumerate(raws):
        for s in range(0, max(1, len(raw) - window + 1), SEGMENT):
            text.append(i)
            begin.append(at + s)
            end.append(at + min(len(raw), s + SEGMENT + window - 1))
        at += len(raw)
    return np.array(text, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


def _groups(rest: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its rank (from 0, in no order of note) among the rows that agree with it on both digits, and the rank of
    its pair of digits among those of its first."""
    order = np.lexsort((rest, digit))
    top = np.ones(len(order), bool)
    top[1:] = digit[order][1:] != digit[order][:-1]
    new = top.copy()
    new[1:] |= rest[order][1:] != rest[order][:-1]
    at, pair = np.arange(len(order)), np.cumsum(new)
    rank, nth = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    nth[order] = pair - np.maximum.accumulate(np.where(top, pair, 0))
    return rank, nth


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of text names (rows of two words), equal for equal names, and the name of each number."""
    if not len(names):
        return np.zeros(0, np.int64), names
    order = np.lexsort((names[:, 1], names[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (names[order][1:] != names[order][:-1]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, names[order][new]


def deal_digits(digit: np.ndarray, rest: np.ndarray, names: np.ndarray, n_buckets: int, pairs: int | None = None, **columns: np.ndarray) -> dict[str, list]:
    """Rows for the buckets of their digits; with pairs, of their first digit. told is 0 there.

    Of rows that agree on all digits, two are enough there, as they tell all others; the rest are known to repeat, and go to
    their text's bucket (told 1). Of a first digit's different pairs, `pairs` are enough, as they tell that there are others;
    the rest go to their text's bucket to be looked through by the last pass (told 2). So a passage that many documents
    share isn't one bucket's work: what it gets are 2 * pairs rows a block.
    """
    bucket = ((digit if pairs else digit ^ rest) >> np.uint64(20)) % np.uint64(n_buckets)
    rank, nth = _groups(rest, digit)
    told = np.where(rank >= 2, 1, np.where(nth >= pairs, 2, 0) if pairs else 0)
    bucket = np.where(told > 0, names[:, 0] % np.uint64(n_buckets), bucket).astype(np.int64)
    out: dict[str, list] = {}
    for k in range(3):
        m = told == k
        part = deal(bucket[m], one=digit[m], two=rest[m], tid=names[m], **{c: v[m] for c, v in columns.items()})
        for c, v in (part | {"told": [k] * len(part["bucket"])}).items():
            out.setdefault(c, []).extend(v)
    return out


def deal_found(names: np.ndarray, n_buckets: int, **columns: np.ndarray) -> pd.DataFrame:
    """What a bucket has found, packed for the buckets of its texts: a row for each of these, not for each text."""
    return pd.DataFrame(deal(((names[:, 0] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64), tid=names, **columns))


def _bucket_count(n_bytes: float) -> int:
    return max(MIN_BUCKETS, math.ceil(n_bytes / BUCKET_BYTES))


def find_runs(raws: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, first window (in its text), number of windows, first digit, second digit of all runs of the texts, by buffers."""
    text, begin, end = _segments(raws, window)
    data = np.frombuffer(b"".join(raws), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    k = 0
    while k < len(text):  # buffers of a bounded size, whole segments each
        last = k + 1
        while last < len(text) and end[last] - begin[k] <= SEGMENT + 2 * window:
            last += 1
        base = begin[k]
        own, first, count, one, two = runs(Rolling(data[base : end[last - 1]]), begin[k:last] - base, end[k:last] - base, window, gram)
        which = text[k:last][own]
        yield which, first + base - starts[which], count, one, two
        k = last


def _blocks(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The parts joined to blocks of BLOCK_ROWS rows or a little more."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BLOCK_ROWS:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _shared_runs(docs: DataFrame, n_buckets: int, window: int, gram: int) -> DataFrame:
    """(tid, full, open, n_open): each text's runs (bytes; first, count as 32-bit numbers) that repeat whole, those that may in part, and how many windows these have."""

    def make():
        seen: set[bytes] = set()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            raws, tids = [], []
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if tid not in seen:
                    seen.add(tid)
                    raws.append(_raw(text))
                    tids.append(tid)
            names = np.frombuffer(b"".join(tids), "<u8").reshape(-1, 2)
            for own, first, count, one, two in _blocks(find_runs(raws, window, gram)):
                yield deal_digits(one, two, names[own], n_buckets, ONE_DIGIT, first=first.astype(np.uint32), count=count.astype(np.uint32))

        return work

    def sort_out(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("told", kind="stable")
        told = np.repeat(part["told"].to_numpy(), part["one"].map(len).to_numpy() // 8)
        one, two = _joined(part, "one", "<u8"), _joined(part, "two", "<u8")
        tid, texts = _numbered(_joined(part, "tid", "<u8").reshape(-1, 2))
        first, count = _joined(part, "first", "<u4"), _joined(part, "count", "<u4")
        del part
        known, spare = ((tid[told == k], np.stack([first[told == k], count[told == k]], 1)) for k in (1, 2))
        n = int((told == 0).sum())
        one, two, tid, first, count = one[:n], two[:n], tid[:n], first[:n], count[:n]
        order = np.lexsort((first, tid, two, one))
        one, two, tid, first, count = one[order], two[order], tid[order], first[order], count[order]
        new = np.ones(len(one), bool)  # a text can come from several tasks
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (tid[1:] != tid[:-1]) | (first[1:] != first[:-1])
        one, two, tid, first, count = one[new], two[new], tid[new], first[new], count[new]
        alike = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        full = np.zeros(len(one), bool)
        full[1:] |= alike
        full[:-1] |= alike
        near = one[1:] == one[:-1]
        digit = np.zeros(len(one), bool)
        digit[1:] |= near
        digit[:-1] |= near
        # a run that repeats whole can still hold the partner of an open one, of a block's spare ones too: one of each kind is enough
        opens = digit & ~full
        group = np.cumsum(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
        lead = np.ones(len(one), bool)
        lead[1:] = ~alike
        opens |= full & lead & (np.bincount(group, lead)[group] > 1)
        pairs = np.stack([first, count], 1) if len(one) else np.zeros((0, 2), np.uint32)
        whose = np.concatenate([tid[full], known[0], tid[opens], spare[0]])
        own = np.concatenate([pairs[full], known[1], pairs[opens], spare[1]])
        kind = np.repeat(np.array([0, 1], np.uint8), [int(full.sum()) + len(known[0]), int(opens.sum()) + len(spare[0])])
        order = np.lexsort((own[:, 0], whose))
        return deal_found(texts[whose[order]], n_buckets, first=own[order, 0], count=own[order, 1], open=kind[order])

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        tid, texts = _numbered(_joined(part, "tid", "<u8").reshape(-1, 2))
        key = 2 * tid + _joined(part, "open", "u1")
        pairs = np.stack([_joined(part, "first", "<u4"), _joined(part, "count", "<u4")], 1)
        order = np.lexsort((pairs[:, 0], key))
        key, pairs = key[order], pairs[order]
        new = np.ones(len(key), bool)  # a text can come from several tasks
        new[1:] = (key[1:] != key[:-1]) | (pairs[1:] != pairs[:-1]).any(1)
        key, pairs = key[new], pairs[new]
        keys, begin = np.unique(key, return_index=True)
        out: dict[int, list] = {}
        for k, own in zip(keys.tolist(), np.split(pairs, begin[1:]), strict=True):
            has = out.setdefault(k // 2, [b"", b"", 0])
            has[k % 2] = own.tobytes()
            has[2] = k % 2 * int(own[:, 1].sum(dtype=np.int64))
        return pd.DataFrame({"tid": [texts[k].tobytes() for k in out], "full": [x[0] for x in out.values()], "open": [x[1] for x in out.values()], "n_open": [x[2] for x in out.values()]})

    dealt = map_chunks(docs, "bucket int, one binary, two binary, tid binary, first binary, count binary, told int", make, limit=BLOCK_BYTES)
    found = dealt.groupBy("bucket").applyInPandas(sort_out, "bucket int, tid binary, first binary, count binary, open binary")
    return found.groupBy("bucket").applyInPandas(gather, "tid binary, full binary, open binary, n_open long")


def _repeated_windows(texts: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """(tid, at: bytes): starts of windows in open runs that stand twice or more. texts: tid, text, open."""

    def make():
        seen: set[bytes] = set()

        def digits(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for tid, text, opens in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), batch.column("open").to_pylist(), strict=True):
                if not opens or tid in seen:
                    continue
                seen.add(tid)
                spans = np.frombuffer(opens, "<u4").reshape(-1, 2).astype(np.int64)
                raw = np.frombuffer(_raw(text), np.uint8)
                for own in np.split(spans, np.flatnonzero(np.diff(spans[:, 0] // SEGMENT)) + 1):
                    base, total = own[0, 0], np.cumsum(own[:, 1])
                    rolling = Rolling(raw[base : own.sum(1).max() - 1 + window])
                    at = np.arange(int(total[-1])) + np.repeat(own[:, 0] - base - total + own[:, 1], own[:, 1])
                    rests = rolling.ranges(at + window // 2, at + window)
                    yield rolling.ranges(at, at + window // 2), rests, np.tile(np.frombuffer(tid, "<u8"), (len(at), 1)), (at + base).astype(np.uint32)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for lead, rest, names, at in _blocks(digits(batch)):
                yield deal_digits(lead, rest, names, n_buckets, at=at)

        return work

    def sort_out(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("told", kind="stable")
        lead, rest, at = _joined(part, "one", "<u8"), _joined(part, "two", "<u8"), _joined(part, "at", "<u4")
        tid, texts = _numbered(_joined(part, "tid", "<u8").reshape(-1, 2))
        n = sum(map(len, part["at"][part["told"] == 0])) // 4
        del part
        told = tid[n:], at[n:]
        order = np.lexsort((at[:n], tid[:n], rest[:n], lead[:n]))
        lead, rest, tid, at = lead[order], rest[order], tid[order], at[order]
        same = (lead[1:] == lead[:-1]) & (rest[1:] == rest[:-1])
        new = np.ones(len(lead), bool)
        new[1:] = ~(same & (tid[1:] == tid[:-1]) & (at[1:] == at[:-1]))
        lead, rest, tid, at = lead[new], rest[new], tid[new], at[new]
        same = (lead[1:] == lead[:-1]) & (rest[1:] == rest[:-1])
        twice = np.zeros(len(lead), bool)
        twice[1:] |= same
        twice[:-1] |= same
        tid, at = np.append(tid[twice], told[0]), np.append(at[twice], told[1])
        order = np.lexsort((at, tid))
        return deal_found(texts[tid[order]], n_buckets, at=at[order])

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        tid, texts = _numbered(_joined(part, "tid", "<u8").reshape(-1, 2))
        at = _joined(part, "at", "<u4")
        order = np.lexsort((at, tid))
        names, begin = np.unique(tid[order], return_index=True)
        return pd.DataFrame({"tid": [texts[k].tobytes() for k in names.tolist()], "at": [x.tobytes() for x in np.split(at[order], begin[1:])]})

    dealt = map_chunks(texts, "bucket int, one binary, two binary, tid binary, at binary, told int", make, limit=BLOCK_BYTES)
    found = dealt.groupBy("bucket").applyInPandas(sort_out, "bucket int, tid binary, at binary")
    return found.groupBy("bucket").applyInPandas(gather, "tid binary, at binary")


def covered(n_bytes: int, full: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(start, end) of the maximal stretches under repeated windows. full: (first, count) runs; at: single starts."""
    edge = np.zeros(n_bytes + 1, np.int64)
    np.add.at(edge, full[:, 0], 1)
    np.add.at(edge, full[:, 0] + full[:, 1] - 1 + window, -1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns.reshape(-1, 2)


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of what is removed, kept (binary)."""
    docs = rows_of(documents, "doc_id", "text").withColumn("text", text_of())
    docs = docs.select("doc_id", "text", F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b"")).alias("tid"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = _bucket_count(n_bytes * RUN_BYTES * 2 / (window - gram + 2))  # runs begin once in half the grams of a window
    shared = materialize(_shared_runs(docs.select("tid", "text"), n_buckets, window, gram), "repeat-runs")
    n_open = shared.agg(F.sum("n_open")).first()[0] or 0
    opens = shared.select(F.col("tid").alias("o_tid"), "open").where(F.length("open") > 0)
    # both joins below read one exchange of the texts: the same columns, the same key
    asking = docs.join(opens, docs["tid"] == F.col("o_tid")).select("doc_id", "text", "tid", "open")
    single = _repeated_windows(asking, _bucket_count(n_open * START_BYTES), window).select(F.col("tid").alias("w_tid"), "at")
    counts = docs.select(F.col("tid").alias("c_tid")).groupBy("c_tid").count().where("count > 1")
    fulls = shared.select(F.col("tid").alias("f_tid"), "full")
    cover = fulls.join(single, F.col("f_tid") == F.col("w_tid"), "full").select(F.coalesce("f_tid", "w_tid").alias("tid"), "full", "at")
    cover = cover.join(counts, F.col("tid") == F.col("c_tid"), "full").select(F.coalesce("tid", "c_tid").alias("v_tid"), *(F.when(F.col("count").isNull(), F.col(c)).alias(c) for c in ("full", "at")), F.col("count").isNotNull().alias("copied"))
    joined = docs.join(cover, docs["tid"] == F.col("v_tid"), "left").select("doc_id", "text", "tid", "full", "at", "copied")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept")}
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "full", "at", "copied")), strict=True):
                doc_id, text, full, at, copied = row
                raw = _raw(text)
                spans = np.zeros((0, 2), np.int64)
                if copied and len(raw) >= window:
                    spans = np.array([[0, len(raw)]])
                elif full or at:
                    spans = covered(len(raw), np.frombuffer(full or b"", "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(at or b"", "<u4").astype(np.int64), window)
                last, kept = 0, []
                for a, b in spans.tolist():
                    kept.append(raw[last:a])
                    last = b
                rest = b"".join([*kept, raw[last:]])
                values = (doc_id, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans[:, 0].tolist(), spans[:, 1].tolist(), rest)
                for to, x in zip(out.values(), values, strict=True):
                    to.append(x)
            return out

        return work

    return map_chunks(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary", make)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts", "ends", "kept")
