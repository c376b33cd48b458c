"""Packing tokenized documents into sequences by linear grouping.

The plan is made from the histogram of piece lengths, which has at most `capacity` rows however large the corpus is:

1. Large lengths, sorted, are cut into groups of equal cardinality, and each is rounded up to its group's largest.
2. Over these few sizes, configurations (how many of each size share a sequence) are chosen to fill sequences: always
   the largest size left with the fullest complement that a bounded subset-sum search finds, as often as counts allow.
3. Actual pieces take the places of the rounded ones, and what rounding wasted is free again.
4. Small pieces go best-fit into the free places, largest first, and into sequences of their own at last.

This is done for several numbers of groups, and the plan with the fewest sequences counts. A piece's place follows from its rank among the pieces of its length, so nothing but counts is
gathered. Ranks are counted in shards, of each length the square root of its count, so no length is ranked in one task.

Defined cases: a null or empty text is the end token alone; rows that share a doc_id, and repeated rows, are packed one by
one; a null doc_id passes through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, WordCache, Words
from .common import map_chunks, materialize, rows_of, text_of

CAPACITY = 1024
END = 2
#: Pieces up to this share of a sequence are small.
SMALL = 1 / 4
#: Numbers of groups that are tried; the finest leaves two lengths a group where all lengths up to 1024 occur.
GROUPS = (128, 256, 512)

Slots = dict[int, int]


def cut_pieces(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids of each piece. Only documents over the capacity are cut; the first piece takes the rest."""

    def make():
        cache = WordCache(Words(vocabulary))
        stop = np.array([end], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = cache.ids_of(text or "") + stop
                n = len(raw) // 4
                at, size, k = 0, n % capacity or capacity, 0
                while at < n:
                    own = raw[4 * at : 4 * (at + size)]
                    for key, value in zip(out, (doc_id, k, at, size, zlib.crc32(own), own), strict=True):
                        out[key].append(value)
                    at, size, k = at + size, capacity, k + 1
            return out

        return work

    docs = rows_of(documents, "doc_id", "text").withColumn("text", text_of())
    return map_chunks(docs, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary", make)


def _round_up(large: list[tuple[int, int]], groups: int) -> dict[int, int]:
    """length -> the largest length of its group; large: (length, count), lengths descending. A length lies in one group."""
    share, out, filled, top = sum(c for _, c in large) / groups, {}, 0.0, 0
    for length, count in large:
        if not top or filled >= share:
            top, filled = length, 0.0
        out[length] = top
        filled += count
    return out


def _complement(sizes: list[int], left: Counter, room: int) -> list[int]:
    """Sizes, within their counts, whose sum is the largest not above room; sizes descending."""
    if left.get(room):
        return [room]
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sizes:
        most = min(left[size], room // size) if size <= room else 0
        for _ in range(most):
            grown = (reach | reach << size) & full
            if grown == reach:
                break
            steps.append((size, reach))
            reach = grown
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> best & 1:
            out.append(size)
            best -= size
    return out


def _configure(counts: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """(configuration, times) that use up the counts."""
    left, out = Counter({k: v for k, v in counts.items() if v}), []
    sizes = sorted(left, reverse=True)
    while sizes:
        top = sizes[0]
        left[top] -= 1
        config = Counter([top, *_complement(sizes, left, capacity - top)])
        left[top] += 1
        times = min(left[s] // k for s, k in config.items())
        for s, k in config.items():
            left[s] -= k * times
        out.append((config, times))
        sizes = [s for s in sizes if left[s]]
    return out


def _substitute(configs: list[tuple[Counter, int]], rounded: dict[int, int], counts: dict[int, int]) -> list[tuple[Counter, int]]:
    """The configurations with actual lengths in place of rounded sizes, longest first."""
    stock: dict[int, list[list[int]]] = defaultdict(list)
    for length in sorted(rounded, reverse=True):
        stock[rounded[length]].append([length, counts[length]])
    out = []
    for config, times in configs:
        while times:
            actual, most = Counter(), times
            for size, k in config.items():
                need, queue = k, stock[size]
                if queue[0][1] >= k:
                    most = min(most, queue[0][1] // k)
                    actual[queue[0][0]] += k
                    continue
                most = 1
                for length, there in queue:
                    took = min(need, there)
                    actual[length] += took
                    need -= took
                    if not need:
                        break
            for length, k in actual.items():
                queue = stock[rounded[length]]
                entry = next(x for x in queue if x[0] == length)
                entry[1] -= k * most
                if not entry[1]:
                    queue.remove(entry)
            out.append((actual, most))
            times -= most
    return out


def _best_fit(bins: list[tuple[Counter, int]], small: list[tuple[int, int]], capacity: int) -> list[tuple[Counter, int]]:
    """Small lengths, descending, each into the fullest bins that hold it; whole classes of equal bins at a time."""
    by_room: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for config, times in bins:
        by_room[capacity - sum(s * k for s, k in config.items())].append((config, times))
    for length, count in small:
        while count:
            room = min((r for r, own in by_room.items() if own and r >= length), default=None)
            if room is None:
                each = capacity // length
                if count >= each:
                    by_room[capacity - each * length].append((Counter({length: each}), count // each))
                    count %= each
                if count:
                    by_room[capacity - count * length].append((Counter({length: count}), 1))
                break
            config, times = by_room[room].pop()
            each = min(room // length, max(1, count))
            use = min(times, count // each)
            by_room[room - each * length].append((config + Counter({length: each}), use))
            if times > use:
                by_room[room].append((config, times - use))
            count -= each * use
    return [x for own in by_room.values() for x in own]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Slots, int]]:
    """(lengths with how often each stands in a sequence, number of such sequences), using up the histogram."""
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    edge = capacity * SMALL
    large = [(k, counts[k]) for k in sorted(counts, reverse=True) if k > edge]
    small = [(k, counts[k]) for k in sorted(counts, reverse=True) if k <= edge]
    best: list[tuple[Counter, int]] = []
    for groups in GROUPS:
        rounded = _round_up(large, groups)
        sizes: Counter = Counter()
        for length, count in large:
            sizes[rounded[length]] += count
        bins = _best_fit(_substitute(_configure(sizes, capacity), rounded, counts), small, capacity)
        if not best or sum(t for _, t in bins) < sum(t for _, t in best):
            best = bins
    return [(dict(config), times) for config, times in best]


def _lookup(bins: list[tuple[Slots, int]]) -> tuple[np.ndarray, ...]:
    """By length and rank: key of the first rank, first rank, how many a sequence, first sequence, first offset; sorted by key."""
    used: Counter = Counter()
    rows, first = [], 0
    for config, times in bins:
        offset = 0
        for length in sorted(config, reverse=True):
            each = config[length]
            rows.append((length, used[length], each, first, offset))
            used[length] += each * times
            offset += each * length
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(pieces: DataFrame, capacity: int = CAPACITY, columns: tuple[str, ...] = ("doc_id", "piece", "start", "length", "ids_crc32")) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be stored rows: they are read once for the counts and once more for the places."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    length, first_rank, each, sequence, offset = _lookup(plan(histogram, capacity))
    # as many shards as each then has rows, about: neither ranking a shard nor adding up its length's shards becomes one task's work
    shards = F.lit([1 + math.isqrt(histogram.get(k, 0)) for k in range(max(histogram, default=0) + 1)])
    dealt = pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "start"), F.get(shards, F.col("length").cast("int")).cast("long")).alias("shard"))
    per = dealt.groupBy("length", "shard").count()
    base = per.select(F.col("length").alias("b_length"), F.col("shard").alias("b_shard"), (F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(base, (F.col("length") == F.col("b_length")) & (F.col("shard") == F.col("b_shard")))
    ranked = ranked.select(*columns, (F.col("base") + F.col("own") - 1).alias("rank"))
    fields = [f for f in pieces.select(*columns).schema.simpleString()[7:-1].split(",")]
    ddl = ", ".join(f.replace(":", " ", 1) for f in fields) + ", sequence_id long, offset long"
    step = np.int64(1) << 44
    keys = length * step + first_rank

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size * step + rank, "right") - 1
            nth = rank - first_rank[at]
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * size)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ddl)


def pack_documents(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return pack(materialize(cut_pieces(documents, vocabulary, capacity).drop("ids"), "pieces"), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
