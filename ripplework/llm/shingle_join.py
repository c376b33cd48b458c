"""Exact Jaccard join of documents on word shingles through prefix trees.

Two documents link when 100 * |intersection| >= 75 * |union| of their shingle sets. The plan, every step linear in what it reads:

1. Equal sets become one, known by its hash; only their number and least doc_id go on.
2. A global order puts frequent shingles last: those in a fair share of the documents (see `_frequent`, whose table is
   bounded by the documents' mean size) by frequency, all others by hash. Any order gives right results.
3. Linked sets share at least `spare(n)` of their first `prefix(n)` shingles. Prefixes are dealt by shingle, and a set goes
   on only if enough of its prefix stands in other sets as well. Most sets end here.
4. Each set that goes on has a home, the least set it shares a prefix shingle with. A set is a guest at the homes whose
   sets share enough of its prefix with it in all, and have a fitting length, which covers every possible link without
   writing down pairs.
5. In each home, the sets are stored in a prefix tree in the global order, frequent shingles first, so that copies share
   long paths. A query goes down all branches at once, carries the overlap so far along shared paths, and leaves a subtree
   when its bounds on what may still match, on either side, can't reach the overlap that its sets' lengths ask for.
   Large homes are split on both sides into cells of CELL sets.
6. Each cell reports its links as a tree (each set with the least it is connected to), so that a group of copies costs
   rows in proportion to its members. Components come from these.

Defined cases: null, empty and blank texts have no shingles, and link with nothing; fewer than five words are one shingle;
rows that share a doc_id are told apart by their sets; a null doc_id counts as the greatest; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, input_tasks, map_chunks, materialize, rows_of, text_of
from .components import components
from .shingles import shingle_sets

PERCENT = 75
#: Share of a set, in percent, by which prefixes are longer than the least length that lets no link slip.
SPARE_PERCENT = 15
#: A shingle is frequent if it stands in one of this many documents.
FREQUENT_ONE_IN = 500
#: Stored sets, and queries, of one cell of a home.
CELL = 1000
BLOCK_BYTES = 3 << 20
#: Buckets of shingles at least. A set has a row in each bucket that its prefix meets, so few buckets would make rows grow with their number.
MIN_BUCKETS = 64
#: Survivors up to this number are sent to all tasks (16 bytes each); beyond it, texts are shuffled to them.
BROADCAST_ROWS = 500_000
_ID = "<i8"


def spare(n):
    """How many prefix shingles linked sets share at least, by the size of the set whose prefix ends first."""
    return np.minimum(np.maximum(1, -(-n * SPARE_PERCENT // 100)), -(-n * PERCENT // 100))


def prefix(n):
    return n - -(-n * PERCENT // 100) + spare(n)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _set_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def digests(docs: DataFrame, sets_of=shingle_sets) -> DataFrame:
    """Rows of two kinds: a document's (doc_id, key, id, n), and (token, n) for shingles that are frequent in a block."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = sets_of(batch.column("text").to_pylist())
            found = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            tokens, counts = np.unique(found, return_counts=True)
            often = counts >= max(3, len(sets) * 2 // FREQUENT_ONE_IN)
            tokens, counts = tokens[often].view(_ID).tolist(), counts[often].tolist()
            return {
                "doc_id": batch.column("doc_id").to_pylist() + [None] * len(tokens),
                "key": [set_key(s) if len(s) else b"" for s in sets] + [None] * len(tokens),
                "id": [_set_id(set_key(s)) if len(s) else None for s in sets] + [None] * len(tokens),
                "n": [len(s) for s in sets] + counts,
                "token": [None] * len(sets) + tokens,
                "text_hash": batch.column("text_hash").to_pylist() + [None] * len(tokens),
            }

        return work

    return map_chunks(docs, "doc_id long, key binary, id long, n long, token long, text_hash long", make, limit=BLOCK_BYTES)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their ranks. A document's shingles are distinct, so at most FREQUENT_ONE_IN times the mean set size qualify."""
    least = max(4, rows.where("key IS NOT NULL").count() // FREQUENT_ONE_IN)
    found = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, found["n"].to_numpy(np.int64)))] = np.arange(len(tokens))
    return tokens[order], rank[order]


def _ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set, rare shingles first."""
    known, rank = frequent
    if not len(known) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    often = known[at] == tokens
    if not often.any():
        return tokens
    return np.concatenate([tokens[~often], tokens[often][np.argsort(rank[at[often]])]])


def _deal(ids: list[int], sizes: list[int], heads: list[np.ndarray], extra: list[int], n_buckets: int) -> dict:
    """Prefix shingles packed by bucket: one row for each bucket that gets any."""
    names = ("bucket", "tokens", "ids", "sizes", "extra")
    if not ids:
        return {k: [] for k in names}
    tokens = np.concatenate(heads)
    owner = np.repeat(np.arange(len(ids)), [len(h) for h in heads])
    bucket = ((tokens >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    a_ids, a_sizes, a_extra = np.array(ids, np.int64), np.array(sizes, np.int32), np.array(extra, np.int64)
    parts = list(zip(np.split(tokens, cuts), np.split(owner, cuts), strict=True))
    out = {"bucket": bucket[np.concatenate([[0], cuts])].tolist() if len(bucket) else []}
    out["tokens"] = [t.tobytes() for t, _ in parts]
    out["ids"] = [a_ids[o].tobytes() for _, o in parts]
    out["sizes"] = [a_sizes[o].tobytes() for _, o in parts]
    out["extra"] = [a_extra[o].tobytes() for _, o in parts]
    return out if len(tokens) else {k: [] for k in names}


_DEALT = "bucket int, tokens binary, ids binary, sizes binary, extra binary"


def _lists(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of a bucket: for each (token, set) of a token in two sets or more, its list's number, set, size, extra; sorted by token and set."""
    tokens = np.frombuffer(b"".join(part["tokens"]), np.uint64)
    ids = np.frombuffer(b"".join(part["ids"]), np.int64)
    order = np.lexsort((ids, tokens))
    tokens, ids = tokens[order], ids[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
    order, tokens, ids = order[new], tokens[new], ids[new]
    same = tokens[1:] == tokens[:-1]
    shared = np.zeros(len(tokens), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order, tokens, ids = order[shared], tokens[shared], ids[shared]
    start = np.ones(len(tokens), bool)
    start[1:] = tokens[1:] != tokens[:-1]
    sizes = np.frombuffer(b"".join(part["sizes"]), np.int32)[order]
    extra = np.frombuffer(b"".join(part["extra"]), np.int64)[order]
    return np.cumsum(start) - 1, ids, sizes, extra


def _survivors(docs: DataFrame, frequent, n_buckets: int, sets_of=shingle_sets) -> DataFrame:
    """(id, n) of the sets with enough shared prefix shingles to be linked with anything."""

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> dict:
            ids, sizes, heads = [], [], []
            for tokens in sets_of(batch.column("text").to_pylist()):
                if len(tokens) and (own := _set_id(set_key(tokens))) not in seen:
                    seen.add(own)
                    ids.append(own)
                    sizes.append(len(tokens))
                    heads.append(_ordered(tokens, frequent)[: int(prefix(len(tokens)))])
            return _deal(ids, sizes, heads, [0] * len(ids), n_buckets)

        return work

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        _, ids, sizes, _ = _lists(part)
        own, first, counts = np.unique(ids, return_index=True, return_counts=True)
        out = pd.DataFrame({"id": own, "n": sizes[first].astype(np.int64), "c": counts.astype(np.int64)})
        del part, ids, sizes
        give_back()
        return out

    counted = map_chunks(docs, _DEALT, make, limit=BLOCK_BYTES).groupBy("bucket").applyInPandas(shared, "id long, n long, c long")
    total = counted.groupBy("id").agg(F.first("n").alias("n"), F.sum("c").alias("c"))
    return total.where(F.col("c") >= _least_shared("n")).select("id", "n")


def _least_shared(n: str):
    """How many prefix shingles a set of n shares at least with any set it is linked with: spare() of the least such set."""
    partner = F.floor((F.col(n) * PERCENT + 99) / 100)
    return F.greatest(F.lit(1), F.floor((partner * SPARE_PERCENT + 99) / 100))


def _ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The values at the places of all ranges, one after another."""
    size = end - begin
    total = np.cumsum(size)
    return values[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - total + size, size)]


class PrefixTree:
    """Sets as paths of rising numbers, equal beginnings shared; chains without branches are one node."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sizes = np.array([len(s) for s in sets], np.int64)
        parent, low, high, least, most, own, level = [], [], [], [], [], [], []
        common = [0] * (len(order) + 1)
        for k in range(1, len(order)):
            a, b = sets[order[k - 1]], sets[order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[k] = int(differ[0]) if len(differ) else m
        self.flat = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in order])]).astype(int).tolist()
        todo = [(0, len(order), 0, -1, 0)]
        while todo:
            first, last, depth, up, deep = todo.pop()
            k = first
            while k < last:  # children of `up`: runs that agree on the next number
                end = k + 1
                while end < last and common[end] > depth:
                    end += 1
                reach = min([common[j] for j in range(k + 1, end)], default=len(sets[order[k]]))
                reach = min(reach, len(sets[order[k]]))
                node = len(parent)
                members = [len(sets[order[j]]) for j in range(k, end)]
                parent.append(up)
                low.append(starts[k] + depth)
                high.append(starts[k] + reach)
                least.append(min(members))
                most.append(max(members))
                level.append(deep)
                here = k
                while here < end and len(sets[order[here]]) == reach:
                    here += 1
                own.append(order[k:here])
                if here < end:
                    todo.append((here, end, reach, node, deep + 1))
                k = end
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.least, self.most = np.array(least, np.int64), np.array(most, np.int64)
        self.own = own
        kids: list[list[int]] = [[] for _ in range(len(parent) + 1)]
        for node, up in enumerate(parent):
            kids[up + 1].append(node)
        self.tops = np.array(kids[0], np.int64)
        self.kid_flat = np.array([k for own_kids in kids[1:] for k in own_kids], np.int64)
        self.kid_start = np.concatenate([[0], np.cumsum([len(x) for x in kids[1:]])]).astype(np.int64)
        self.n_own = np.array([len(x) for x in own], np.int64)
        self.depth = np.zeros(len(parent), np.int64)
        for node in range(len(parent)):
            self.depth[node] = self.high[node] - self.low[node] + (self.depth[parent[node]] if parent[node] >= 0 else 0)

    def linked(self, query: np.ndarray, room: np.ndarray) -> tuple[list[int], int]:
        """Sets that link with the query, and how many nodes were entered. room: scratch, false for every number, true for none."""
        n, out, entered = len(query), [], 0
        room[query] = True
        front = self.tops
        overlap = np.zeros(len(front), np.int64)
        while len(front):
            fits = (100 * self.most[front] >= PERCENT * n) & (100 * n >= PERCENT * self.least[front])
            front, overlap = front[fits], overlap[fits]
            if not len(front):
                break
            entered += len(front)
            size = self.high[front] - self.low[front]
            ends = np.cumsum(size)
            hits = np.concatenate([[0], np.cumsum(room[_ranges(self.flat, self.low[front], self.high[front])])])
            overlap = overlap + hits[ends] - hits[ends - size]
            after = n - np.searchsorted(query, self.flat[self.high[front] - 1], "right")
            shortest = np.maximum(self.least[front], self.depth[front])
            most = overlap + np.minimum(after, self.most[front] - self.depth[front])
            stays = (100 + PERCENT) * most >= PERCENT * (n + shortest)
            front, overlap = front[stays], overlap[stays]
            # sets that end here are of the node's depth
            for node in front[(self.n_own[front] > 0) & ((100 + PERCENT) * overlap >= PERCENT * (n + self.depth[front]))].tolist():
                out += self.own[node]
            front, overlap = _ranges(self.kid_flat, self.kid_start[front], self.kid_start[front + 1]), np.repeat(overlap, self.kid_start[front + 1] - self.kid_start[front])
        room[query] = False
        return out, entered


def tree_finder(paths: list[np.ndarray], n_numbers: int):
    """Which of the paths link with a query: their prefix tree, walked."""
    tree, room = PrefixTree(paths), np.zeros(n_numbers, bool)
    return lambda query: tree.linked(query, room)[0]


def join_cell(ids: np.ndarray, sets: list[np.ndarray], stored: np.ndarray, asking: np.ndarray, at_home: np.ndarray, copies: np.ndarray, finder=tree_finder) -> tuple[list, list, list]:
    """Of one cell: (set, the least set it is connected with here, its links found here). sets: rare shingles first.

    A pair of one home is found from both its sides, and each side counts the other; a guest's pair is found once, and counts for both.
    """
    numbers, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.empty(len(numbers), np.int64)  # frequent shingles get low numbers: they come first on the paths
    rare = np.zeros(len(numbers), np.int64)
    np.add.at(rare, inverse, 1)
    place[np.lexsort((numbers, -rare))] = np.arange(len(numbers))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    paths = [np.sort(p) for p in np.split(place[inverse], cuts)]
    holds = np.flatnonzero(stored)
    find = finder([paths[i] for i in holds], len(numbers))
    least = np.argsort(np.argsort(ids))  # each member's group by the rank of its least id; members of a group agree at all times
    links = np.zeros(len(ids), np.int64)
    for q in np.flatnonzero(asking).tolist():
        hits = holds[np.array(find(paths[q]), np.int64)]
        hits = hits[ids[hits] != ids[q]]
        if not len(hits):
            continue
        links[q] += copies[hits].sum()
        if not at_home[q]:
            links[hits] += copies[q]
        groups = np.unique(np.append(least[hits], least[q]))
        if len(groups) > 1:  # once for each group that is joined, at most as often as there are members
            least[np.isin(least, groups[1:])] = groups[0]
    names = np.sort(ids)
    hit = np.flatnonzero(links)
    return ids[hit].tolist(), names[least[hit]].tolist(), links[hit].tolist()


def _cells(members: DataFrame, n_groups: int, finder=tree_finder) -> DataFrame:
    """(id, root, links) rows of all cells of members (id, n, tokens, copies, home: its own, to: the home it goes to)."""
    per = members.groupBy(F.col("to").alias("cell_to")).agg(F.sum(F.when(F.col("home") == F.col("to"), 1).otherwise(0)).alias("held"), F.count(F.lit(1)).alias("asked"))
    per = per.where("held > 0 AND asked > 1").select("cell_to", F.ceil(F.col("held") / CELL).alias("rows"), F.ceil(F.col("asked") / CELL).alias("cols"))
    sided = members.join(per, F.col("to") == F.col("cell_to"))
    row, col = F.pmod(F.xxhash64("id"), F.col("rows")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols"))
    cell = lambda r, c, held, asks: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), held.alias("held"), asks.alias("asks"))
    at_home = F.col("home") == F.col("to")
    # an asking set goes to every row of its column; a held one to every column of its row; where both meet, once
    asks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1), lambda r: cell(r, col, at_home & (r == row), F.lit(True)))
    holds = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1), lambda c: cell(row, c, F.lit(True), F.lit(False))), lambda x: at_home & (x["c"] != col))
    spread = sided.select("id", "tokens", "copies", "to", at_home.alias("at_home"), F.explode(F.concat(asks, holds)).alias("x"))
    spread = spread.select("id", "tokens", "copies", "to", "at_home", "x.*").withColumn("part", F.pmod(F.xxhash64("to", "r", "c"), F.lit(n_groups)))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        part = part.sort_values(["to", "r", "c", "id"], kind="stable").drop_duplicates(["to", "r", "c", "id"])
        keys = part[["to", "r", "c"]].to_numpy(np.int64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), len(part)]
        ids, tokens = part["id"].to_numpy(np.int64), part["tokens"].tolist()
        flags = [part[k].to_numpy() for k in ("held", "asks", "at_home", "copies")]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                for to, new in zip(out, join_cell(ids[a:b], [np.frombuffer(t, np.uint64) for t in tokens[a:b]], *(f[a:b] for f in flags), finder), strict=True):
                    to += new
        return pd.DataFrame(dict(zip(("id", "root", "links"), (np.array(x, np.int64) for x in out), strict=True)))

    return spread.groupBy("part").applyInPandas(work, "id long, root long, links long")


def shingle_components(documents: DataFrame, sets_of=shingle_sets, finder=tree_finder) -> DataFrame:
    """Per row of documents, by sets_of() of its text: doc_id, n_shingles, component_id (least doc_id connected by links), n_links (rows it is linked with), text_hash (xxhash64 of the text)."""
    docs = rows_of(documents, "doc_id", "text").withColumn("text", text_of())
    tasks = input_tasks(docs)
    n_buckets = max(MIN_BUCKETS, 2 * tasks)
    rows = materialize(digests(docs.withColumn("text_hash", F.xxhash64("text")), sets_of), "shingle-digests")
    frequent = _frequent(rows)
    own = rows.where("key IS NOT NULL").select("doc_id", "key", "id", "n", "text_hash")
    sets = own.where("n > 0").groupBy("key", "id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    alive = materialize(_survivors(docs, frequent, n_buckets, sets_of).join(sets.select("id", "first_doc", "copies"), "id"), "shingle-survivors")
    n_alive = alive.count()
    wanted = alive.select(F.col("first_doc"), "id", "copies")
    if n_alive <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("id", "copies", "text")

    def keep():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"id": [], "copies": [], "n": [], "tokens": []}
            for own_id, copies, tokens in zip(batch.column("id").to_pylist(), batch.column("copies").to_pylist(), sets_of(batch.column("text").to_pylist()), strict=True):
                if len(tokens) and _set_id(set_key(tokens)) == own_id:
                    for to, x in zip(out.values(), (own_id, copies, len(tokens), _ordered(tokens, frequent).tobytes()), strict=True):
                        to.append(x)
            return out

        return work

    held = materialize(map_chunks(texts, "id long, copies long, n long, tokens binary", keep), "shingle-sets")

    def heads(batches):
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            tokens = [np.frombuffer(t, np.uint64)[: int(prefix(n))] for t, n in zip(batch.column("tokens").to_pylist(), sizes, strict=True)]
            extra = batch.column("home").to_pylist() if "home" in batch.schema.names else [0] * len(sizes)
            made = _deal(batch.column("id").to_pylist(), sizes, tokens, extra, n_buckets)
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("tokens", "ids", "sizes", "extra"))]))

    def least(part: pd.DataFrame) -> pd.DataFrame:
        run, ids, _, _ = _lists(part)
        first = ids[np.searchsorted(run, run)]  # sorted by set within a list
        order = np.lexsort((first, ids))
        ids, first = ids[order], first[order]
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        return pd.DataFrame({"id": ids[new], "home": first[new]})

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        run, ids, sizes, home = _lists(part)
        if not len(run):
            return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("id", "n", "to", "c")})
        order = np.lexsort((home, run))
        r, h, s = run[order], home[order], sizes[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]))
        r, h, low, high = r[first], h[first], np.minimum.reduceat(s, first), np.maximum.reduceat(s, first)
        begin, end = np.searchsorted(r, run), np.searchsorted(r, run, "right")
        size = end - begin
        total = np.cumsum(size)
        at = np.arange(int(total[-1])) + np.repeat(begin - total + size, size)
        who = np.repeat(np.arange(len(ids)), size)
        fits = (h[at] < home[who]) & (100 * high[at].astype(np.int64) >= PERCENT * sizes[who].astype(np.int64)) & (100 * sizes[who].astype(np.int64) >= PERCENT * low[at].astype(np.int64))
        made = pd.DataFrame({"id": ids[who[fits]], "n": sizes[who[fits]].astype(np.int64), "to": h[at[fits]]})
        return made.groupby(["id", "n", "to"], as_index=False).size().rename(columns={"size": "c"})

    small = held.select("id", "n", "tokens")
    homes = small.mapInArrow(heads, _DEALT).groupBy("bucket").applyInPandas(least, "id long, home long").groupBy("id").agg(F.min("home").alias("home"))
    homed = materialize(held.join(homes, "id"), "shingle-homes")
    guests = homed.select("id", "n", "tokens", "home").mapInArrow(heads, _DEALT).groupBy("bucket").applyInPandas(meet, "id long, n long, to long, c long")
    guests = guests.groupBy("id", "to").agg(F.sum("c").alias("c"), F.first("n").alias("n")).where(F.col("c") >= _least_shared("n")).select("id", "to")
    members = homed.withColumn("to", F.col("home")).unionByName(homed.join(guests, "id"))
    found = materialize(_cells(members, max(4, tasks, n_alive // CELL), finder), "shingle-links")
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = sets.join(roots, sets["id"] == roots["node"], "left").join(links, "id", "left")
    per_set = grouped.select("key", "first_doc", "copies", F.coalesce("component", "id").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    least_doc = per_set.groupBy("c").agg(F.min("first_doc").alias("component_id"))
    final = per_set.join(least_doc, "c").select("key", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    joined = own.join(final, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return shingle_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
