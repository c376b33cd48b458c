"""Line dedup that can be undone: exact reference counts of lines, with a cuckoo filter for each shard in front of them.

A line's key is the line without white space [space, U+0009..U+000D] at both ends and with A-Z in lower case. A key of
at least MIN_CHARS code points that MIN_DOCS documents hold loses all its lines but those of the largest doc_id.

The exact table has one row per key: how many documents hold it and the largest doc_id. Sharded by the key's hash, the
keys over the limit also go into cuckoo filters. A document's lines are first held against the filters, and only lines
that a filter lets through reach the exact table, so a filter's false hits never show. LineIndex keeps (key, doc_id)
references and the filters on disk, by shard: documents can be inserted and deleted again, which restores lines.

Defined cases: a null or empty text is one empty line; a null doc_id ranks below all others; rows that share a doc_id
count as one document, and each row is cleaned alike; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields_of, map_chunks, materialize, rows_of, text_of

MIN_CHARS = 20
MIN_DOCS = 3
SPACES = b" \t\n\v\f\r"
#: Filters up to this size in all are sent to every task; beyond it, lines are sent to the filters of their shards.
BROADCAST_BYTES = 32 << 20
#: Tasks that share a shard's lines in that case, so that a line which many documents hold isn't one task's work.
SALTS = 64
#: Keys that one shard's filter is laid out for.
SHARD_KEYS = 1 << 15


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; insert, delete and bulk look-up of 64-bit hashes."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, capacity: int):
        size = 1
        while size * self.SLOTS * 0.84 < max(1, capacity):
            size *= 2
        self.table = np.zeros((size, self.SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    @property
    def capacity(self) -> int:
        return int(len(self.table) * self.SLOTS * 0.84)

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    @staticmethod
    def _print(h: int) -> int:
        return (h >> 48) or 1

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, h: int) -> None:
        mark, at = self._print(h), h & self.mask
        for _ in range(self.KICKS):
            for spot in (at, self._other(at, mark)):
                free = np.flatnonzero(self.table[spot] == 0)
                if len(free):
                    self.table[spot, free[0]] = mark
                    return
            slot = mark % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
        self.stash.append((at, mark))

    def delete(self, h: int) -> bool:
        mark, at = self._print(h), h & self.mask
        for spot in (at, self._other(at, mark)):
            hit = np.flatnonzero(self.table[spot] == mark)
            if len(hit):
                self.table[spot, hit[0]] = 0
                return True
            if (spot, mark) in self.stash:
                self.stash.remove((spot, mark))
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.uint64)
        mark = (h >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        at = (h & np.uint64(self.mask)).astype(np.int64)
        found = (self.table[at] == mark[:, None]).any(1) | (self.table[(at ^ (mark * 0x5BD1E995)) & self.mask] == mark[:, None]).any(1)
        for spot, kept in self.stash:
            found |= (mark == kept) & ((at == spot) | (self._other(spot, kept) == at))
        return found

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + stash.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out, n = cls(0), int(np.frombuffer(raw, np.int64, 1)[0])
        end = 8 + n * cls.SLOTS * 2
        out.table = np.frombuffer(raw[8:end], np.uint16).reshape(n, cls.SLOTS).copy()
        out.stash = [tuple(x) for x in np.frombuffer(raw[end:], np.int64).reshape(-1, 2).tolist()]
        return out


def key_of(line: bytes) -> bytes | None:
    """The key of a line in UTF-8, or None where it is too short to count."""
    key = line.strip(SPACES)
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
        return None
    return key.lower()  # bytes: A-Z alone


def _lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_keys(documents: DataFrame) -> DataFrame:
    """(key, doc_id): the 128-bit hash of each counted line of each row, once a row."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            keys: list[bytes] = []
            ids: list[int | None] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {xxhash.xxh3_128_digest(k) for k in map(key_of, _lines_of(text)) if k is not None}
                keys += own
                ids += [doc_id] * len(own)
            return {"key": keys, "doc_id": ids}

        return work

    return map_chunks(documents, "key binary, doc_id long", make)


def reference_counts(references: DataFrame, unique: bool = True) -> DataFrame:
    """(key, n_docs, last_doc) over (key, doc_id) rows; unique: no pair stands twice."""
    pairs = references if unique else references.select("key", "doc_id").distinct()
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, cuckoo): a filter for the keys of each shard. Shards are small by their number, so no task grows with the table."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(len(part))
        for raw in part["key"]:
            made.insert(int.from_bytes(raw[:8], "little"))
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "cuckoo": [made.to_bytes()]})

    return keys.select("key", _shard(n_shards)).groupBy("shard").applyInPandas(build, "shard int, cuckoo binary")


def _shard(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("shard")


def droppable(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n_docs") >= MIN_DOCS).select("key", "last_doc")


def _passing(shards: np.ndarray, keys: list[bytes], cuckoos: dict[int, CuckooFilter]) -> np.ndarray:
    """Which keys the filters of their shards let through."""
    hashes = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
    hit = np.zeros(len(hashes), bool)
    for shard in set(shards.tolist()) & cuckoos.keys():
        own = shards == shard
        hit[own] = cuckoos[shard].contains(hashes[own])
    return hit


def screened(lines: DataFrame, filters: DataFrame, n_shards: int, n_keys: int) -> DataFrame:
    """(key, doc_id) of the lines that the stored filters (shard, cuckoo) of n_keys keys let through: all with such a key, and few others."""
    asked = lines.select("key", "doc_id", _shard(n_shards))
    if n_keys * 3 <= BROADCAST_BYTES:
        sent = lines.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cuckoo"]) for r in filters.collect()})

        def probe(batches):
            cuckoos = {shard: CuckooFilter.from_bytes(raw) for shard, raw in sent.value.items()}
            for batch in batches:
                if batch.num_rows:
                    hit = _passing(batch.column("shard").to_numpy(), batch.column("key").to_pylist(), cuckoos)
                    yield batch.select(["key", "doc_id"]).filter(pa.array(hit))

        return asked.mapInArrow(probe, "key binary, doc_id long")

    def meet(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = own[["key", "doc_id"]].astype({"doc_id": "Int64"})
        if not len(own) or not len(kept):
            return out[:0]
        cuckoos = {int(kept["shard"].iloc[0]): CuckooFilter.from_bytes(bytes(kept["cuckoo"].iloc[0]))}
        return out[_passing(own["shard"].to_numpy(), [bytes(k) for k in own["key"]], cuckoos)]

    salted = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    spread = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(meet, "key binary, doc_id long")


def _suspects(documents: DataFrame, limits: DataFrame, n_limits: int) -> DataFrame:
    n_shards = max(1, n_limits // SHARD_KEYS)
    return screened(line_keys(documents), materialize(build_filters(limits, n_shards), "line-filters"), n_shards, n_limits)


def clean(documents: DataFrame, drops: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text, and what they carry) without the lines in drops (doc_id, drop: keys), with line counts."""
    joined = documents.join(drops, documents["doc_id"].eqNullSafe(drops["drop_id"]), "left").drop("drop_id")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept_sha256": [], "kept_text": []}
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                lines = _lines_of(text)
                stays = lines
                if drop:
                    gone = set(drop)
                    stays = [x for x in lines if (k := key_of(x)) is None or xxhash.xxh3_128_digest(k) not in gone]
                raw = b"\n".join(stays)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(stays))
                out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["kept_text"].append(raw.decode("utf-8", "surrogatepass"))
            return {"doc_id": batch.column("doc_id")} | out | {c: batch.column(c) for c in carry}

        return work

    return map_chunks(joined, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string" + fields_of(joined, carry), make)


def dedup_lines(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's text without the lines that other documents keep: doc_id, n_lines, n_dropped, kept_sha256, kept_text, and columns to carry along."""
    full = rows_of(documents, "doc_id", "text", *carry).withColumn("text", text_of())
    docs = full.select("doc_id", "text")
    counts = reference_counts(line_keys(docs), unique=False)
    limits = materialize(droppable(counts), "line-limits")
    suspects = _suspects(docs, limits, limits.count())
    drops = suspects.join(limits, "key").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc"))).groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("key").alias("drop"))
    return clean(full, drops, carry)


class LineIndex:
    """Line references and filters kept in a folder, so that documents can come and go.

    insert() and delete() take (doc_id, text) rows; delete() takes the texts as they were inserted. Keys are dealt to shards.
    A change writes new versions of the references and the filters of the shards that its lines fall into, and of no others;
    then it names them in a manifest, so a change that fails leaves the index as it was, and an index can be opened again.
    A filter takes and loses keys as their counts cross the limit, and is laid out anew when it has outgrown its capacity.
    """

    REFERENCES = "key binary, doc_id long, shard int"
    FILTERS = "shard int, cuckoo binary, n_keys long"

    def __init__(self, spark: SparkSession, path: str, n_shards: int = 16):
        """A new index, or the one that stands at path; n_shards is a new one's."""
        self.spark, self.path, self.version = spark, path, 0
        self.n_shards, self.versions = n_shards, {}
        found = self._manifests()
        if found:
            self.version = max(found)
            self._read_manifest()
        else:
            self._write_manifest()

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        where, fs = self._fs()
        if not fs.exists(where):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(where)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [int(name.split("=")[1]) for name, at in names if name.startswith("version=") and fs.exists(done(at, "_SUCCESS"))]

    def _read_manifest(self) -> None:
        rows = self.spark.read.schema("n_shards int, shard int, at int").parquet(f"{self.path}/manifest/version={self.version}").collect()  # a row a shard
        self.n_shards = rows[0]["n_shards"]
        self.versions = {r["shard"]: r["at"] for r in rows if r["shard"] is not None}

    def _write_manifest(self) -> None:
        rows = [(self.n_shards, None, None), *((self.n_shards, k, v) for k, v in sorted(self.versions.items()))]
        self.spark.createDataFrame(rows, "n_shards int, shard int, at int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={self.version}")

    def _read(self, what: str, schema: str, shards: set[int] | None = None) -> DataFrame:
        """The present rows of all shards, or of some."""
        paths = [f"{self.path}/{what}/version={v}/shard={k}" for k, v in sorted(self.versions.items()) if shards is None or k in shards]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"{schema}, version int").option("basePath", f"{self.path}/{what}").parquet(*paths)
        return found.select(*(c.split()[0] for c in schema.split(", ")))

    def references(self, shards: set[int] | None = None) -> DataFrame:
        return self._read("references", self.REFERENCES, shards)

    def filters(self, shards: set[int] | None = None) -> DataFrame:
        return self._read("filters", self.FILTERS, shards)

    def _change(self, lines: DataFrame, joined) -> None:
        """Write the touched shards anew: joined(their references, lines) are what they hold then."""
        lines = materialize(lines.select("key", "doc_id", _shard(self.n_shards)).distinct(), "line-changes")
        touched = {r["shard"] for r in lines.select("shard").distinct().collect()}  # n_shards at most
        if not touched:
            return
        number, before = self.version + 1, self.references(touched)
        # a file for every touched shard, empty ones too, so that each has a version to be read
        marks = self.spark.createDataFrame([(None, None, k) for k in sorted(touched)], self.REFERENCES)
        joined(before, lines).unionByName(marks).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/references/version={number}")
        was = droppable(reference_counts(before.where("key IS NOT NULL"), unique=False)).select("key", _shard(self.n_shards), F.lit(True).alias("was"))
        fresh = self.spark.read.schema(self.REFERENCES).parquet(f"{self.path}/references/version={number}")
        now = droppable(reference_counts(fresh.where("key IS NOT NULL"), unique=False)).select("key", _shard(self.n_shards), F.lit(True).alias("now"))
        keys = was.join(now, ["key", "shard"], "full").unionByName(marks.select("key", "shard", F.lit(None).cast("boolean").alias("was"), F.lit(None).cast("boolean").alias("now")))
        old = self.filters(touched)

        def update(key: tuple, own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            own = own[own["key"].notna()]
            was, now = own["was"].notna().to_numpy(), own["now"].notna().to_numpy()
            hashes = [int.from_bytes(bytes(k)[:8], "little") for k in own["key"]]
            cuckoo = CuckooFilter.from_bytes(bytes(kept["cuckoo"].iloc[0])) if len(kept) else None
            if cuckoo is None or now.sum() > cuckoo.capacity:
                cuckoo = CuckooFilter(max(2 * int(now.sum()), 64))
                for h, is_now in zip(hashes, now, strict=True):
                    if is_now:
                        cuckoo.insert(h)
            else:
                for h, a, b in zip(hashes, was, now, strict=True):
                    if a and not b:
                        cuckoo.delete(h)
                    elif b and not a:
                        cuckoo.insert(h)
            return pd.DataFrame({"shard": [key[0]], "cuckoo": [cuckoo.to_bytes()], "n_keys": [int(now.sum())]})

        made = keys.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(update, self.FILTERS)
        made.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/filters/version={number}")
        self.version = number
        self.versions |= dict.fromkeys(touched, number)
        self._write_manifest()

    def insert(self, documents: DataFrame) -> None:
        self._change(line_keys(rows_of(documents, "doc_id", "text")), lambda before, lines: before.unionByName(lines).distinct())

    def delete(self, documents: DataFrame) -> None:
        on = lambda a, b: a["key"].eqNullSafe(b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])
        self._change(line_keys(rows_of(documents, "doc_id", "text")), lambda before, lines: before.alias("a").join(lines.alias("b"), on(before, lines), "left_anti"))

    def maybe_dropped(self, line: str) -> bool:
        """Whether the filter of the line's shard lets it through; False is certain."""
        key = key_of(line.encode("utf-8", "surrogatepass"))
        if key is None:
            return False
        asked = self.spark.createDataFrame([(bytearray(xxhash.xxh3_128_digest(key)), 0)], "key binary, doc_id long")
        return not screened(asked, self.filters(), self.n_shards, 1).isEmpty()

    def clean(self, documents: DataFrame) -> DataFrame:
        """The documents without the lines that the index's later ones keep: filters first, then the exact counts of what they let through."""
        docs = rows_of(documents, "doc_id", "text").withColumn("text", text_of())
        n_keys = self.filters().agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
        suspects = screened(line_keys(docs), self.filters(), self.n_shards, n_keys)
        limits = droppable(reference_counts(self.references().where("key IS NOT NULL"), unique=False))
        held = suspects.join(limits, "key").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc")))
        return clean(docs, held.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("key").alias("drop")))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND coalesce(k.doc_id < c.last_doc, true) AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
