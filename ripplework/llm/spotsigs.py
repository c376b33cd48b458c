"""SpotSigs fingerprints: chains of content words that follow common words.

Words are cut at white space, lowered in A-Z and freed of punctuation. Each anchor (a common word) makes a signature of
itself and the next CHAIN content words, skipping anchors between them. A document's fingerprint is its set of signatures.
A text without a full chain after any anchor takes every word for an anchor, and at last its whole sequence of words.

Two sets can only be alike to a degree t if their lengths' ratio is at least t. `length_partition` cuts lengths so that
alike sets are in the same or neighbouring partitions, and `pruned_jaccard` leaves a pair as soon as lengths, or what is
left of either set, can't reach t. Pairs are compared that way: a text with its edited form and with the next text, for any
likeness above 0; and, for 0.75, what meets in a cell of `near_duplicates`, whose plan is that of the join of word shingles.

Defined cases: a null or empty text, or one of punctuation alone, has the empty fingerprint; two empty ones are alike to
the degree 1, an empty and another to 0; rows that share a doc_id follow each other by text; a null doc_id comes last;
with one row, it is its own next; extra columns are ignored; an empty table gives an empty result.
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

from .common import input_tasks, rows_of, text_of
from .shingles import _Hashes, mix

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    b"the a an of to in is was that and for on with by it as are be this from or at".split()
    + "der die das und von zu den mit ist ein eine im auf für nicht des dem sich auch als".encode().split()
    + "le la les de des du et un une en est que qui dans pour par sur au pas avec".encode().split()
    + "el los las del y que es por con para no se una su lo al como más".encode().split()
)
CHAIN = 2
THRESHOLD = 0.75
_PUNCTUATION = b".,;:!?()[]{}\"'|<>#*$%&=-_/\\"
_BITS = np.uint64((1 << 48) - 1)


def signature_sets(texts: list[str | None], chain: int = CHAIN) -> list[np.ndarray]:
    """Each text's distinct signatures as 48-bit numbers, ascending."""
    hashes = _Hashes()
    split = [(t or "").encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION).split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((hashes[w] for own in split for w in own), np.uint64, int(sizes.sum()))
    common = np.fromiter((w in ANCHORS for own in split for w in own), bool, len(flat))
    text = np.repeat(np.arange(len(texts)), sizes)
    content = np.flatnonzero(~common)
    made, owner = _chains(flat, text, np.flatnonzero(common), content, np.searchsorted(content, np.flatnonzero(common)), chain)
    bare = np.ones(len(texts), bool)
    bare[owner] = False
    if (bare & (sizes > 0)).any():  # every word is an anchor there
        every = np.flatnonzero(bare[text])
        more, of = _chains(flat, text, every, np.arange(len(flat)), every + 1, chain)
        made, owner = np.concatenate([made, more]), np.concatenate([owner, of])
        bare[of] = False
        for i in np.flatnonzero(bare & (sizes > 0)).tolist():
            whole = np.array([sizes[i]], np.uint64)
            for w in split[i]:
                whole = mix(whole + np.uint64(hashes[w]))
            made, owner = np.concatenate([made, whole]), np.append(owner, i)
    order = np.argsort(owner, kind="stable")
    parts = np.split(made[order] & _BITS, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if len(texts) else []
    return [np.unique(p) for p in parts]


def _chains(flat, text, anchors, content, first, chain):
    """Signatures of the anchors whose chains stay in their texts; first: each anchor's first word in content."""
    ok = first + chain <= len(content)
    anchors, first = anchors[ok], first[ok]
    ok = text[content[first + chain - 1]] == text[anchors] if len(anchors) else np.zeros(0, bool)
    anchors, first = anchors[ok], first[ok]
    key = mix(flat[anchors])
    for k in range(chain):
        key = mix(key + flat[content[first + k]])
    return key, text[anchors]


def fingerprint(signatures: np.ndarray) -> str:
    """Twelve hex digits a signature, ascending."""
    return signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def signatures_of(printed: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(printed), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, step: int = 64) -> float | None:
    """The similarity if it reaches the threshold, else None, found by merging in steps and leaving when it is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b) or len(a) < threshold * len(b):
        return 1.0 if not len(b) else None
    need, both, at = math.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9), 0, 0
    for start in range(0, len(a), step):
        piece = a[start : start + step]
        end = int(np.searchsorted(b, piece[-1], "right"))
        both += len(np.intersect1d(piece, b[at:end], assume_unique=True))
        at = end
        if both + min(len(a) - start - len(piece), len(b) - at) < need:
            return None
    found = both / (len(a) + len(b) - both)
    return found if found >= threshold else None


def length_partition(n: int, threshold: float = THRESHOLD) -> int:
    """Sets whose lengths' ratio reaches the threshold are in the same or in neighbouring partitions."""
    return 0 if n < 1 else 1 + int(math.log(n) / -math.log(threshold) + 1e-12)


def compare(a: np.ndarray, b: np.ndarray, least: float | None = None) -> float:
    """Likeness of two fingerprints, 0 where it is below `least`: by their partitions first, then pruned.

    Without `least`, the smallest likeness above 0 that sets of these sizes can have, so that the value is exact.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = 1 / (len(a) + len(b)) if least is None else least
    if abs(length_partition(len(a), least) - length_partition(len(b), least)) > 1:
        return 0.0
    return pruned_jaccard(a, b, least) or 0.0


def spot_finder(sets: list[np.ndarray], n_numbers: int):
    """Which of the sets are alike to a query. They are indexed by length partition and rarest signatures (the greatest
    numbers); a query looks its own rarest up in its partition and the neighbours, and what it meets is compared, pruned."""
    rare = lambda s: s[-(len(s) - math.ceil(THRESHOLD * len(s) - 1e-9) + 1) :].tolist()
    index: dict[tuple[int, int], list[int]] = {}
    for k, own in enumerate(sets):
        part = length_partition(len(own))
        for x in rare(own):
            index.setdefault((part, x), []).append(k)

    def find(query: np.ndarray) -> list[int]:
        part = length_partition(len(query))
        met = {k for x in rare(query) for p in (part - 1, part, part + 1) for k in index.get((p, x), ())}
        return [k for k in met if pruned_jaccard(query, sets[k]) is not None]

    return find


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int"


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles (signatures), component_id, n_links of each row by fingerprints that are alike to 0.75 or more."""
    from .shingle_join import shingle_components

    return shingle_components(documents, signature_sets, spot_finder)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per row the fingerprint of its text and of its edited text, whose last third is the beginning of the next row by descending doc_id.

    Rows are dealt by ranges of doc_id. The first row of a range also goes to the range before it, as does the first row
    of all to the last range, so each range knows every next row; one row a range is sent twice.
    """
    docs = rows_of(documents, "doc_id", "text").withColumn("text", text_of())
    ids = docs.select("doc_id")
    n = 2 * input_tasks(docs)
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)), np.int64))

    def ranges(doc_id: pa.Array) -> np.ndarray:
        """0 for the largest ids; null ids are below all."""
        known = doc_id.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, len(cuts) - np.searchsorted(cuts, doc_id.fill_null(0).to_numpy(), "right"), len(cuts) + 1)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int | None] = {}
        for batch in batches:
            for r, i in zip(ranges(batch.column("doc_id")).tolist(), batch.column("doc_id").to_pylist(), strict=True):
                if r not in top or (i is not None and i > top[r]):
                    top[r] = i
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(top), pa.int64()), "head": pa.array(list(top.values()), pa.int64())})

    first = {r["part"]: r["head"] for r in ids.mapInArrow(heads, "part long, head long").groupBy("part").agg(F.max("head").alias("head")).collect()}
    order = sorted(first)
    before = {part: order[k - 1] for k, part in enumerate(order)}  # of the first, the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ranges(batch.column("doc_id"))
            parts = [batch.append_column("part", pa.array(own, pa.int64())).append_column("guest", pa.array(np.zeros(len(own), bool)))]
            at = [k for k, (r, i) in enumerate(zip(own.tolist(), batch.column("doc_id").to_pylist(), strict=True)) if first[r] == i]
            if at:
                sent = batch.take(pa.array(at))
                parts.append(sent.append_column("part", pa.array([before[r] for r in own[at].tolist()], pa.int64())).append_column("guest", pa.array([True] * len(at))))
            yield from (p for p in parts if p.num_rows)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        missing = part["doc_id"].isna()
        part = part.assign(nothing=missing, down=-part["doc_id"].where(~missing, 0).astype("int64"))
        part = part.sort_values(["guest", "nothing", "down", "text"], kind="stable")
        n_own = int((~part["guest"]).sum())
        texts = part["text"].tolist()[: n_own + 1]
        doc_ids = part["doc_id"].astype(object).where(~missing, None).tolist()[:n_own]
        out = []
        for a in range(0, n_own, 2000):
            b = min(n_own, a + 2000)
            some = texts[a : b + 1]
            edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(some, some[1:], strict=False)]
            prints = signature_sets(some + edited)
            plain, changed = prints[: len(some)], prints[len(some) :]
            for k in range(b - a):
                out.append((doc_ids[a + k], len(some[k]), hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(plain[k]), fingerprint(changed[k]), compare(plain[k], changed[k]), compare(plain[k], plain[k + 1]), len(plain[k]), length_partition(len(plain[k]))))
        return pd.DataFrame(out, columns=[f.split()[0] for f in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return docs.mapInArrow(deal, "doc_id long, text string, part long, guest boolean").groupBy("part").applyInPandas(work, RESULT)


def op4_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
