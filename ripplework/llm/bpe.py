"""Byte-level BPE over a table of distinct words.

A text is split into words by the vocabulary's own pattern; merges never cross words, so a word's ids don't depend on
where it stands. Encoding is a join with the table of distinct words:

1. Each task splits its texts and numbers the distinct words of about BLOCK_BYTES of text (a block). A document becomes
   the numbers of its words.
2. The blocks' distinct words are dealt by hash. Each bucket encodes each of its words once, however many blocks hold it.
3. A block's words come back with their ids, and its documents put them in the places where the words stood. Pieces
   come from a join of the ids with the vocabulary's id-to-piece table, once for each distinct word.

What moves is a block's distinct words and its documents' word numbers, never the texts and never one row per word.

Defined cases: a null or empty text has no ids; repeated rows and rows that share a doc_id are encoded one by one; a null
doc_id passes through; the special token's string in a text is the special token, as in the tokenizers library; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import input_tasks, map_chunks, materialize, rows_of, text_of

VOCABULARY = "byte_bpe_50k.json"
BLOCK_BYTES = 16 << 20
#: Words that a task's cache holds before it starts anew; it bounds memory, not results.
CACHE_WORDS = 500_000
#: White space by Unicode's property, written out so that it doesn't depend on a library's own idea of it.
_WHITE = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: What keeps a text from being cut at its spaces alone: runs of white space, white space but space and \n, the mark of the cut.
_SLOW = ("  ", " \n", "\n ", "\n\n", "\0", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Words:
    """Splits texts and encodes single words by one vocabulary file."""

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.special = {x["content"] for x in stored.get("added_tokens", [])}
        self._fast = self._ranked(stored)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """Words whose ids, joined, are the text's ids.

        No word of the pattern goes on across a space that stands alone, so a text without runs of white space is cut
        before its spaces, which takes one pass in C; others are cut by the pattern itself.
        """
        if not any(x in text for x in _SLOW) and not any(s in text for s in self.special):
            cut = text.replace(" ", "\0 ").split("\0")
            return cut if cut[0] else cut[1:]
        if self._cut is None or not any(s in text for s in self.special):
            return _WORD.findall(text)
        out: list[str] = []
        for part in self._cut.split(text):
            out += [part] if part in self.special else _WORD.findall(part)
        return out

    def _ranked(self, stored: dict):
        """An encoder that takes ids for the ranks of merges, where the file's ids are in the order of its merges; else None."""
        vocab, merges = stored["model"]["vocab"], stored["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if stored["model"].get("ignore_merges") or stored.get("normalizer") or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        shown = _byte_letters()
        ranks = {bytes(shown[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[list[int]]:
        if self._fast:
            ordinary, special = self._fast.encode_ordinary, self.special
            return [ordinary(w) if w not in special else [self.tokenizer.token_to_id(w)] for w in words]
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def pieces(self) -> list[bytes]:
        """The id-to-piece table: the bytes of each id."""
        shown = _byte_letters()
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            piece = self.tokenizer.id_to_token(i) or ""
            out.append(piece.encode() if piece in self.special else bytes(shown[c] for c in piece))
        return out


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordCache(dict):
    """word -> little-endian unsigned 32-bit ids, filled a text at a time."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def ids_of(self, text: str) -> bytes:
        split = self.words.split(text)
        if new := {w for w in set(split) if w not in self}:
            if len(self) > CACHE_WORDS:
                self.clear()
                new = set(split)
            new = list(new)
            for w, ids in zip(new, self.words.encode(new), strict=True):
                self[w] = np.array(ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, split))


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, one plane of bytes after another, compressed: the upper planes nearly vanish."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack(items: list[bytes]) -> tuple[bytes, bytes]:
    return _squeeze(np.fromiter(map(len, items), "<u4", len(items))), zstandard.ZstdCompressor(level=3).compress(b"".join(items))


def _cut(body: bytes | np.ndarray, sizes: np.ndarray) -> list:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _unpack(sizes: bytes, body: bytes) -> list[bytes]:
    return _cut(zstandard.ZstdDecompressor().decompress(body), _unsqueeze(sizes))


def _number(words: Words, texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of the texts in order of first use, and each text as numbers of words."""
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    coded = []
    for text in texts:
        split = words.split(text or "")
        coded.append(np.fromiter(map(numbers.__getitem__, split), "<u4", len(split)))
    return list(numbers), coded


def _blocks(vocabulary: str, n_buckets: int):
    """Row makers of the two sides. Both read the same stored batches, so that a block has the same words and the same name in
    each. Its name is its task, its number there and a digest of its words: equal blocks stay apart, and blocks that should
    have been equal and aren't don't meet, which fails the job."""

    def numbered(batch: pa.RecordBatch, words: Words, nth: Iterator[int]) -> tuple[bytes, list[bytes], list[np.ndarray]]:
        distinct, coded = _number(words, batch.column("text").to_pylist())
        raw = [w.encode("utf-8", "surrogatepass") for w in distinct]
        task = TaskContext.get().partitionId()
        name = hashlib.md5(np.array([len(raw), task, next(nth)], "<i8").tobytes())
        for w in raw:
            name.update(len(w).to_bytes(4, "little") + w)
        return name.digest(), raw, coded

    def words_side():
        words, nth = Words(vocabulary), count()

        def work(batch: pa.RecordBatch) -> dict:
            block, raw, _ = numbered(batch, words, nth)
            dealt: dict[int, tuple[list[int], list[bytes]]] = {}
            for i, w in enumerate(raw):
                at, own = dealt.setdefault(xxhash.xxh3_64_intdigest(w) % n_buckets, ([], []))
                at.append(i)
                own.append(w)
            if not dealt:
                return {k: [] for k in ("bucket", "block", "at", "sizes", "words")}
            return {"bucket": list(dealt), "block": [block] * len(dealt), "at": [_squeeze(np.array(a)) for a, _ in dealt.values()]} | dict(zip(("sizes", "words"), zip(*(_pack(w) for _, w in dealt.values()), strict=True), strict=True))

        return work

    def documents_side():
        words, nth = Words(vocabulary), count()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            block, _, coded = numbered(batch, words, nth)
            sizes = [len(c) for c in coded]
            yield {"block": [block], "doc_ids": [batch.column("doc_id").to_pylist()], "sizes": [sizes], "numbers": [_squeeze(np.concatenate(coded))]}

        return work

    return words_side, documents_side


def word_table(documents: DataFrame, vocabulary: str = VOCABULARY, n_buckets: int | None = None) -> DataFrame:
    """(bucket, block, at, sizes, ids): each block's distinct words with their ids; a word is encoded once in all."""
    n = n_buckets or 2 * input_tasks(documents)
    side = _blocks(vocabulary, n)[0]
    dealt = map_chunks(documents, "bucket int, block binary, at binary, sizes binary, words binary", side, limit=BLOCK_BYTES)

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        words = Words(vocabulary)
        unpacked = [_unpack(n, x) for n, x in zip(part["sizes"], part["words"], strict=True)]
        distinct = list({w for own in unpacked for w in own})
        table: dict[bytes, list[int]] = {}
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            for w, ids in zip(some, words.encode([w.decode("utf-8", "surrogatepass") for w in some]), strict=True):
                table[w] = ids
        sizes = [_squeeze(np.array([len(table[w]) for w in own])) for own in unpacked]
        ids = [_squeeze(np.array([i for w in own for i in table[w]])) for own in unpacked]
        return part[["bucket", "block", "at"]].assign(sizes=sizes, ids=ids)

    return dealt.groupBy("bucket").applyInPandas(encode, "bucket int, block binary, at binary, sizes binary, ids binary")


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(documents: DataFrame, vocabulary: str = VOCABULARY, schema: str = RESULT) -> DataFrame:
    """Per row: doc_id and what the schema names of n_tokens, ids_sha256, decoded_sha256, ids (array<int>), decoded (string)."""
    docs = rows_of(documents, "doc_id", "text").withColumn("text", text_of())
    names = {f.split()[0] for f in schema.split(", ")}
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialize(docs, "bpe-documents")  # rows that were shuffled can come in another order when they are read again
    table = word_table(docs, vocabulary)
    numbered = map_chunks(docs, "block binary, doc_ids array<long>, sizes array<int>, numbers binary", _blocks(vocabulary, 1)[1], limit=BLOCK_BYTES)

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pieces = np.array(Words(vocabulary).pieces(), object)
        found: dict[int, np.ndarray] = {}
        for at, n, ids in zip(right["at"], right["sizes"], right["ids"], strict=True):
            found.update(zip(_unsqueeze(at).tolist(), _cut(_unsqueeze(ids), _unsqueeze(n)), strict=True))
        of_word = [found[i] for i in range(len(found))]
        shown = [",".join(map(str, ids.tolist())).encode() for ids in of_word]
        n_ids = np.array([len(ids) for ids in of_word], np.int64)
        ends = np.cumsum(n_ids).tolist()
        joined = pieces[np.concatenate(of_word)].tolist() if of_word else []  # the id-to-piece join
        back = [b"".join(joined[e - c : e]) for e, c in zip(ends, n_ids.tolist(), strict=True)]
        out: dict[str, list] = {k: [] for k in ("doc_id", *sorted(names - {"doc_id"}))}
        for doc_ids, sizes, raw in zip(left["doc_ids"], left["sizes"], left["numbers"], strict=True):
            numbers, start = _unsqueeze(raw), 0
            for doc_id, size in zip(doc_ids, sizes, strict=True):
                own = numbers[start : start + size]
                start += size
                at = own.tolist()
                out["doc_id"].append(doc_id)
                if "n_tokens" in names:
                    out["n_tokens"].append(int(n_ids[own].sum()))
                if "ids_sha256" in names:
                    out["ids_sha256"].append(hashlib.sha256(b",".join(map(shown.__getitem__, at))).hexdigest())
                if names & {"decoded_sha256", "decoded"}:
                    text = b"".join(map(back.__getitem__, at)).decode("utf-8", "replace")
                    if "decoded" in names:
                        out["decoded"].append(text)
                    if "decoded_sha256" in names:
                        out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if "ids" in names:
                    out["ids"].append([int(x) for i in at for x in of_word[i]])
        frame = pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})
        return frame.astype({k: "Int64" for k in ("doc_id", "n_tokens") if k in frame})

    return numbered.groupBy("block").cogroup(table.groupBy("block")).applyInPandas(place, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
