"""Token counts by unigram segmentation over a trie of distinct words.

A word (a run of anything but space and U+0009..U+000D, after the mark U+2581) is cut into pieces of the vocabulary so that the sum of
the pieces' scores is largest; of equal sums, the one whose last piece is longest. The forward pass at a place in a word depends
on the letters before it alone, so words with a common beginning share it: distinct words form a trie, walked depth
first, and each node's best score and count are computed once. Terminal nodes give their words' counts.

A letter that is no piece costs one token for each of its UTF-8 bytes, at a score below any piece's.

Defined cases: a null or empty text has no tokens; repeated rows and rows that share a doc_id are counted one by one; a
null doc_id passes through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import vocabulary_path
from .common import map_chunks, rows_of, text_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 500_000
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, n_tokens long"


def piece_scores(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece vocabulary with their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class ScoredTrie:
    """Counts tokens of words; forward scores are kept on the path from the root to the present node."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.stranger = min(scores.values(), default=0.0) - 10.0

    def counts(self, words: list[str]) -> dict[str, int]:
        """Of each distinct word. In sorted order a word's node follows its prefix's, so the path is the trie's walk."""
        get, longest, stranger = self.scores.get, self.longest, self.stranger
        best, count = [0.0], [0]
        out, path = {}, ""
        for word in sorted(words):
            text = MARK + word
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                letter = text[end - 1 : end]
                score, n = best[-1] + stranger, count[-1] + len(letter.encode("utf-8", "surrogatepass"))
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    own = get(text[start:end])
                    if own is not None and best[start] + own >= score:
                        score, n = best[start] + own, count[start] + 1
                best.append(score)
                count.append(n)
            out[word], path = count[-1], text
        return out


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens of each row. Each task keeps a bounded table of the words it has counted."""

    def make():
        trie, known = ScoredTrie(piece_scores(vocabulary)), {}

        def work(batch: pa.RecordBatch) -> dict:
            split = [[w.decode("utf-8", "surrogatepass") for w in (t or "").encode("utf-8", "surrogatepass").split()] for t in batch.column("text").to_pylist()]
            new = {w for own in split for w in own if w not in known}
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = {w for own in split for w in own}
            known.update(trie.counts(list(new)))
            return {"doc_id": batch.column("doc_id"), "n_words": [len(own) for own in split], "n_tokens": [sum(map(known.__getitem__, own)) for own in split]}

        return work

    return map_chunks(rows_of(documents, "doc_id", "text").withColumn("text", text_of()), SCHEMA, make, limit=BLOCK_BYTES)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
