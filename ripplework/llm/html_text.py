"""Main text of web pages by a recurrent block labeller.

Pages are cut into leaf blocks (html_blocks), a bidirectional LSTM labels all blocks of a page at once (html_model), and
the blocks labelled as main text are joined by two line feeds. Inside a block, references are decoded and each run of
white space [space, U+0009..U+000D] becomes one space; nothing else is dropped or cut.

Defined cases: a null or empty page has the empty text; cut-off or malformed markup is read as far as it goes; repeated
rows and rows that share a page_id are read one by one; a null page_id or url passes through; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, rows_of
from .html_blocks import blocks_of
from .html_model import Labeller, features

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def extract_text(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of each row."""

    def make():
        model = Labeller()

        def work(batch: pa.RecordBatch) -> dict:
            pages = [blocks_of(h) for h in batch.column("html").to_pylist()]
            shown = model.probabilities([features(b) for b in pages])
            kept = [[b.text for b, p in zip(own, odds.tolist(), strict=True) if p >= threshold] for own, odds in zip(pages, shown, strict=True)]
            texts = ["\n\n".join(k) for k in kept]
            return {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": texts,
                "n_chars": [len(t) for t in texts],
                "n_blocks": [len(b) for b in pages],
                "n_kept": [len(k) for k in kept],
            }

        return work

    rows = rows_of(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    return map_chunks(rows, SCHEMA, make, text="html")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
