"""Op 9: token counts, with overlap resynchronisation for huge documents.

A document of more than ``chunk_chars`` characters is never encoded in one
piece. It is cut into overlapping chunks, each encoded with offsets; two
neighbours are spliced at a boundary in their overlap where both have a token
start and which is proven stable (a character that is no white space before
it, white space after it: the pre-tokenizer's matches end there whatever the
rest of the text). The tokens before it count from the left chunk, those after
it from the right one. If the overlap has no such boundary, it is doubled, and
with it the left chunk, until it has one or the document ends.

Edge cases: null and empty texts have no bytes and no tokens; special strings
inside a text count as the library's default counts them (they hold no white
space, so no splice cuts one); a huge document without white space becomes one
chunk in the end. Repeated rows repeat their counts; an empty table gives an
empty one; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.byte_bpe import ByteBpe, stable_cuts, worker_bpe
from churnforge.llm.common import text_or_empty, text_slices
from churnforge.session import map_in_arrow

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512


def count_by_chunks(bpe: ByteBpe, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of one huge text."""
    total, begun, start, end = 0, 0, 0, min(chunk, len(text))
    ids = bpe.ids(text[:end])
    starts = bpe.token_starts(ids)               # bytes from the chunk's begin; tokens before ``begun`` are counted
    while end < len(text):
        width = overlap
        while True:
            right = end - width
            if right <= start:                   # the overlap took in the whole chunk: widen that as well
                end = min(len(text), start + 2 * (end - start))
                ids = bpe.ids(text[start:end])
                starts = bpe.token_starts(ids)
                if end == len(text):
                    return total + len(ids) - begun
                continue
            right_end = min(right + max(chunk, 2 * width), len(text))
            right_ids = bpe.ids(text[right:right_end])
            right_starts = bpe.token_starts(right_ids)
            found = _common_cut(text, start, right, end, starts, right_starts, begun)
            if found:
                break
            width *= 2
        left_cut, right_cut = found
        total += left_cut - begun
        begun, start, end, ids, starts = right_cut, right, right_end, right_ids, right_starts
    return total + len(ids) - begun


def _common_cut(text: str, start: int, right: int, end: int, starts: np.ndarray, right_starts: np.ndarray, begun: int
                ) -> tuple[int, int] | None:
    """Token numbers, in the left and the right chunk, at the middlemost proven
    cut of their overlap at which both have a token start."""
    cuts = stable_cuts(text, right, end)
    lead = len(text[start:right].encode())
    for cut in sorted(cuts, key=lambda c: abs(2 * c - right - end)):
        at = len(text[right:cut].encode())
        i, j = int(np.searchsorted(starts, lead + at)), int(np.searchsorted(right_starts, at))
        if (begun <= i < len(starts) and starts[i] == lead + at
                and j < len(right_starts) and right_starts[j] == at):
            return i, j
    return None


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens) per row of docs; map-only. The tokenizer file is
    read on the driver and broadcast; its size does not depend on the data."""
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType(), False),
                           T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(data.value)
        for batch, texts in text_slices(batches, 1):
            counts = [count_by_chunks(bpe, t, chunk_chars, overlap_chars) if len(t) > chunk_chars else len(bpe.ids(t))
                      for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=schema.names)

    return map_in_arrow(docs.select(F.col(id_col), F.col(text_col).alias("text"),
                                    F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes")), run, schema)
