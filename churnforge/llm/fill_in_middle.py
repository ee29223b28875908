"""Op 11: fill-in-the-middle transformation as a pyarrow.compute pipeline.

A batch's texts become list arrays of units (code points), which are flattened
with their parent indices; ordinals inside the text decide a unit's role
(prefix, middle, suffix); units are filtered by role, lists are rebuilt and
joined to pieces, and the pieces are joined between sentinels. A text is cut
from left to right at two points that follow from its id's hash alone.

Units are handled in blocks of about a million bytes, and a text longer than a
block is cut into several whose pieces are joined in the end, so the memory of
a task is some thirty times a block plus one text, its pieces and its output.

Edge cases: null counts as empty; empty texts, and texts that hold a sentinel,
stay plain (their cut lengths are null); a null id hashes like an empty one;
repeated rows are cut alike; an empty table gives an empty one. Only id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import SLICE_ROWS, text_or_empty
from churnforge.session import map_in_arrow

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
BLOCK_BYTES = 1 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]


def id_hashes(id_col: str, seed: int, count: int = 4) -> list[Column]:
    """The first ``count`` 8-digit groups of the hex sha256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(count)]


def _blocks(texts: pa.StringArray, size: int) -> tuple[pa.StringArray, np.ndarray]:
    """The same bytes with an end after each text, and inside a long one after
    about every ``size`` bytes; and where each text's blocks begin."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    extra = []
    for row in np.flatnonzero(np.diff(ends.astype(np.int64)) > size):
        for cut in range(int(ends[row]) + size, int(ends[row + 1]), size):
            while raw[cut] & 0xC0 == 0x80:          # a code point begins at no such byte
                cut -= 1
            extra.append((int(row), cut))
    # empty texts keep a block of their own: every text has at least one
    rows = np.array([row for row, _ in extra], np.int64)
    bounds = np.insert(ends, rows + 1, np.array([cut for _, cut in extra], np.int32)) if extra else ends
    begins = np.arange(len(ends)) + np.searchsorted(rows, np.arange(len(ends)), "left")
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), data), begins


def code_points(texts: pa.StringArray) -> pa.ListArray:
    """Every text as the list of its code points; the bytes are not copied."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80) + ends[0]
    units = pa.StringArray.from_buffers(len(heads), pa.py_buffer(np.append(heads, ends[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(heads, ends).astype(np.int32)), units)


def _by_role(blocks: pa.StringArray, first: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    """The prefix, middle and suffix part of every block: a unit of ordinal i
    (``first`` is that of the block's first unit) is prefix before ``begin``,
    middle before ``stop`` and suffix after it."""
    units = code_points(blocks)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    starts = units.offsets.to_numpy()[:-1]
    ordinal = pc.add(pa.array(np.arange(len(flat))), pc.take(pa.array(first - starts), parent))
    in_prefix = pc.less(ordinal, pc.take(pa.array(begin), parent))
    in_suffix = pc.greater_equal(ordinal, pc.take(pa.array(stop), parent))
    pieces = []
    for role in (in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix):
        counts = np.bincount(parent.filter(role).to_numpy(), minlength=len(blocks))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), flat.filter(role))
        pieces.append(pc.binary_join(lists, ""))
    return pieces


def cut_texts(texts: pa.StringArray, begin: np.ndarray, stop: np.ndarray, block_bytes: int = BLOCK_BYTES
              ) -> list[pa.Array]:
    """Prefix, middle and suffix of every text, cut before units ``begin`` and ``stop``."""
    blocks, begins = _blocks(texts, block_bytes)
    row = np.repeat(np.arange(len(texts)), np.diff(begins))
    sizes = pc.utf8_length(blocks).to_numpy().astype(np.int64)
    before = np.cumsum(sizes) - sizes
    first = before - before[begins[:-1]][row]
    weight = np.cumsum(pc.binary_length(blocks).to_numpy().astype(np.int64))
    group = (weight - 1) // block_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(blocks)]
    parts: list[list[pa.Array]] = [[], [], []]
    for a, b in zip(cuts[:-1], cuts[1:]):
        for part, piece in zip(parts, _by_role(blocks.slice(a, b - a), first[a:b], begin[row[a:b]], stop[row[a:b]])):
            part.append(piece)
    offsets = pa.array(begins.astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(part)), "") for part in parts]


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, at least a row each."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        weight = np.cumsum(pc.binary_length(part.column(column)).to_numpy().astype(np.int64))
        cuts = np.append(np.flatnonzero(np.diff(weight // most, prepend=-1)), part.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield part.slice(a, b - a)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   transformed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of docs; map-only.

    Of all texts that may be cut, ``transformed_percent`` in a hundred are, and
    of these ``spm_percent`` in a hundred begin with the suffix.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1, 4 * BLOCK_BYTES):
                texts = batch.column(1)
                n = pc.utf8_length(texts).to_numpy().astype(np.int64)
                h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
                cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
                plain = pc.match_substring_regex(texts, SENTINEL).to_numpy(zero_copy_only=False)
                plain = plain | (n == 0) | (h3 % 100 >= transformed_percent)
                form = np.where(plain, PLAIN, np.where(h4 % 100 < spm_percent, SPM, PSM))
                prefix, middle, suffix = cut_texts(texts, *cuts)
                psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
                spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(FORMS).take(pa.array(form)),
                     pa.array(cuts[0], mask=plain), pa.array(cuts[1] - cuts[0], mask=plain),
                     pc.choose(pa.array(form), texts, psm, spm)], names=schema.names)

    return map_in_arrow(docs.select(id_col, text_or_empty(text_col).alias("text"), *id_hashes(id_col, seed)), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. A text that was cut holds no sentinel,
    so each one stands in the output once."""
    piece = F.split(output, SENTINEL, -1)
    return (F.when(form == "psm", F.concat(piece[1], piece[3], piece[2]))
            .when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output))
