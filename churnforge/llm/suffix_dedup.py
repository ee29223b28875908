"""Op 13: removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts
somewhere else in the corpus. Start positions are sorted into buckets of equal
prefixes, and buckets are refined until they stand for ``length`` bytes; a
position alone in its bucket starts no repeated string and is dropped.

Identifiers: a bucket's identifier is a hash that is made of identifiers
alone: that of 2d bytes at p is made of those of d bytes at p and at p + d,
and every depth reuses the depth below it. So a task knows the identifiers of
later offsets without asking others.

Rows are spans of neighbouring starts with one bucket and one kind: the bucket
is made of bytes that all strings of the span hold, the kind of all bytes of
the span. One refinement step is the same at every level: a span alone in its
bucket is done (nothing of it is repeated); a bucket of one kind is done (all
of it is repeated); so are spans of a kind that occurs twice; and one span of
each kind in a mixed bucket is taken apart for the next level.

* Level 0: the bucket is a q-gram (``gram`` bytes). Of the q-grams inside a
  string, the one with the smallest identifier stands for it (leftmost of equal
  ones), so equal strings meet in one bucket, and about a hundredth of all
  positions is sorted. The kind is made of the identifiers of all offsets of
  the span, before the q-gram and after it.
* Level 1: spans are cut into blocks of ``step`` starts, counted from the
  q-gram. The bucket is what all strings of a block share.
* Level 2: single starts, whose bucket is their identifier at full depth.

Sorting is Spark's: every step counts by key with partial sums first, and rows
meet those counts in a plain join, which the planner may split. So a passage in
a third of all documents, or a third of all rows with one text, is no group in
a task: texts are told apart by two 64-bit hashes and copies are one text. Two
strings are taken for equal when two independent 64-bit identifiers, of bucket
and kind, agree. Texts are shuffled once; levels 1 and 2 work on the bytes of
the spans that are left.

Whole texts are read in blocks of bytes which overlap by a string, so the
arrays of a task do not grow with a text. Edge cases: null counts as empty;
texts shorter than ``length`` keep everything; repeated rows and null ids are
rows like any other (two rows of one long text repeat each other wholly); cuts
may fall inside a character, so what is kept is binary; an empty table gives an
empty one. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnforge.llm.common import discard, materialise, materialise_at, text_or_empty
from churnforge.session import map_in_arrow

BLOCK = 1 << 15
STEP = 16
_PLACE = np.uint64((1 << 22) - 1)              # low bits of a sort key: place in the block
_ODD_A, _ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)
KEY = ["k1", "k2"]
_RUNS = "array<struct<begin:int,stop:int>>"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of what a and, after it, b stand for."""
    x = a * _ODD_A
    x += b
    x ^= x >> np.uint64(32)
    x *= _ODD_B
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: np.ndarray, *depths: int) -> list[np.ndarray]:
    """For every depth, the bucket identifier of that many bytes at every
    position that has them; all depths share their levels."""
    level, size = _BYTE[data], 1
    found: list = [(None, 0)] * len(depths)
    while True:
        for k, depth in enumerate(depths):
            if depth & size:
                so_far, done = found[k]
                n = max(0, len(data) - done - size + 1)
                found[k] = (level if so_far is None else _pair(so_far[:n], level[done:done + n]), done + size)
        if 2 * size > max(depths):
            return [x for x, _ in found]
        n = max(0, len(level) - size)
        level, size = _pair(level[:n], level[size:size + n]), 2 * size


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbouring keys."""
    low, size = keys, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    rest = width - size
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each text ends, after the first one's begin; all bytes)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return ends.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _blocks(texts: pa.Array, length: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, stretches) of neighbouring texts: a stretch is (row, place in the
    row, begin, stop) with begin and stop counted in the block's bytes. A text
    with more starts than a block has is several stretches."""
    ends, raw = _ends(texts)
    ends = ends.tolist()
    held: list[tuple[int, int, int, int]] = []
    for row, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        for at in range(a, max(a + 1, b - length + 1), block):
            stop = min(at + block + length - 1, b)
            if held and stop - held[0][2] > 2 * block:
                yield raw[held[0][2]:held[-1][3]], np.array(held) - [0, 0, held[0][2], held[0][2]]
                held = []
            held.append((row, at - a, at, stop))
    if held:
        yield raw[held[0][2]:held[-1][3]], np.array(held) - [0, 0, held[0][2], held[0][2]]


def anchor_spans(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, length: int, gram: int):
    """Spans of starts that one q-gram stands for: (stretch, first start, last
    start, the q-gram's place, its identifier, the identifier of the whole span)."""
    grams, = identifiers(data, gram)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_lowest(keys, length - gram + 1) & _PLACE).astype(np.int64)
    last = stop - length
    inside = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, last + 1, -1)
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    change[begin] = True
    first = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & change)
    stretch = np.searchsorted(begin, first, "right") - 1
    final = np.minimum(np.append(first[1:], len(anchor)) - 1, last[stretch])
    place = anchor[first]
    whole = _pair((final - first).astype(np.uint64), (place - first).astype(np.uint64))
    tail = final + length - gram                  # the last q-gram of the span
    for at in range(0, 2 * length, gram):
        more = np.flatnonzero(first + (at - gram) < tail) if at else np.arange(len(first))
        if not len(more):
            break
        whole[more] = _pair(whole[more], grams[np.minimum(first[more] + at, tail[more])])
    return stretch, first, final, place, grams[place], whole


def _batch(rows: pa.RecordBatch, keep: int, at: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """The first ``keep`` columns of the rows ``at``, and more columns: signed
    longs where identifiers, ints where places."""
    at = pa.array(at)
    made = {k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int32) if v.dtype == np.int64 else v)
            for k, v in more.items()}
    return pa.RecordBatch.from_arrays([rows.column(k).take(at) for k in range(keep)] + list(made.values()),
                                      names=rows.schema.names[:keep] + list(made))


def _find_spans(length: int, gram: int, block: int):
    """Level 0: (k1, k2, text) -> (k1, k2, first, last, anchor, bucket, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, s in _blocks(batch.column(2), length, block):
                stretch, first, last, anchor, bucket, kind = anchor_spans(data, s[:, 2], s[:, 3], length, gram)
                shift = s[stretch, 1] - s[stretch, 2]
                yield _batch(batch, 2, s[stretch, 0], first=first + shift, last=last + shift, anchor=anchor + shift,
                             bucket=bucket, kind=kind)

    return run


def _numbers(batch: pa.RecordBatch, *cols: str) -> list[np.ndarray]:
    out = []
    for c in cols:
        x = batch.column(c).to_numpy(zero_copy_only=False)
        out.append(x.view(np.uint64) if x.dtype == np.int64 else x.astype(np.int64) if x.dtype == np.int32 else x)
    return out


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number in the row) of rows repeated ``counts`` times."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(batch: pa.RecordBatch, block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their pieces' bytes, where each piece begins) of about a block."""
    ends, raw = _ends(batch.column("bytes"))
    group = (ends[:-1] - ends[0]) // block
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a), raw[ends[a]:ends[b]], ends[a:b] - ends[a]


def _cut_spans(length: int, step: int, block: int):
    """Level 1: (k1, k2, piece, last, anchor, bucket, several, bytes), piece
    being the first start -> blocks (k1, k2, piece, first, last, bucket, kind, several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch, data, base in _pieces(whole_batch, block) if whole_batch.num_rows else ():
                first, last, anchor, bucket, several = _numbers(batch, "piece", "last", "anchor", "bucket", "several")
                core, whole = identifiers(data, length - step + 1, length)
                lowest = (anchor - last) // step
                row, nth = _counted((anchor - first) // step - lowest + 1)
                nth = nth + lowest[row]
                end = anchor[row] - nth * step            # a block is ``step`` starts up to here, cut at the span's ends
                a, b = np.maximum(end - (step - 1), first[row]), np.minimum(end, last[row])
                shift = base[row] - first[row]
                mine = _pair(_pair(core[end + shift], nth.astype(np.uint64)), bucket[row])
                kind = _pair(_pair(whole[a + shift], whole[b + shift]), ((b - a) * step + end - a).astype(np.uint64))
                yield _batch(batch, 3, row, first=a, last=b, bucket=mine, kind=kind, several=several[row])

    return run


def _cut_blocks(length: int, block: int):
    """Level 2: (k1, k2, piece, bytes, parts of (first, last, bucket, several))
    -> single starts (k1, k2, piece, first, last, bucket, kind, several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch, data, base in _pieces(whole_batch, block) if whole_batch.num_rows else ():
                whole, = identifiers(data, length)
                piece, = _numbers(batch, "piece")
                lists = batch.column("parts")
                parts = pa.RecordBatch.from_struct_array(lists.flatten())
                first, last, bucket, several = _numbers(parts, "first", "last", "bucket", "several")
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                part, nth = _counted(last - first + 1)
                start, row = first[part] + nth, owner[part]
                yield _batch(batch, 3, row, first=start, last=start, bucket=whole[start + base[row] - piece[row]],
                             kind=bucket[part], several=several[part])

    return run


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, covers of (begin, stop)) -> (k1, k2, runs): the bytes covered, as
    maximal runs in order."""
    for batch in batches:
        lists = batch.column(2)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        begin, stop = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(2))
        order = np.lexsort((begin, row))
        row, begin, stop = row[order], begin[order], stop[order]
        # the farthest stop so far in the row: rows are told apart by a shift no text is long enough for
        reach = np.maximum.accumulate(stop + (row << 32)) - (row << 32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(row)) - 1
        runs = pa.StructArray.from_arrays([pa.array(begin[heads].astype(np.int32)), pa.array(reach[tails].astype(np.int32))],
                                          ["begin", "stop"])
        offsets = np.append(0, np.cumsum(np.bincount(row[heads], minlength=len(lists)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), runs)],
                                         names=["k1", "k2", "runs"])


def _renamed(df: DataFrame, *cols: str) -> DataFrame:
    """The columns under names that the other side of a join does not have."""
    return df.withColumnsRenamed({c: f"{c}_" for c in cols})


def _on(*cols: str) -> list[Column]:
    return [F.col(c) == F.col(f"{c}_") for c in cols]


def _refine(rows: DataFrame, owner: list[str], level: int) -> tuple[DataFrame, DataFrame]:
    """One step over spans (owner columns, bucket, kind, several). ``several``
    marks a span that stands for two or more. Returns the spans found repeated
    (not those that stand for several: these were found before), and one span
    of each kind in mixed buckets (owner columns, bucket, several)."""
    weight = F.sum(F.when(F.col("several"), 2).otherwise(1))
    buckets = rows.groupBy("bucket").agg(weight.alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")).filter("n > 1")
    buckets = materialise(buckets.select(F.col("bucket").alias("bucket_"), (F.col("low") != F.col("high")).alias("mixed")),
                          f"suffix-buckets{level}")
    shared = materialise(rows.join(buckets, _on("bucket")).drop("bucket_"), f"suffix-shared{level}")
    mixed = shared.filter("mixed")
    kinds = materialise(mixed.groupBy("bucket", "kind").agg(weight.alias("n"), F.min(F.struct(*owner)).alias("one")),
                        f"suffix-kinds{level}")
    twice = _renamed(kinds.filter("n > 1").select("bucket", "kind"), "bucket", "kind")
    found = shared.filter("not mixed and not several").select(*owner).unionByName(
        mixed.filter("not several").join(twice, _on("bucket", "kind")).select(*owner))
    return found, kinds.select("one.*", "bucket", (F.col("n") > 1).alias("several"))


def _covers(spans: DataFrame, length: int) -> DataFrame:
    """(k1, k2, begin, stop): the bytes that strings starting in a span cover."""
    return spans.select(*KEY, F.col("first").alias("begin"), (F.col("last") + length).alias("stop"))


def _runs(covers: DataFrame) -> DataFrame:
    """(k1, k2, runs): maximal runs of each text; a text's spans are no more than its bytes."""
    lists = covers.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("begin", "stop")).alias("covers"))
    return map_in_arrow(lists, _merge_runs, f"k1 bigint, k2 bigint, runs {_RUNS}")


def _kept(raw: Column, removed: Column, n_bytes: Column) -> Column:
    """The bytes between the removed runs."""
    begins = F.concat(F.array(F.lit(0)), removed["stop"])
    stops = F.concat(removed["begin"], F.array(n_bytes.cast("int")))
    pieces = F.zip_with(begins, stops, lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
    return F.when(F.size(removed) == 0, raw).otherwise(F.array_join(pieces, "").cast("binary"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 128,
                   derive: dict[str, Callable[[Column], Column]] | None = None, step: int = STEP, block: int = BLOCK
                   ) -> DataFrame:
    """(id, n_bytes, removed, kept) per row of docs: removed is the list of
    maximal removed byte runs (begin, stop), kept what remains, as binary.
    ``derive`` replaces kept by columns made of it, so that the bytes need not
    travel any further. gram, step and block change the work, not the result."""
    if not 1 <= gram <= length:
        raise ValueError("a q-gram has 1 to length bytes")
    step = min(step, length)
    spark, derive = docs.sparkSession, derive or {"kept": lambda kept: kept}
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(13), text).alias("k2"),
                        F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    # level 0: a row an occurrence, so that copies count
    spans, place = materialise_at(
        map_in_arrow(keyed.filter(F.col("n_bytes") >= length).select(*KEY, "text"), _find_spans(length, gram, block),
                     "k1 bigint, k2 bigint, first int, last int, anchor int, bucket bigint, kind bigint"), "suffix-spans")
    found, rest = _refine(spans.withColumn("several", F.lit(False)), [*KEY, "first", "last", "anchor"], 0)
    discard(spark, place)
    runs = materialise(_runs(_covers(found, length)), "suffix-runs")
    parts = rest.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "anchor", "bucket", "several")).alias("parts"))

    # texts move once: those without spans to take apart are finished here
    known = runs.join(_renamed(parts, *KEY), _on(*KEY), "full").select(
        *[F.coalesce(k, f"{k}_").alias(f"{k}_") for k in KEY], "runs", "parts")
    none = F.array().cast(_RUNS)
    raw, open_ = F.col("text").cast("binary"), F.col("parts").isNotNull()
    met = keyed.join(known, _on(*KEY), "left").withColumn("runs", F.coalesce("runs", none))
    kept = _kept(raw, F.col("runs"), F.col("n_bytes"))
    pieces = F.transform("parts", lambda p: p.withField("bytes", F.substring(raw, p["first"] + 1, p["last"] - p["first"] + length)))
    met = materialise(met.select(
        "id", *KEY, "n_bytes", "runs", open_.alias("open"), F.when(open_, F.col("text")).alias("open_text"), pieces.alias("pieces"),
        *[F.when(~open_, make(kept)).alias(f"made_{name}") for name, make in derive.items()]), "suffix-texts")

    # levels 1 and 2: the bytes of the spans that are left, one row a span
    left = met.filter("open").select(*KEY, F.inline("pieces")).withColumnRenamed("first", "piece").dropDuplicates([*KEY, "piece"])
    left = materialise(left.select(*KEY, "piece", "last", "anchor", "bucket", "several", "bytes"), "suffix-pieces")
    schema = "k1 bigint, k2 bigint, piece int, first int, last int, bucket bigint, kind bigint, several boolean"
    owner = [*KEY, "piece", "first", "last"]
    found1, rest = _refine(map_in_arrow(left, _cut_spans(length, step, block), schema), owner, 1)
    parts = rest.groupBy(*KEY, "piece").agg(F.collect_list(F.struct("first", "last", "bucket", "several")).alias("parts"))
    parts = _renamed(parts, *KEY, "piece")
    starts = left.select(*KEY, "piece", "bytes").join(parts, _on(*KEY, "piece")).select(*KEY, "piece", "bytes", "parts")
    found2, _ = _refine(map_in_arrow(starts, _cut_blocks(length, block), schema), owner, 2)

    texts = met.filter("open").withColumnRenamed("open_text", "text")
    earlier = texts.select(*KEY, F.inline("runs"))
    runs = materialise(_runs(earlier.unionByName(_covers(found1.unionByName(found2), length))), "suffix-all-runs")
    done = met.filter("not open").select(F.col("id").alias(id_col), "n_bytes", F.col("runs").alias("removed"),
                                         *[F.col(f"made_{name}").alias(name) for name in derive])
    cut = texts.drop("runs").join(_renamed(runs, *KEY), _on(*KEY), "left").withColumn("removed", F.coalesce("runs", none))
    kept = _kept(raw, F.col("removed"), F.col("n_bytes"))
    return done.unionByName(cut.select(F.col("id").alias(id_col), "n_bytes", "removed",
                                       *[make(kept).alias(name) for name, make in derive.items()]))
