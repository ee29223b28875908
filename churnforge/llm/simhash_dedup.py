"""Op 2: SimHash near-duplicates by pigeonhole blocks.

A text's words (ASCII white space apart, A-Z lower-cased) give shingles; bit j
of the fingerprint is set when it is set in over half of the shingles' XXH64
hashes. Fingerprints at max_bits or fewer differing bits are linked and links
are followed transitively.

Candidates: the 64 bits are cut into max_bits + 2 blocks or more; two
fingerprints within max_bits agree on all but max_bits blocks, so they share
the key made of those blocks' bits. Every key's bucket is verified bit by bit
inside a task and leaves a spanning forest, never all its pairs. A bucket of
more than max_bucket distinct fingerprints is not held in one task: its
members meet at the common centres of their bit-flip balls instead, which
finds exactly the same links.

Edge cases: null and empty texts, and texts of white space, have no words and
fingerprint zero, linked like any other; texts shorter than a shingle hash
their whole word sequence; the bits of very long texts are
counted block by block; exact copies are one fingerprint from the start, so
their number does not matter. Null ids form no component of their own: they
take the smallest id their fingerprint reaches (null if none). Repeated rows
give repeated results, an empty table an empty one; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import materialise, text_slices
from churnforge.llm.components import component_roots
from churnforge.session import map_in_arrow

SEED = 42
SHINGLES = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = text.encode().lower().split()     # bytes: A-Z only, and exactly [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    del words
    starts, stops = np.append(0, ends[:-shingle]), ends[shingle - 1:] - 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES):     # bits are counted block by block
        block = zip(starts[at:at + SHINGLES].tolist(), stops[at:at + SHINGLES].tolist())
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in block])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint bigint): one row per row of docs; map-only."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=schema.names)

    return map_in_arrow(docs.select(id_col, text_col), run, schema)


def _block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """Keys of all choices of blocks - max_bits blocks; the choice's number is
    in the key's struct, so different choices never meet."""
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    shifts = [sum(sizes[:i]) for i in range(blocks)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << sizes[i]) - 1) << shifts[i] for i in chosen)
        out.append(F.struct(F.lit(n).cast("short").alias("choice"),
                            fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("bits")))
    return F.array(*out)


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one bucket, breadth first: each member
    is compared with those not reached yet."""
    left, edges = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                reached = left[near]
                edges += [(x, y) for y in reached]
                front += list(reached)
                left = left[~near]
    return edges


def _link_buckets(max_bits: int, max_bucket: int):
    """Streams (choice, bits, fingerprint) rows sorted by key; yields links
    (a, b, false) and the members of oversized buckets (a, a, true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, held_key, over = [], 0, None, False

        def rows(pairs, flag):
            a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
            b = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(np.full(len(a), flag))], names=["a", "b", "crowded"])

        def close():
            if over or held_n < 2:
                return []
            return _forest(np.concatenate(held), max_bits)

        for batch in batches:
            if not batch.num_rows:
                continue
            choice = batch.column(0).to_numpy().astype(np.int64)
            bits = batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(fps)]))
            pairs, crowded = [], []
            # buckets wholly inside the batch with two members: one vectorised comparison
            inner = np.zeros(len(first), bool)
            inner[1:-1] = True
            two = first[inner & (last - first == 2)]
            linked = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits]
            pairs += list(zip(fps[linked], fps[linked + 1]))
            for k in np.flatnonzero(~inner | (last - first > 2)):
                part, key = fps[first[k]:last[k]], (choice[first[k]], bits[first[k]])
                if key != held_key:
                    pairs += close()
                    held, held_n, held_key, over = [], 0, key, False
                held.append(part)
                held_n += len(part)
                if over or held_n > max_bucket:
                    crowded += [(x, x) for part in held for x in part]
                    held, over = [], True
            if pairs:
                yield rows(pairs, False)
            if crowded:
                yield rows(crowded, True)
        if pairs := close():
            yield rows(pairs, False)

    return run


def _ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among members of oversized buckets: two fingerprints are within
    max_bits exactly if some word is within half of max_bits of both."""
    radius = (max_bits + 1) // 2
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in masks])
    near = fps.select("a", F.explode(F.transform(flips, lambda m: F.col("a").bitwiseXOR(m))).alias("centre"))
    near = materialise(near, "simhash-centres")
    low = near.groupBy(F.col("centre").alias("c")).agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n"))
    links = near.join(low.filter("n > 1").select("c", "b"), F.col("centre") == F.col("c")).filter("a != b")
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", blocks: int | None = None, max_bucket: int = 50_000) -> DataFrame:
    """(id, fingerprint bigint, component_id) per row of docs.

    blocks: how many blocks the 64 bits are cut into; any number over max_bits
    finds the same links. By default the smallest, from max_bits + 2 on, whose
    keys have at least as many bits as the count of fingerprints, so that
    buckets hold a few unrelated members at any corpus size.
    """
    marked = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash-fingerprints")
    distinct = materialise(marked.groupBy("fingerprint").agg(F.min(id_col).alias("low_id")), "simhash-distinct")
    if blocks is None:
        need = max(1, distinct.count()).bit_length()
        blocks = next(m for m in range(max_bits + 2, 64) if 64 * (m - max_bits) // m >= need)
    keyed = distinct.select("fingerprint", F.explode(_block_keys(F.col("fingerprint"), blocks, max_bits)).alias("k"))
    keyed = keyed.select("k.choice", "k.bits", "fingerprint").repartition("choice", "bits")
    links = map_in_arrow(keyed.sortWithinPartitions("choice", "bits"), _link_buckets(max_bits, max_bucket),
                         "a bigint, b bigint, crowded boolean")
    links = materialise(links, "simhash-links")
    edges = links.filter("not crowded").select("a", "b")
    if links.filter("crowded").limit(1).count():
        edges = edges.union(_ball_links(links.filter("crowded").select("a").distinct(), max_bits))
    roots = materialise(component_roots(edges, "a", "b"), "simhash-roots")
    rooted = materialise(
        distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "low_id", F.coalesce("root", "fingerprint").alias("root")), "simhash-rooted")
    lows = materialise(rooted.groupBy(F.col("root").alias("r")).agg(F.min("low_id").alias("component_id")),
                       "simhash-lows")
    classes = materialise(rooted.join(lows, F.col("root") == F.col("r"))
                          .select(F.col("fingerprint").alias("f"), "component_id"), "simhash-classes")
    return marked.join(classes, F.col("fingerprint") == F.col("f")).select(id_col, "fingerprint", "component_id")
