import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnforge.llm.byte_bpe import ByteBpe
from churnforge.llm.packing import pack_best_fit, token_pieces
from churnforge.llm.queries import packed_documents, q_op9
from churnforge.llm.token_counts import count_by_chunks, token_counts

BITS = ["a", "B", "the", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "12", "é", "日本", "𝒳", ".", "!?", "'s",
        "<|endoftext|>", "\u2028", "\u180e", "\u200b", "\r\n", "word", " word", "'ll", "_"]


@pytest.fixture(scope="module")
def library(vocab):
    return Tokenizer.from_file(vocab("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def bpe(vocab):
    with open(vocab("byte_bpe_50k.json"), "rb") as f:
        return ByteBpe(f.read())


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["", " ", "  ", "\n", " a", "a ", "a  ", "  a", "\u00a0 a", "a \u00a0"] + [
        "".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_ids_equal_the_library(bpe, library):
    narrow = [b for b in BITS if max(b) < "\u0250"]
    rng = random.Random(20)
    latin = ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(32, 127)])) for _ in range(rng.randint(1, 200)))
             for _ in range(500)]
    many = texts(1500, 60, 8) + ["".join(rng.choice(narrow) for _ in range(60)) for _ in range(1500)] + latin
    many += ["a" * 5000, "ab" * 3000, "=" * 4000, " " * 20_000 + "x", "\n" * 3000]
    assert bpe.fast is not None
    for t in many:
        want = library.encode(t, add_special_tokens=False).ids
        got = bpe.ids(t)
        assert got.tolist() == want, repr(t)
        assert bpe.byte_lens[got].sum() == len(t.encode())


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (200, 1)])
def test_chunks_resynchronise(bpe, library, chunk, overlap):
    many = texts(120, 400, 9) + ["x" * 900, " " * 700, "ab " * 300, "日" * 300, "a" * 300 + " " + "b" * 300 + " c"]
    for t in many:
        assert count_by_chunks(bpe, t, chunk, overlap) == len(library.encode(t, add_special_tokens=False)), repr(t)


def test_counts_operator(docs_of, vocab, library, spark):
    rows = [(1, None), (2, ""), (3, "to be"), (3, "to be"), (None, "é <|endoftext|>"), (5, "long text é " * 6000)]
    out = token_counts(docs_of(rows), vocab("byte_bpe_50k.json")).collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out] == [
        (d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in rows]
    assert token_counts(docs_of([]), vocab("byte_bpe_50k.json")).count() == 0
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False))
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in q_op9(spark, sf).collect()} == want


def test_pieces(docs_of, vocab, library):
    rows = [(1, None), (2, "a b c"), (3, "word " * 57), (None, "x y"), (5, " ".join(map(str, range(300))))]
    out = token_pieces(docs_of(rows), vocab("byte_bpe_50k.json"), 16, 2).collect()
    by_doc = {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and (r["length"] == 16 or r["piece"] == 0)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        got = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == np.cumsum([0] + [r["length"] for r in got])[:-1].tolist()
        assert b"".join(r["ids"] for r in got) == np.array(ids, "<u4").tobytes()


def check_packing(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= capacity
    return len(by_seq)


def best_fit_bins(lengths, capacity):
    """Bins of best-fit decreasing over all items at once."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, k) for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("parts", ["1", "8", "70"])
def test_packing_is_gapless_and_tight(spark, parts):
    rng = random.Random(10)
    lengths = [rng.choice([rng.randint(0, 1024), rng.randint(1, 60), 1024, 600]) for _ in range(3000)]
    items = spark.createDataFrame([(i, n, "s") for i, n in enumerate(lengths)], "k bigint, length bigint, bin string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = pack_best_fit(items, "length", 1024, ["k"], leaf_items=1).select("item.*", "sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted((r["k"], r["length"], r["bin"]) for r in out) == [(i, n, "s") for i, n in enumerate(lengths)]
    assert check_packing(out, 1024) <= 1.02 * best_fit_bins(lengths, 1024) + 1


def test_small_bins_of_all_partitions_meet(spark):
    """Every partition ends with one bin under half full; the tree joins them."""
    items = spark.createDataFrame([(i, 100) for i in range(60)], "k bigint, length bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        out = pack_best_fit(items, "length", 1000, ["k"], leaf_items=1).select("item.*", "sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert check_packing(out, 1000) == 6


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "k bigint, length bigint")
    assert pack_best_fit(empty, "length", 10, ["k"]).count() == 0
    same = spark.createDataFrame([(None, 4), (None, 4), (1, None), (1, 0)], "k bigint, length bigint")
    out = pack_best_fit(same, "length", 10, ["k"]).select("item.*", "sequence_id", "offset").collect()
    assert len(out) == 4 and len({r["sequence_id"] for r in out}) == 1
    with pytest.raises(Exception, match="does not fit"):
        pack_best_fit(spark.createDataFrame([(1, 11)], "k bigint, length bigint"), "length", 10, ["k"]).count()


def test_packed_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = packed_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    total = 0
    assert {r["doc_id"] for r in out} == set(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        total += r["length"]
    assert total == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert check_packing(out, 1024) <= 1.03 * -(-total // 1024) + 1
