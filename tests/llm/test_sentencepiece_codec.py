import random

import pytest
import sentencepiece

from churnforge.llm.queries import q_op1
from churnforge.llm.segments import SegmentStore
from churnforge.llm.sentencepiece_codec import LONG_WORD, PieceCodec, sentencepiece_round_trip

ODD = ["", " ", "  ", "a", "a ", "a  b", " a", " ▁x", "▁", "▁▁", "\n", "a\n\nb", "12345", "日本語テキスト",
       "x\x00y", "�", "<s>", "<0x41>", "é" * 300, "a" * 1000, "ab" * 700, " " * 500, "\t\t", "é", "𝒳𝒴",
       "x" * (LONG_WORD - 1), "x" * LONG_WORD, "the " * 3000]


@pytest.fixture(scope="module")
def library(vocab):
    return sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec(vocab):
    with open(vocab("piece_bpe_32k.model"), "rb") as f:
        return PieceCodec(f.read())


def encode(codec, texts, **kw):
    return SegmentStore(codec.encode_words, **kw).encode([codec.words(t) for t in texts])


@pytest.mark.parametrize("max_segments", [1_000_000, 3])
def test_rounds_equal_the_library(codec, library, max_segments):
    rng = random.Random(1)
    bits = ["a", "b", "e", "th", "in", "er", " ", "  ", "▁", "\n", "é", "日", "𝒳", "0", "1", ".", "<s>", "aaa", "tion"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 500))) for _ in range(400)]
    flat, offsets = encode(codec, texts, max_segments=max_segments)
    decoded = codec.decode(flat, offsets)
    for k, t in enumerate(texts):
        want = library.encode(t)
        assert flat[offsets[k]:offsets[k + 1]].tolist() == want, t[:80]
        assert decoded[k] == library.decode(want), t[:80]


def test_decode_of_any_ids(codec, library):
    import numpy as np
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(1, 12))]
        assert codec.decode(np.array(ids), np.array([0, len(ids)])) == [library.decode(ids)], ids


def test_operator_nulls_repeats_and_empty_table(docs_of, vocab, library):
    rows = [(1, None), (2, ""), (3, "to be or not"), (3, "to be or not"), (None, "a  b"), (5, "x" * 60_000)]
    out = sentencepiece_round_trip(docs_of(rows), vocab("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids"]) for r in out if r["doc_id"] != 5) == sorted(
        (i is None, i, library.encode(t or "")) for i, t in rows if i != 5)
    assert all(r["decoded"] == (t or "") for r, (_, t) in zip(out, rows))
    assert sentencepiece_round_trip(docs_of([]), vocab("piece_bpe_32k.model")).count() == 0


def test_query_digests(spark, library):
    import hashlib
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = q_op1(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_the_word_store_is_bounded_by_characters(codec):
    from churnforge.llm.segments import SegmentStore
    store, whole = SegmentStore(codec.encode_words, max_chars=1000), SegmentStore(codec.encode_words)
    words = codec.words(" ".join(f"word{i}" for i in range(800)))
    for at in range(0, len(words), 20):
        flat, offsets = store.encode([words[at:at + 20]])
        want, _ = whole.encode([words[at:at + 20]])
        assert flat.tolist() == want.tolist() and len(offsets) == 2
        assert store.chars <= 1000 and len(store.flat) <= 2000
    assert whole.chars > 1000
