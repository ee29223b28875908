import math
import zlib

import pytest

from churnforge.llm.language_id import ORDER, fit_context_trees, identify_languages, language_filter
from churnforge.llm.queries import q_op5


def brute_bits(train, text):
    """PPM method C over frozen counts, straight from the definition (no pruning)."""
    lead = b"\n" * ORDER
    counts = {}
    for t in train:
        b = lead + t.lower().encode()
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                counts.setdefault(b[i - k:i], {}).setdefault(b[i], 0)
                counts[b[i - k:i]][b[i]] += 1
    b, total = lead + text.lower().encode(), 0.0
    for i in range(ORDER, len(b)):
        for k in range(ORDER, -1, -1):
            seen = counts.get(b[i - k:i])
            if seen is None:
                continue
            c, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / (c + d))
                break
            total -= math.log2(d / (c + d))
        else:
            total += 8
    return total


def test_code_lengths_equal_brute_force(docs_of):
    rows = [(i, t, l) for i, (t, l) in enumerate([
        ("the cat sat on the mat", "en"), ("the dog ran to the house", "en"), ("der hund und die katze", "de"),
        ("das haus und der garten für", "de"), ("le chat et la maison", "fr")])]
    trees = fit_context_trees(docs_of(rows), min_count=1)
    assert trees.langs == ["de", "en", "fr"]
    texts = ["the house", "Hund und Haus", "la maison et le chat", "zzz qqq", "ü", "x"]
    bits = trees.bits(texts)
    for k, t in enumerate(texts):
        for j, lang in enumerate(trees.langs):
            # a context unseen in a language but seen in another is passed over there as well
            assert bits[k, j] == pytest.approx(brute_bits([r[1] for r in rows if r[2] == lang], t), rel=1e-4)


def test_long_texts_are_scored_in_pieces(docs_of):
    """Any cut gives the code length of the whole text."""
    trees = fit_context_trees(docs_of([(0, "the cat and the dog " * 9, "en"), (2, "der hund und die katze " * 9, "de")]), min_count=1)
    texts = ["the dog und die Katze é日𝒳 " * 50, "", "a", "the hund"]
    whole = trees.bits(texts)
    for block in (1, 2, 3, 7, 64):
        assert trees.bits(texts, block) == pytest.approx(whole, rel=1e-6)


def test_held_out_accuracy_and_rule(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = q_op5(spark, sf).collect()
    assert len(out) == len(lang)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95


def test_nulls_and_empty_tables(docs_of, spark):
    rows = [(0, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"),
            (5, "12 %%% 34 ²", "fr"), (None, "the cat", "en"), (7, "the dog", None), (7, "the dog", None),
            (8, "the cat sat " * 8000, "en")]
    docs = docs_of(rows)
    out = identify_languages(docs).collect()
    assert len(out) == len(rows)
    known = sorted(str(r[0]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert sorted(str(r["doc_id"]) for r in out if r["lang_pred"] != "und") == known
    left = language_filter(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == known
    assert language_filter(docs_of([])).count() == 0
    assert identify_languages(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in identify_languages(docs_of([(1, "abc", None)])).collect()} == {"und"}
