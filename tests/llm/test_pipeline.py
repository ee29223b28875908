"""The pipeline against a brute-force version that shares only the operators'
per-document functions which have tests of their own."""

import random

import pytest

import corpus_pipeline
from churnforge.llm.language_id import identify_languages
from tests.llm.test_exact_dedup import brute as brute_exact  # noqa: F401
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_simhash_dedup import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    rows = [(900, None, None, None), (901, "", "en", "s"), (902, "1 2 3 " * 10, "en", "s"), (903, "short text", "en", "s")]
    for g in range(60):
        words = [f"{rng.choice(['the', 'and', 'of', 'ing'])}{rng.randrange(500)}" for _ in range(rng.randint(30, 400))]
        for k in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"other{rng.randrange(10**5)}"
            rows.append((10 * g + k, " ".join(copy) + rng.choice(["", " ", "\n"]), rng.choice(["en", "de", None]), f"s{g % 3}"))
    rng.shuffle(rows)
    return rows


def brute_pipeline(rows, und):
    rows = [r for r in rows if r[0] not in und]
    # quality
    kept = {eval(x)[0] for x in brute_quality(rows, 20, 0.1) if eval(x)[-1]}
    rows = [r for r in rows if r[0] in kept]
    # exact
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\f\r"), []).append((-len(t), d))
    kept = {min(g)[1] for g in groups.values()}
    rows = [r for r in rows if r[0] in kept]
    # near
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    return {d for (d, _), c in zip(fps, brute_components(fps)) if c == d}


def test_pipeline_equals_brute_force(spark, docs_of, rows):
    docs = docs_of(rows, extra=False)
    und = {r["doc_id"] for r in identify_languages(docs).collect() if r["lang_pred"] == "und"}
    assert und == {900, 901, 902}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in out} == brute_pipeline(rows, und)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts == {r[0]: r[1] for r in rows if r[0] in texts}


def test_stages_take_an_empty_table(spark, docs_of):
    docs = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.select("doc_id").distinct().count() < 200
