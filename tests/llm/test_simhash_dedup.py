import random
import re

import numpy as np
import pytest
import xxhash

from churnforge.llm.simhash_dedup import fingerprint, near_duplicates


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: [(id, fingerprint)] -> smallest id reachable over links of 4 bits or fewer."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a = np.array([f for _, f in fps], np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4):
            parent[find(int(j))] = find(i)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return [low.get(find(i)) for i in range(len(fps))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(3)
    texts = ["", " \n", "one", "One two three", "a b c d", "É É A b\u00a0c d\x0be f\x1cg", "x " * 500] + [
        " ".join(rng.choice(["The", "cat", "sat", "ÄB", "on\n", "mat\t"]) for _ in range(rng.randint(1, 60)))
        for _ in range(60)]
    for t in texts:
        assert fingerprint(t, 4) == brute_fingerprint(t)


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n\t"), (9000, "x" * 50_000)]
    for g in range(30):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(60, 600))]
        rows += [(10 + 100 * g + i, near(rng, words, rng.randint(0, 6))) for i in range(rng.randint(1, 25))]
    rows += [(8000 + i, "same text again and again") for i in range(40)] + [(8000, "same text again and again")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"blocks": 5}, {"blocks": 8}, {"max_bucket": 3}])
def test_components_equal_brute_force(docs_of, rows, options):
    """All block counts, and buckets that overflow into the ball links, find the same components."""
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(map(str, ((d, f, c) for (d, f), c in zip(fps, brute_components(fps)))))
    out = near_duplicates(docs_of(rows), **options).collect()
    got = sorted(str((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"])) for r in out)
    assert got == want


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_components_follow_long_chains(spark):
    from churnforge.llm.components import component_roots
    rng = random.Random(5)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)]
    out = component_roots(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in out} == {i: 0 for i in range(1, 200)} | {1000 + i: 1000 for i in range(1, 50)}
    assert len(out) == 199 + 49


def test_bits_are_counted_in_blocks(monkeypatch):
    from churnforge.llm import simhash_dedup
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    whole = simhash_dedup.fingerprint(text, 4)
    for block in (1, 7, 496, 497, 498):
        monkeypatch.setattr(simhash_dedup, "SHINGLES", block)
        assert simhash_dedup.fingerprint(text, 4) == whole == brute_fingerprint(text)
