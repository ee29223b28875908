import random
from collections import Counter

import numpy as np
import pytest

from churnforge.llm.suffix_dedup import _lowest, identifiers, remove_repeats


def brute(rows, length):
    """Every string of every text, looked up in a counter of all of them."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((doc, len(t), list(zip(edges[::2].tolist(), edges[1::2].tolist())),
                    bytes(b for b, g in zip(t, gone) if not g)))
    return out


def run(df, **how):
    return sorted(str((r["doc_id"], r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"])))
                  for r in remove_repeats(df, **how).collect())


def text(rng, n, alphabet="abcdefghé𝒳 "):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    passage, hot = text(rng, 150), text(rng, 90)
    rows = [(None, None), (1, ""), (2, "short"), (2, "short"), (None, passage), (3, "a" * 400), (4, "ab" * 90), (5, "é" * 100),
            (6, text(rng, 30) + passage + text(rng, 10) + passage[:60]), (7, passage[70:]), (8, passage[30:110] + "!" + passage[40:])]
    for i in range(150):                         # texts that share parts of a passage, at any place
        a, b = sorted((rng.randrange(150), rng.randrange(150)))
        rows.append((100 + i, text(rng, rng.randrange(60)) + passage[a:b] + text(rng, rng.randrange(60))))
    rows += [(1000 + i, hot + text(rng, 3)) for i in range(120)]        # near copies
    rows += [(2000 + i, hot + passage) for i in range(130)]             # exact copies
    rows += [(3000 + i, text(rng, rng.randrange(200), "ab")) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,gram,step,block", [(40, 12, 8, 1 << 20), (64, 25, 5, 50), (3, 2, 16, 7)])
def test_equals_brute_force(docs_of, rows, length, gram, step, block):
    assert run(docs_of(rows), length=length, gram=gram, step=step, block=block) == sorted(map(str, brute(rows, length)))


def test_long_texts(spark, docs_of):
    """A text of several blocks, one string of it at the other end and in another text."""
    rng = random.Random(9)
    long = text(rng, 300_000, "abcdefgh")
    rows = [(1, long + long[1234:1234 + 400]), (2, long[250_000:250_500]), (3, long[5:404]), (4, "x" * 100_000)]
    for block in (1 << 20, 10_000):
        assert run(docs_of(rows), block=block) == sorted(map(str, brute(rows, 400)))


def test_identifiers_stand_for_their_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 5000).astype(np.uint8)
    for depth, found in zip((1, 2, 3, 7, 8, 13), identifiers(data, 1, 2, 3, 7, 8, 13)):
        assert len(found) == len(data) - depth + 1
        names = {}
        for p, x in enumerate(found.tolist()):
            assert names.setdefault(x, data[p:p + depth].tobytes()) == data[p:p + depth].tobytes()
        assert len(set(names.values())) == len(names)
    assert len(identifiers(data[:3], 5)[0]) == 0
    keys = rng.integers(0, 99, 50)
    for width in (1, 2, 3, 8, 13):
        assert _lowest(keys, width).tolist() == [keys[i:i + width].min() for i in range(51 - width)]


def test_derived_columns_and_empty_table(docs_of):
    from pyspark.sql import functions as F
    same = {"size": lambda kept: F.octet_length(kept)}
    out = remove_repeats(docs_of([(1, "x" * 500), (2, "y" * 10)]), derive=same).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == [(1, 0), (2, 10)]
    assert remove_repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs_of([]), length=4, gram=5)
