import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnforge.llm.fill_in_middle import cut_texts, fill_in_middle, restored


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    alphabet = ["a", "<", "P", ">", "é", "𝒳", "\n", "\0", " ", "S>", "<M", "日"]
    rows = [(None, None), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "a<P>b"), (5, "<M>"), (6, "<S"), (None, "no id"),
            (7, "é𝒳" * 700_000), (8, "z" * 3_000_000)]
    return rows + [(10 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(600)]


def test_equals_brute_force(docs_of, rows):
    out = fill_in_middle(docs_of(rows)).withColumn("restored", restored(F.col("output"), F.col("form")))
    got = sorted(str(tuple(r)) for r in out.collect())
    assert got == sorted(str(brute(d, t)) for d, t in rows)
    assert {r["form"] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_do_not_show(block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("aé日𝒳") for _ in range(rng.randrange(30))) for _ in range(50)] + ["", ""]
    cuts = np.sort([[rng.randint(0, len(t)) for t in texts] for _ in range(2)], axis=0)
    for given in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        found = cut_texts(given, cuts[0], cuts[1], max(4, block))
        for t, a, b, *pieces in zip(texts, cuts[0], cuts[1], *(f.to_pylist() for f in found)):
            assert pieces == [t[:a], t[a:b], t[b:]]


def test_empty_table(docs_of):
    assert fill_in_middle(docs_of([])).count() == 0
