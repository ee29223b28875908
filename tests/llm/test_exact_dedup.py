import hashlib
import random
import re
from collections import defaultdict

import pytest

from churnforge.llm.exact_dedup import exact_duplicates, exact_filter


def brute(rows):
    groups = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), d is None, d or 0, k))
    out = []
    for norm, members in groups.items():
        members.sort()
        keep = rows[members[0][3]][0]
        for n, m in enumerate(members):
            out.append((rows[m[3]][0], keep, len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \n"), (3, " \n"), (4, "ab"), (5, "a  b"), (5, "a  b"),
            (6, "a\u00a0b"), (None, None), (7, "y" * 60_000), (8, "y" * 59_999 + " y"), (9, "é 𝒳"), (10, "é𝒳")]
    rows += [(100 + i, "one hot text" + " " * rng.randrange(3)) for i in range(700)]
    rows += [(1000 + i, f"text {rng.randrange(120)}" + "\n" * rng.randrange(2)) for i in range(400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", ["8", "40", "1"])
def test_equals_brute_force(spark, docs_of, rows, parts):
    """A group larger than a partition spreads over many and is stitched."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = docs_of(rows)
        plain = exact_duplicates(docs).collect()
        left = exact_filter(docs)
        kept = left.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in plain) == brute(rows)
    assert left.columns == docs.columns
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", t or "").encode()).hexdigest()
    stays = sorted(str((r["doc_id"], r["text_sha256"])) for r in plain if r["kept"])
    assert sorted(str((r["doc_id"], digest(r["text"]))) for r in kept) == stays


def test_empty_table(docs_of):
    assert exact_duplicates(docs_of([])).count() == 0
    assert exact_filter(docs_of([])).count() == 0
