import random
import re
from collections import Counter, defaultdict

import pytest

from churnforge.llm.quality_rules import quality_filter, quality_verdicts

WS = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(WS, text or "") if w]


def base(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if n[w] > 1 for o in range(8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def brute(rows, min_docs, share, crowd=100, crowd_words=5):
    held, hosts = defaultdict(set), defaultdict(set)
    lines = {}
    for _, t, _, h in rows:
        t = t or ""
        hosts[h].add(t)
        lines[t] = [" ".join(words_of(x)).lower() for x in t.split("\n") if words_of(x)]
        for x in lines[t]:
            held[h, x].add(t)
    out = []
    for d, t, _, h in rows:
        f = base(t)
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        gone = 0
        for x in lines[t or ""]:
            n, words = len(held[h, x]), len(x.split(" "))
            if n > min_docs and (n > share * len(hosts[h]) or (n > crowd and words >= crowd_words)):
                gone += words
        depleted = f[0] - gone < 0.3 * f[0]
        out.append((d, *f, failed, gone, not failed and not depleted))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["ÉÀ", "##", "a|b", "<x>", " "]
    common = ["Share this  page\tnow", "share this page NOW", "All rights reserved by the owners of this site today"]
    rows = [(None, None, "en", None), (1, "", "en", "a"), (2, " \n\t\x0b", "en", "a"), (3, "one " * 30, "en", "a"),
            (3, "one " * 30, "en", "a"), (4, " ".join(f"u{i}" for i in range(9000)), "en", None)]
    for i in range(250):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(common))
        if rng.random() < 0.2:
            lines += lines[:2]
        rows.append((10 + i, "\n".join(lines), "en", rng.choice(["a", "a", "b", None])))
    rows += [(1000 + i, " ".join(f"copy{j}" for j in range(40)) + "\nand its second line", "en", "a") for i in range(60)]
    return rows


@pytest.mark.parametrize("min_docs,share", [(20, 0.1), (3, 0.02)])
def test_equals_brute_force(docs_of, rows, min_docs, share):
    docs = docs_of(rows)
    out = quality_verdicts(docs, min_docs=min_docs, share=share).collect()
    got = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                      r["n_repeat_words"], r["base_failed"], r["removed_words"], r["kept"])) for r in out)
    assert got == brute(rows, min_docs, share)
    kept = quality_filter(docs, min_docs=min_docs, share=share)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in out if r["kept"])
    texts = {d: t for d, t, _, _ in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in kept.collect())


def test_a_banner_on_a_hot_host(docs_of):
    """A banner in 3% of a hot host is boilerplate: its words go, and documents
    that are little else are rejected; a short line as common stays, and so does
    the banner where few documents hold it."""
    rng = random.Random(4)
    banner = " ".join(f"banner{k}" for k in range(30)) + " "
    rows = []
    for i in range(5000):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        rows.append((i, own + ("\n" + banner if i % 33 == 0 else "\nread more") if i % 7 else own, "en", "hot"))
    few = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(5)) for _ in range(150)]
    rows += [(10_000 + i, banner + "\n" + x, "en", "hot") for i, x in enumerate(few)]          # the banner and five words
    rows += [(20_000 + i, banner + "\n" + x, "en", None if i % 2 else "") for i, x in enumerate(few[:30])]
    out = {r["doc_id"]: r for r in quality_verdicts(docs_of(rows, extra=False)).collect()}
    assert all(out[i]["kept"] for i in range(5000))
    assert {out[i]["removed_words"] for i in range(5000) if i % 33 == 0 and i % 7} == {30}
    assert not any(out[10_000 + i]["kept"] or out[10_000 + i]["base_failed"] for i in range(150))
    assert all(out[20_000 + i]["removed_words"] == 0 for i in range(30))          # 15 documents of each of two hosts
    kept = {r["doc_id"] for r in quality_filter(docs_of(rows, extra=False)).select("doc_id").collect()}
    assert kept == {i for i, r in out.items() if r["kept"]}


def test_a_group_of_copies_stays(docs_of, rows):
    out = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs_of(rows)).collect()}
    assert all(out[1000 + i] for i in range(60))


def test_empty_table_and_native_plan(docs_of, spark):
    for operator in (quality_verdicts, quality_filter):
        assert operator(docs_of([])).count() == 0
        plan = operator(docs_of([(1, "a b")]))._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
