import random
import re

from churnforge.llm.queries import URL_RULES
from churnforge.llm.url_filter import DigestArray, build_digest_array, filter_urls


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rhost, rpath in rules:
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath):
            rank = (len(rhost + rpath), len(rhost))
            if best is None or rank > best[0]:
                best = rank, rhost + rpath, verdict
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rules = URL_RULES + [("block", "a.b.com", ""), ("block", "b.com", "/x"), ("allow", "b.com", "/x/y"),
                         ("block", "net", "/"), ("allow", "org", "/")]
    urls = [None, "", "no scheme", "://", "http://", "http:///x", "HTTP://WWW.Example.ORG/en/12?q#f", "x://org", "x://org/",
            "x://notorg/", "http://example.org#a/b", "http://example.org?x=/es/", "a://b://c.org/x", "h://É.COM/fr/ä\n/b"]
    hosts = ["org", "example.org", "www.example.org", "com", "a.b.com", "q.a.b.com", "b.com", "x.net", "EXAMPLE.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/17?x", "/fr/a", "/de/b#c", "/x", "/x/y/z", "/X"]
    urls += [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    # very long hosts: many labels, one label, none of them a rule's
    long = "a." * 150_000
    urls += [f"http://{long}{h}/en/12" for h in ("example.org", "b.com", "xcom")] + ["http://" + "z" * 300_000 + ".org/x", f"http://{long}"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    for chosen in (rules, URL_RULES, []):
        out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
               for r in filter_urls(df, chosen).collect()}
        assert out == {i: brute(u, chosen) for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0), rules).count() == 0


def test_digest_collision_is_confirmed_by_the_full_string(spark, monkeypatch):
    import xxhash
    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: real(s) % 3)   # nearly all digests collide
    array = DigestArray(build_digest_array(spark, [("block", f"h{i}.com", "/") for i in range(20)]))
    assert (array.find([b"h3.com/", b"h33.com/", b"h19.com/"]) >= 0).tolist() == [True, False, True]
    assert array.text[slice(*[0 if k == 0 else array.ends[k - 1] for k in [0]], array.ends[0])].tobytes().endswith(b".com/")
