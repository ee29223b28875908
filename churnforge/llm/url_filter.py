"""Op 3: URL filter over a memory-mapped sorted digest array.

Every rule (host, path prefix, verdict) is stored under the XXH64 of its full
string in one sorted array of 64-bit keys, next to the strings themselves. The
files lie in the shared checkpoint folder, Spark's file distribution brings
them to each executor once, and tasks memory-map them. A URL's candidates are
its host and parent domains, each with the path prefixes of the lengths that
rules have; they are probed together by vectorised binary search and a hit
counts only if the stored full string is equal. The longest fitting rule
decides (of equal lengths, the one with the longer host; of equal strings, the
first given). A URL that fits no rule is not listed, and the method allows it.

Edge cases: a null URL or one without "://" has empty host and path and fits
no rule; an empty path starts with no rule path but the empty one; of a very
long host only the parents that are no longer than a rule's host are looked up;
repeated rows are judged alike; an empty table gives an empty one. Only the id
and URL columns are read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import SLICE_ROWS
from churnforge.session import map_in_arrow, scratch_path, write_shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def build_digest_array(spark: SparkSession, rules: Sequence[tuple[str, str, str]],
                       max_rules: int = 20_000_000) -> str:
    """Write the digest array of (verdict, host, path) rules and hand its files
    to the executors; returns their common name. The rules come from the
    caller, not from the data; more than ``max_rules`` of them are refused."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the digest array is built for {max_rules} at most")
    strings: dict[str, tuple[str, str]] = {}
    for verdict, host, path in rules:
        strings.setdefault(host + path, (verdict, host))
    full = [s.encode() for s in strings]
    keys = np.array([xxhash.xxh64_intdigest(s) for s in full], np.uint64)
    order = np.argsort(keys, kind="stable")
    files = {
        "keys": keys[order],
        "ends": np.cumsum([len(full[i]) for i in order], dtype=np.int64),
        "text": np.frombuffer(b"".join(full[i] for i in order), np.uint8),
        "block": np.array([list(strings.values())[i][0] == "block" for i in order], bool),
        "cuts": np.array(sorted({len(s) - len(h) for s, (_, h) in strings.items()}), np.int64),
    }
    name = f"digests-{uuid.uuid4().hex[:12]}"
    folder = scratch_path(spark, name)
    for part, array in files.items():
        data = io.BytesIO()
        np.save(data, array)
        write_shared(spark, f"{folder}/{name}.{part}.npy", data.getvalue())
        spark.sparkContext.addFile(f"{folder}/{name}.{part}.npy")
    return name


class DigestArray:
    """Memory-mapped digest array in a task."""

    def __init__(self, name: str):
        self.keys, self.ends, self.text, self.block, self.cuts = (
            np.load(SparkFiles.get(f"{name}.{part}.npy"), mmap_mode="r")
            for part in ("keys", "ends", "text", "block", "cuts"))

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Index of each full string, -1 where it is not stored."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        probe = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        at = np.searchsorted(self.keys, probe)
        open_ = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe)
        while len(open_):                      # equal digests lie side by side
            for i in open_:
                k = at[i]
                start = self.ends[k - 1] if k else 0
                if self.text[start:self.ends[k]].tobytes() == strings[i]:
                    out[i] = k
            open_ = open_[out[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] == probe[open_]]
        return out

    def judge(self, hosts: list[str], paths: list[str], longest: int) -> list[tuple[str | None, str]]:
        """(rule, verdict) of every host and path; no rule's host has more than
        ``longest`` characters, so longer parents of a host are not looked up."""
        cuts = self.cuts.tolist()
        strings, owner = [], []
        for k, (host, path) in enumerate(zip(hosts, paths)):
            if len(host) > longest:
                host = host[-longest - 1:].partition(".")[2]
            while host:
                for cut in cuts:
                    if cut <= len(path):
                        strings.append((host + path[:cut]).encode())
                        owner.append((k, len(host)))
                host = host.partition(".")[2]
        best: dict[int, tuple[int, int, str, str]] = {}
        found = self.find(strings)
        for i in np.flatnonzero(found >= 0):
            k, host_len = owner[i]
            rule = strings[i].decode()
            rank = (len(rule), host_len)
            if k not in best or rank > best[k][:2]:
                best[k] = *rank, rule, "block" if self.block[found[i]] else "allow"
        return [best[k][2:] if k in best else (None, "allow") for k in range(len(hosts))]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row of pages; map-only."""
    name = build_digest_array(pages.sparkSession, rules)
    longest = max((len(host) for _, host, _ in rules), default=0)
    schema = T.StructType([pages.schema[id_col], T.StructField("host", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(name)
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            judged = digests.judge(hosts, paths, longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.string())],
                names=schema.names)

    url = F.coalesce(F.col(url_col), F.lit(""))
    return map_in_arrow(pages.select(id_col, url_host(url).alias("host"), url_path(url).alias("path")), run, schema)
