"""Op 5: language identification by prediction by partial matching.

Every language has a variable-order byte context tree (PPM, method C: a symbol
new to a context is coded by an escape and the next shorter context). The
statistics are frozen after fitting, so the exact code length of a symbol
depends on the context alone and all languages' code lengths lie in one table;
a text costs two child lookups and one table row a byte. The language with the
shortest total code wins, of equal ones the first by name.

Fitting uses a bounded sample: about ``sample_docs`` whole documents a
language, chosen by a hash of the id (all of them where there are fewer).
n-grams are counted by Spark; the collected counts and the broadcast table are
bounded by the sample, and contexts seen fewer than ``min_count`` times fall
back to shorter ones.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as
is every text when there is nothing to learn from; rows with a null id or
language are predicted but never learned from. Whole texts are scored, very
long ones in pieces of a million bytes; repeated rows score alike; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import text_slices
from churnforge.session import map_in_arrow, release_memory, ship_package, small_batches

ORDER = 3
BLOCK = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LEAD = b"\n" * ORDER


def _bytes(text: str) -> bytes:
    return text.lower().encode()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows -> (lang, n, gram, count) of all n-grams up to ORDER + 1."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(_LEAD + _bytes(text))
        for lang, parts in by_lang.items():
            data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            lead = np.zeros(len(data), bool)
            at = 0
            for p in parts:
                lead[at:at + ORDER] = True
                at += len(p)
            gram = np.zeros(len(data), np.int64)
            for n in range(1, ORDER + 2):
                gram = data if n == 1 else (np.concatenate(([0], gram[:-1])) << 8) | data
                # a gram's last byte is text; the bytes before it may be the lead
                shorter = gram & ((1 << (8 * n)) - 1)
                grams, counts = np.unique(shorter[~lead], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), n, np.int32)),
                     pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "n", "gram", "count"])
                gram = shorter


class ContextTrees:
    """Code lengths of all languages: cost[node, symbol, language] in bits."""

    def __init__(self, langs: list[str], lang_at: np.ndarray, n: np.ndarray, gram: np.ndarray, count: np.ndarray,
                 min_count: int):
        self.langs = langs
        seen = np.union1d(gram[n == 1], list(_LEAD))
        self.symbol = np.zeros(256, np.int32)          # 0: a byte never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        nodes = {0: {0: 0}}                            # by length: context bytes -> node
        contexts = [(0, 0)]
        for k in range(1, ORDER + 1):
            of = n == k + 1
            totals, back = np.unique(gram[of] >> 8, return_inverse=True)
            weight = np.bincount(back, count[of], minlength=len(totals))
            nodes[k] = {}
            for c in totals[weight >= min_count].tolist():
                # a context needs its one-shorter prefix, by which it is reached
                if (c >> 8) in nodes[k - 1] and self.symbol[c & 255]:
                    nodes[k][c] = len(contexts)
                    contexts.append((k, c))
        self.size = size
        self.child = np.zeros((len(contexts), size), np.int32)
        for node, (k, c) in enumerate(contexts[1:], 1):
            self.child[nodes[k - 1][c >> 8], self.symbol[c & 255]] = node
        self.cost = np.zeros((len(contexts), size, len(langs)), np.float32)
        base = np.full((size, len(langs)), 8.0, np.float32)
        for k in range(ORDER + 1):
            of = n == k + 1
            g, w, l = gram[of], count[of], lang_at[of]
            node = np.array([nodes[k].get(c, -1) for c in (g >> 8).tolist()], np.int64)
            ok = node >= 0
            node, sym, w, l = node[ok], self.symbol[g[ok] & 255], w[ok].astype(float), l[ok]
            total = np.zeros((len(contexts), len(langs)))
            kinds = np.zeros((len(contexts), len(langs)))
            np.add.at(total, (node, l), w)
            np.add.at(kinds, (node, l), 1)
            for c, x in nodes[k].items():
                escape = np.where(total[x] > 0, -np.log2(np.maximum(kinds[x], 1) / np.maximum(total[x] + kinds[x], 1)), 0)
                shorter = base if k == 0 else self.cost[self._suffix(nodes, k, c)]
                self.cost[x] = shorter + escape.astype(np.float32)
            self.cost[node, sym, l] = -np.log2(w / (total[node, l] + kinds[node, l]))

    @staticmethod
    def _suffix(nodes: dict, k: int, c: int) -> int:
        for shorter in range(k - 1, -1, -1):
            x = nodes[shorter].get(c & ((1 << (8 * shorter)) - 1))
            if x is not None:
                return x
        return 0

    def bits(self, texts: list[str], block: int = BLOCK) -> np.ndarray:
        """Code length of each text in each language. A text longer than a block
        is scored in pieces, each after the bytes its first contexts need, so the
        arrays do not grow with a text."""
        total = np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, bytes]] = []
        size = 0
        for row, text in enumerate(texts):
            data = _LEAD + _bytes(text)
            for at in range(ORDER, max(len(data), ORDER + 1), block):
                held.append((row, data[at - ORDER:at + block]))
                size += len(held[-1][1])
                if size >= block:
                    self._add(total, held)
                    held, size = [], 0
        self._add(total, held)
        return total

    def _add(self, total: np.ndarray, pieces: list[tuple[int, bytes]]) -> None:
        """Code lengths of pieces, whose first ORDER bytes are context only."""
        if not pieces:
            return
        lens = np.array([len(p) for _, p in pieces], np.int64)
        sym = self.symbol[np.frombuffer(b"".join(p for _, p in pieces), np.uint8)].astype(np.int64)
        child = self.child.ravel()
        level = child[sym]                              # node of the last byte
        context = level.copy()
        for _ in range(ORDER - 1):
            longer = np.zeros_like(level)
            longer[1:] = child[level[:-1].astype(np.int64) * self.size + sym[1:]]
            longer[1:][level[:-1] == 0] = 0
            context = np.where(longer > 0, longer, context)
            level = longer
        row = np.zeros(len(sym), np.int64)
        row[1:] = context[:-1]
        cost = self.cost.reshape(-1, len(self.langs))[row * self.size + sym]
        starts = np.cumsum(lens) - lens
        cost[(starts[:, None] + np.arange(ORDER)).ravel()] = 0
        np.add.at(total, [r for r, _ in pieces], np.add.reduceat(cost, starts, axis=0, dtype=np.float64))

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, posterior under equal priors, bits a byte) of each text;
        UNKNOWN, 0, 0 where it has no letter."""
        known = [i for i, t in enumerate(texts) if _LETTER.search(t)]
        lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if known:
            bits = self.bits([texts[i] for i in known])
            low = bits.min(axis=1)
            score[known] = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(axis=1)
            rate[known] = low / [len(_bytes(texts[i])) for i in known]
            for i, b in zip(known, bits.argmin(axis=1)):
                lang[i] = self.langs[b]
        return lang, score, rate


def held_out(id_col: str) -> Column:
    """crc32 of the id's text leaves remainder 1 of 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_context_trees(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      sample_docs: int = 400, min_count: int = 4) -> ContextTrees | None:
    """Frozen trees from about ``sample_docs`` documents of each language."""
    labelled = labelled.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return None
    buckets = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items())
                           for x in (lang, min(buckets, -(-buckets * sample_docs // n)))])
    sample = labelled.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)) < share[F.col(lang_col)])
    counts = (map_in_arrow(sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")),
                           _gram_counts, "lang string, n int, gram bigint, count bigint")
              .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")).toArrow())
    langs = sorted(sizes)
    place = {x: i for i, x in enumerate(langs)}
    return ContextTrees(langs, np.array([place[x] for x in counts["lang"].to_pylist()], np.int64),
                        counts["n"].to_numpy(), counts["gram"].to_numpy(), counts["count"].to_numpy(), min_count)


def predict_language(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) per row of docs; map-only."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch, texts in text_slices(batches, 1, BLOCK):
            lang, score, rate = trees.judge(texts) if trees else ([UNKNOWN] * len(texts), *np.zeros((2, len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)],
                                             names=schema.names)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_in_arrow(given, run, schema).withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       sample_docs: int = 400) -> DataFrame:
    """Fit on the documents that are not held out, predict all documents."""
    trees = fit_context_trees(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, sample_docs)
    return predict_language(docs, trees, id_col, text_col)


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    sample_docs: int = 400) -> DataFrame:
    """The rows of docs whose text is in a learned language, with all their
    columns. Rows stay in the JVM: a worker gets texts and gives back names."""
    trees = fit_context_trees(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, sample_docs)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)
    ship_package(spark)
    small_batches(spark)

    @F.arrow_udf("string")
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = model.value
        try:
            for column in texts:
                found: list[str] = []
                for _, part in text_slices([pa.RecordBatch.from_arrays([column], names=["text"])], 0, BLOCK):
                    found += trees.judge(part)[0] if trees else [UNKNOWN] * len(part)
                yield pa.array(found, pa.string())
        finally:
            release_memory()

    return docs.filter(language(F.col(text_col)) != UNKNOWN)
