"""Op 10: quality rules with cross-document line frequency, in SQL functions only.

Base figures come from the document alone. The method's verdict: every line is
normalised (lower case, white space runs as one space) and hashed; per host
(the source column) the distinct documents that hold a line are counted; a
line held by more than ``min_docs`` documents is boilerplate if these are more
than ``share`` of the host's documents, or, where it has ``crowd_words`` words or
more, if they are more than ``crowd``: on a host of many documents a banner in
a few per cent of them is one too, while short lines may well recur there. The
words of boilerplate are removed; a document is depleted, and rejected, when less than ``min_left`` of its words remain. (A
short text beside one shared line is still its own text: no absolute count of
words is asked for again here.)

Copies of one text on a host are one document here, so a group of copies
neither makes its own lines boilerplate nor multiplies the work: lines are
exploded once a distinct text and host. The repeated windows of a text are
found inside its row; a text without equal windows costs one hash set.

Edge cases: null and empty texts have no words and fail the base rules; a null
source is a host of its own; repeated rows are judged alike, and null ids like
any other; an empty table gives an empty one. The rows' own columns travel inside one
struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnforge.llm.common import WS, materialise

BLANKS = " \t\n\x0b\f\r"
WINDOW = 8


def _with_repeats(df: DataFrame, windows: str, out: str) -> DataFrame:
    """Add ``out``: words inside windows whose hash occurs twice or more.

    Step by step in columns, each used more than once, so that no step is
    evaluated again for every element of the next.
    """
    rest = [c for c in df.columns if c != windows]
    # most texts repeat no window: for them nothing is sorted
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*rest, F.when(some, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_o"))
    df = df.select(*rest, "_o", F.size("_o").alias("_n"))
    # neighbours in hash order side by side: a window repeats if it equals either
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("_o.h", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))))
    after = F.concat(F.when(F.col("_n") > 1, F.slice("_o.h", F.lit(2), F.greatest(F.col("_n") - 1, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")), F.array(F.lit(None).cast("bigint")))
    three = F.when(F.col("_n") > 0, F.arrays_zip(F.col("_o").alias("w"), before.alias("b"), after.alias("a")))
    hits = F.transform(F.filter(three, lambda x: (x["w"]["h"] == x["b"]) | (x["w"]["h"] == x["a"])), lambda x: x["w"]["i"])
    places = F.flatten(F.transform(hits, lambda i: F.sequence(i, i + (WINDOW - 1))))
    return df.select(*rest, F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long").alias(out))


KEY = ["_host", "_digest", "_chars"]


def _text_key(text: Column, host: str) -> list[Column]:
    """What stands for a distinct text of a host."""
    named = F.when(F.col(host).isNull(), "").otherwise(F.concat(F.lit("="), F.col(host).cast("string")))
    return [named.alias("_host"), F.xxhash64(text).alias("_digest"),
            F.length(text).alias("_chars")]


def _raw_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_figures(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words,
    and _raw_lines."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    step = docs.select(
        *keep, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS)).alias("_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _raw_lines(text).alias("_raw_lines"))
    names = [c for c in step.columns if c != "_words"]
    step = step.select(
        *names, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_raw_lines") - F.size(F.array_distinct("_raw_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))).otherwise(
            F.array().cast("array<bigint>")).alias("_windows"))
    return _with_repeats(step, "_windows", "n_repeat_words")


def _base_failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _line_key(line: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), WS, " "))
    words = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    return F.struct(F.xxhash64(plain).alias("h"), words.alias("w"))


def _removed_words(texts: DataFrame, min_docs: int, share: float, crowd: int, crowd_words: int) -> DataFrame:
    """(key columns with a trailing underscore, gone): words of boilerplate
    lines in every distinct text that has any. ``texts``: key and _lines."""
    hosts = texts.groupBy(F.col("_host").alias("at")).agg(F.count(F.lit(1)).alias("docs"))
    held = (texts.select("_host", F.explode(F.array_distinct("_lines")).alias("l")).groupBy("_host", F.col("l.h").alias("h"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("l.w").alias("w")).filter(F.col("n") > min_docs))
    many = (F.col("n") > share * F.col("docs")) | ((F.col("n") > crowd) & (F.col("w") >= crowd_words))
    common = materialise(
        held.join(hosts, F.col("_host") == F.col("at")).filter(many)
        .select(F.col("_host").alias("line_host"), F.col("h").alias("line")), "quality-lines")
    lines = texts.select(*KEY, F.explode("_lines").alias("l")).select(*KEY, "l.h", "l.w")
    return materialise(
        lines.join(common, (F.col("_host") == F.col("line_host")) & (F.col("h") == F.col("line")))
        .groupBy(*[F.col(c).alias(f"{c}_") for c in KEY]).agg(F.sum("w").cast("long").alias("gone")), "quality-removed")


def _same_key() -> list[Column]:
    return [F.col(c) == F.col(f"{c}_") for c in KEY]


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     min_words: int = 20, max_repeat_percent: int = 30, min_docs: int = 20, share: float = 0.1,
                     crowd: int = 100, crowd_words: int = 5, min_left: float = 0.3) -> DataFrame:
    """One row per row of docs: id, the base figures, base_failed, removed_words
    (in boilerplate lines) and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    figures = word_figures(docs, text, [F.col(id_col).alias("_id"), *_text_key(text, host_col)])
    marked = materialise(figures.withColumn("_lines", F.transform("_raw_lines", _line_key)).drop("_raw_lines"),
                         "quality-documents")
    texts = materialise(marked.select(*KEY, "_lines").dropDuplicates(KEY), "quality-texts")
    out = marked.join(_removed_words(texts, min_docs, share, crowd, crowd_words), _same_key(), "left")
    removed = F.coalesce("gone", F.lit(0)).cast("long")
    failed = _base_failed(min_words, max_repeat_percent)
    depleted = F.col("n_words") - removed < min_left * F.col("n_words")
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", failed.alias("base_failed"), removed.alias("removed_words"),
                      (~failed & ~depleted).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 20,
                   max_repeat_percent: int = 30, min_docs: int = 20, share: float = 0.1, crowd: int = 100,
                   crowd_words: int = 5, min_left: float = 0.3) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns.

    The texts themselves are neither written nor shuffled: lines travel as
    hashes, and what comes back to the rows is the table of depleted texts'
    keys - a text's lines hold all its words, so it follows from the lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(*_text_key(text, host_col), F.transform(_raw_lines(text), _line_key).alias("_lines"))
    texts = materialise(lines.dropDuplicates(KEY), "quality-texts")
    gone = _removed_words(texts, min_docs, share, crowd, crowd_words)
    words = F.aggregate(F.col("_lines.w"), F.lit(0).cast("long"), lambda a, w: a + w)
    depleted = materialise(
        texts.select(*KEY, words.alias("words")).join(gone, _same_key())
        .filter(F.col("words") - F.col("gone") < min_left * F.col("words")).select(*[f"{c}_" for c in KEY]),
        "quality-depleted")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    judged = word_figures(docs, text, [row, *_text_key(text, host_col)])
    # A filter on the figures would be pushed below them and evaluate them anew inside
    # each other. So a row that passes travels in an array of one, and the filter
    # stands on what unpacking the array gives.
    passes = F.when(~_base_failed(min_words, max_repeat_percent), F.array(F.struct(F.lit(True).alias("_passes"), "_row")))
    judged = judged.select(*KEY, passes.alias("_rows"))
    return (judged.join(depleted, _same_key(), "left_anti").select(F.inline_outer("_rows"))
            .filter("_passes").select("_row.*"))
