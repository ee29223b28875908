"""Registered queries of the training-data operators and their SQL.

Each query applies its operator to the whole table and derives the digest
columns from the operator's real output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.llm.common import load
from churnforge.llm.exact_dedup import exact_duplicates
from churnforge.llm.fill_in_middle import fill_in_middle, restored
from churnforge.llm.html_extract import extract_main_text
from churnforge.llm.language_id import held_out, identify_languages
from churnforge.llm.license_scan import scan_licences
from churnforge.llm.packing import pack_best_fit, token_pieces
from churnforge.llm.quality_rules import quality_verdicts
from churnforge.llm.sentencepiece_codec import sentencepiece_round_trip
from churnforge.llm.simhash_dedup import near_duplicates
from churnforge.llm.suffix_dedup import remove_repeats
from churnforge.llm.token_counts import token_counts
from churnforge.llm.url_filter import filter_urls
from churnforge.llm.vector_codes import compress_vectors

# Fixed values of the contracts.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SEQUENCE_TOKENS, END_ID, TOKEN_LIMIT = 1024, 2, 1024
CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS, CODE_SCALE = 4, 256, 4, 1024
REPEAT_BYTES = 400


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_round_trip(load(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"), URL_RULES)


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(load(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Packed pieces with the digest of their ids; the ids themselves do not
    travel with the packing, whose items are lengths."""
    pieces = token_pieces(docs, vocabulary("byte_bpe_50k.json"), SEQUENCE_TOKENS, END_ID).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    packed = pack_best_fit(pieces, "length", SEQUENCE_TOKENS, ["doc_id", "piece", "ids_crc32"])
    return packed.select("item.*", "sequence_id", "offset")


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(load(spark, sf_dir, "documents"))


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in each document, by name, and the best coefficient."""
    found = scan_licences(load(spark, sf_dir, "documents"), inline=True)
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",").alias("licences"),
                        F.coalesce(F.array_max(F.col("matches.dice")), F.lit(0.0)).alias("best_dice"))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(load(spark, sf_dir, "documents"))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum a label is small and pre-aggregated; it returns by a null-safe join."""
    coded, books = compress_vectors(load(spark, sf_dir, "embeddings"), parts=CODE_PARTS, entries=CODE_ENTRIES,
                                    rounds=CODE_ROUNDS, scale=CODE_SCALE, carry=["label"])
    rows = coded.select("vec_id", F.col("row.label").alias("label"),
                        F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    numbers = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents"), length=REPEAT_BYTES,
                         derive={"kept_sha256": lambda kept: F.sha2(kept, 256)})
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + (r["stop"] - r["begin"]))
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      "kept_sha256")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": q_op1,
    "op2_simhash": q_op2,
    "op3_url_filter": q_op3,
    "op4_exact_dedup": q_op4,
    "op5_language_id": q_op5,
    "op6_html_extract": q_op6,
    "op7_packing": q_op7,
    "op8_license_scan": q_op8,
    "op9_token_counts": q_op9,
    "op10_quality_rules": q_op10,
    "op11_fill_in_middle": q_op11,
    "op12_vector_codes": q_op12,
    "op13_suffix_dedup": q_op13,
}


def _vector_codes_sql(width: int = 16) -> str:
    """Every part against every entry, a step a round; ``width`` components a part."""
    whole = "(s{j} - (((s{j} % n) + n) % n)) // n"          # floored, below zero too
    means = "list_value(" + ", ".join(whole.format(j=j) for j in range(1, width + 1)) + ")"
    sums = ", ".join(f"sum(x.v[{j}]) s{j}" for j in range(1, width + 1))
    gap = " + ".join(f"(x.v[{j}] - c.v[{j}]) * (x.v[{j}] - c.v[{j}])" for j in range(1, width + 1))
    steps = [f"""
        whole as (
          select vec_id, label, [floor({CODE_SCALE} * e::double)::bigint for e in embedding] v from embeddings
          where embedding is not null and len([e for e in embedding if e is null or not isfinite(e)]) = 0),
        x as (select vec_id, label, part, v[{width} * part + 1:{width} * part + {width}] v
              from whole, range(0, {CODE_PARTS}) r(part)),
        c0 as (select part, entry, v from (
          select part, v, row_number() over (partition by part order by vec_id) - 1 entry from x) where entry < {CODE_ENTRIES})"""]
    for n in range(CODE_ROUNDS + 1):
        steps.append(f"""
        a{n} as materialized (select vec_id, part, min(struct_pack(d := {gap}, e := entry)) best
               from x join c{n} c using (part) group by vec_id, part)""")
        if n < CODE_ROUNDS:
            steps.append(f"""
        c{n + 1} as materialized (
          select c.part, c.entry, coalesce(m.v, c.v) v from c{n} c left join (
            select part, entry, {means} v from (
              select x.part, best.e entry, count(*) n, {sums} from x join a{n} using (vec_id, part) group by all)) m
          using (part, entry))""")
    return f"""
        with {",".join(steps)},
        coded as (select vec_id, string_agg(printf('%02x', best.e), '' order by part) code, sum(best.d)::bigint error
                  from a{CODE_ROUNDS} group by vec_id),
        book as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) h from c{CODE_ROUNDS})
        select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256
        from coded join whole using (vec_id), book"""


# Operators whose results SQL can express; the others are tested against the
# libraries, brute force or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": """
        with d as (
          select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
        u as (
          select doc_id, t, length(t) n, ('0x' || substr(h, 1, 8))::ubigint::bigint h1, ('0x' || substr(h, 9, 8))::ubigint::bigint h2,
                 ('0x' || substr(h, 17, 8))::ubigint::bigint h3, ('0x' || substr(h, 25, 8))::ubigint::bigint h4 from d),
        c as (
          select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
                 case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                      when h4 % 100 < 20 then 'spm' else 'psm' end form from u)
        select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
               sha256(case form when 'plain' then t
                      when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                      else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end) output_sha256,
               sha256(t) restored_sha256 from c""",
    "op12_vector_codes": _vector_codes_sql(),
    "op13_suffix_dedup": f"""
        with d as (
          select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
        cuts as (
          select r, c, substr(h, 2 * c + 1, 2 * ({REPEAT_BYTES} + 255)) h
          from (select r, h, unnest(range(0, len(h) // 2 - {REPEAT_BYTES - 1}, 256)) c from d)),
        starts as (
          select r, c + p p, md5(substr(h, 2 * p + 1, 2 * {REPEAT_BYTES})) s
          from (select r, c, h, unnest(range(0, len(h) // 2 - {REPEAT_BYTES - 1})) p from cuts)),
        again as (select r, p from starts join (select s from starts group by s having count(*) > 1) using (s)),
        edges as (
          select r, p, case when p - lag(p) over w <= {REPEAT_BYTES} then 0 else 1 end head from again
          window w as (partition by r order by p)),
        runs as (
          select r, min(p) a, max(p) + {REPEAT_BYTES} b
          from (select r, p, sum(head) over (partition by r order by p) run from edges) group by r, run),
        gone as (select r, sum(b - a) n_removed, count(*) n_spans, max(b) last from runs group by r),
        left_of as (
          select r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) kept
          from (select r, a, coalesce(lag(b) over (partition by r order by a), 0) before from runs) join d using (r) group by r)
        select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256
        from d left join gone using (r) left join left_of using (r)""",
    "op3_url_filter": r"""
        with u as (
          select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest
          from pages),
        p as (
          select page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
        r(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
          ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fit as (
          select page_id, arg_max(rhost || rpath, length(rhost || rpath)) rule,
                 arg_max(verdict, length(rhost || rpath)) verdict
          from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
          group by page_id)
        select p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict
        from p left join fit on p.page_id = fit.page_id""",
    "op4_exact_dedup": r"""
        with n as (
          select doc_id, length(coalesce(text, '')) size,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm from documents),
        w as (
          select doc_id, norm, first_value(doc_id) over (partition by norm order by size desc, doc_id) keep_id,
                 count(*) over (partition by norm) group_size from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) text_sha256 from w""",
    "op10_quality_rules": r"""
        with d as (
          select doc_id, case when source is null then '' else '=' || source end host, coalesce(text, '') t,
                 [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] w,
                 [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] l from documents),
        win as (
          select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') g
          from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)),
        rep as (
          select doc_id, count(distinct i + o) n from (
            select doc_id, i, count(*) over (partition by doc_id, g) c from win), range(0, 8) s(o)
          where c > 1 group by doc_id),
        lines as (
          select doc_id, host, t, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) line
          from (select doc_id, host, t, unnest(l) x from d)),
        hosts as (select host, count(distinct t) docs from d group by host),
        common as (
          select line_host, line from (
            select host line_host, line, count(distinct t) n from lines group by host, line) c
          join hosts on host = line_host where n > 20 and (n > 0.1 * docs or (n > 100 and len(string_split(line, ' ')) >= 5))),
        gone as (
          select doc_id, sum(len(string_split(lines.line, ' '))) removed
          from lines join common on host = line_host and lines.line = common.line group by doc_id),
        f as (
          select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint n_symbols,
                 (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words,
                 coalesce(removed, 0)::bigint removed_words
          from d left join rep on d.doc_id = rep.doc_id left join gone on d.doc_id = gone.doc_id),
        b as (
          select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
                 n_words - removed_words as left_words from f)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed,
               not base_failed and left_words >= 0.3 * n_words as kept
        from b""",
}
