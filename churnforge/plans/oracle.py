"""DuckDB oracle SQL for every deterministic query key.

Each string runs on the driver-registered views (customer, orders,
nation, region, lineitem, ...). Column names and types mirror the
Spark side; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from churnforge.sources.tables import CATEGORICAL, NUMERIC

NUMERIC_CLEAN = NUMERIC + ["total_charges"]
RAW_COLS = ["id", "customer_id", "segment", "region", "urgent_user", "in_debt", "tenure",
            "n_orders", "max_order", "acctbal", "total_text", "churn"]
RAW_TYPES = {"id": "bigint", "customer_id": "string", "segment": "string", "region": "string",
             "urgent_user": "string", "in_debt": "int", "tenure": "int", "n_orders": "int",
             "max_order": "double", "acctbal": "double", "total_text": "string", "churn": "string"}

BASE_CTES = {
    "cc_m": "SELECT max(o_orderdate) AS mx FROM orders",
    "cc_a": """SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, count(*) AS n,
        sum(o_totalprice) AS t, max(o_totalprice) AS hi,
        sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS u
      FROM orders GROUP BY o_custkey""",
    "cc": """SELECT CAST(c_custkey AS BIGINT) AS id, 'C' || CAST(c_custkey AS VARCHAR) AS customer_id,
        c_mktsegment AS segment, r_name AS region,
        CASE WHEN u > 0 THEN 'Yes' ELSE 'No' END AS urgent_user,
        CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS in_debt,
        CAST(coalesce(datediff('day', f, l), 0) AS INTEGER) AS tenure,
        CAST(coalesce(n, 0) AS INTEGER) AS n_orders,
        CAST(coalesce(hi, 0.0) AS DOUBLE) AS max_order,
        CAST(c_acctbal AS DOUBLE) AS acctbal,
        CASE WHEN c_custkey % 97 = 0 OR t IS NULL THEN ' '
             ELSE CAST(CAST(round(t, 2) AS DECIMAL(18, 2)) AS VARCHAR) END AS total_text,
        CASE WHEN l IS NULL OR l < mx - INTERVAL 365 DAY THEN 'Yes' ELSE 'No' END AS churn
      FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey
      LEFT JOIN cc_a ON c_custkey = o_custkey CROSS JOIN cc_m""",
    "cl_med": "SELECT quantile_cont(TRY_CAST(trim(total_text) AS DOUBLE), 0.5) AS med FROM cc",
    "typed": """SELECT id, segment, region, urgent_user, in_debt, tenure, n_orders, max_order, acctbal,
        TRY_CAST(trim(total_text) AS DOUBLE) AS total_charges,
        CAST(CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS label
      FROM cc""",
    "clean": "SELECT * REPLACE (coalesce(total_charges, (SELECT med FROM cl_med)) AS total_charges) FROM typed",
    "records": """SELECT * EXCLUDE (churn) REPLACE (CASE WHEN id % 89 <> 0 THEN segment END AS segment,
        CASE WHEN id % 83 = 0 THEN 'ATLANTIS' ELSE region END AS region,
        CASE WHEN id % 79 = 0 THEN '5d' WHEN id % 73 = 0 THEN 'nan' ELSE total_text END AS total_text) FROM cc""",
}
#: What counts as a number in text.
NUMBER = "regexp_full_match(trim(total_text), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"
RECORD_CHECK = ("SELECT *, concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in RAW_COLS if c not in ("id", "churn"))
    + ") AS missing_fields, CASE WHEN total_text IS NOT NULL AND NOT " + NUMBER
    + " THEN 'total_text' ELSE '' END AS bad_numeric FROM records")


def with_base(body: str, extra: dict[str, str] | None = None) -> str:
    ctes = dict(BASE_CTES)
    if extra:
        ctes.update(extra)
    parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _long(table: str, cols: list[str], label: str | None = None, as_type: str = "VARCHAR",
          where_not_null: bool = False) -> str:
    parts = []
    for c in cols:
        lab = f", {label}" if label else ""
        w = f" WHERE {c} IS NOT NULL" if where_not_null else ""
        parts.append(f'SELECT {q(c)} AS "column", CAST({c} AS {as_type}) AS value{lab} FROM {table}{w}')
    return "(" + union_all(parts) + ")"


# --------------------------------------------------------------------- sources / projections
def sql_sources() -> dict[str, str]:
    cols = ", ".join(RAW_COLS)
    no_id = ", ".join(c for c in RAW_COLS if c != "customer_id")
    nums = ["id", "in_debt", "tenure", "n_orders", "max_order", "acctbal"]
    return {
        "scan_schema": with_base(f"SELECT {cols} FROM cc"),
        "csv_round_trip": with_base(f"SELECT {cols} FROM cc"),
        "head_sample": with_base(f"SELECT {cols} FROM cc ORDER BY id LIMIT 10"),
        "drop_ids": with_base(f"SELECT {no_id} FROM cc"),
        "select_numeric": with_base(f"SELECT {', '.join(nums)} FROM cc"),
        "cast_numeric": with_base("SELECT id, " + ", ".join(
            f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC) + " FROM cc"),
        "coerce_numeric": with_base(
            "SELECT id, total_text, TRY_CAST(trim(total_text) AS DOUBLE) AS total_charges FROM cc"),
        "encode_label": with_base(
            "SELECT id, churn, CAST(CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS label FROM cc"),
        "impute_product": with_base(
            "SELECT id, " + r6("coalesce(TRY_CAST(trim(total_text) AS DOUBLE), n_orders * max_order)")
            + " AS total_charges FROM cc"),
        "impute_median": with_base(
            "SELECT id, CAST(TRY_CAST(trim(total_text) AS DOUBLE) IS NULL AS INTEGER) AS was_missing, "
            + r6("coalesce(TRY_CAST(trim(total_text) AS DOUBLE), (SELECT med FROM cl_med))")
            + " AS total_charges FROM cc"),
        "validate_records": with_base(
            "SELECT id, missing_fields, bad_numeric, CAST(missing_fields = '' AND bad_numeric = '' AS INTEGER) AS is_valid "
            f"FROM ({RECORD_CHECK})"),
    }


# --------------------------------------------------------------------- profiling
def sql_profile() -> dict[str, str]:
    cat = list(CATEGORICAL)
    num = list(NUMERIC_CLEAN)
    raw_cat = ["customer_id", "segment", "region", "urgent_user", "total_text", "churn"]
    out: dict[str, str] = {}

    clean_cols = cat + num + ["label"]
    out["constant_columns"] = with_base(
        'SELECT "column", CAST(count(DISTINCT value) <= 1 AS INTEGER) AS is_constant FROM '
        + _long("typed", clean_cols) + ' GROUP BY "column"')

    out["drop_constants"] = with_base("SELECT id, " + ", ".join(
        f"{r6(c)} AS {c}" if c in ("max_order", "acctbal", "total_charges") else c for c in clean_cols) + " FROM typed")

    parts = []
    for c in RAW_COLS:
        parts.append(
            f'SELECT {q(c)} AS "column", {q(RAW_TYPES[c])} AS dtype, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, '
            f'CAST(count(*) - count({c}) AS BIGINT) AS n_missing, '
            f'{r6(f"(count(*) - count({c})) * 100.0 / count(*)")} AS missing_pct FROM cc')
    out["column_overview"] = with_base(union_all(parts))

    parts = []
    for c in num:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f'SELECT {q(c)} AS "column", CAST(count({x}) AS BIGINT) AS count, {r6(f"avg({x})")} AS mean, '
            f'{r6(f"stddev_samp({x})")} AS std, {r6(f"min({x})")} AS min, '
            f'{r6(f"quantile_cont({x}, 0.25)")} AS q25, {r6(f"quantile_cont({x}, 0.5)")} AS q50, '
            f'{r6(f"quantile_cont({x}, 0.75)")} AS q75, {r6(f"max({x})")} AS max FROM clean')
    out["describe_numeric"] = with_base(union_all(parts))

    parts = []
    for c in num:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f'SELECT {q(c)} AS "column", {r6(f"skewness({x})")} AS skewness, '
                     f'{r6(f"kurtosis({x})")} AS kurtosis FROM clean')
    out["moments"] = with_base(union_all(parts))

    out["unique_profile"] = with_base(
        'SELECT "column", CAST(count(*) AS BIGINT) AS n_unique, '
        "CASE WHEN count(*) <= 12 THEN string_agg(value, ',' ORDER BY value) END AS \"values\" FROM "
        '(SELECT DISTINCT "column", coalesce(value, \'0\') AS value FROM ' + _long("cc", RAW_COLS) + ') '
        'GROUP BY "column"')

    out["describe_categorical"] = with_base(
        'SELECT "column", CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique, '
        'arg_min(value, (-n, value)) AS top, CAST(max(n) AS BIGINT) AS freq FROM '
        '(SELECT "column", value, count(*) AS n FROM ' + _long("cc", raw_cat, where_not_null=True)
        + ' GROUP BY "column", value) GROUP BY "column"')

    out["label_distribution"] = with_base(
        "SELECT churn AS value, count(*) AS count, " + r6("count(*) / (SELECT count(*) FROM cc)")
        + " AS share FROM cc GROUP BY churn")

    out["category_counts"] = with_base(
        'SELECT "column", value, label, count(*) AS count FROM ' + _long("clean", cat, "label")
        + ' GROUP BY "column", value, label')

    out["crosstab_label"] = with_base(
        'SELECT "column", value, count(CASE WHEN label = 0 THEN 1 END) AS n_0, '
        'count(CASE WHEN label = 1 THEN 1 END) AS n_1 FROM ' + _long("clean", cat, "label", where_not_null=True)
        + ' GROUP BY "column", value')

    out["churn_rate_by"] = with_base(
        'SELECT "column", value, count(*) AS n, ' + r6("avg(CAST(label AS DOUBLE)) * 100")
        + ' AS churn_rate FROM ' + _long("clean", cat, "label", where_not_null=True)
        + ' WHERE label IS NOT NULL GROUP BY "column", value')

    out["category_odds"] = with_base(
        'SELECT "column", value, count(CASE WHEN label = 1 THEN 1 END) AS churned, '
        'count(CASE WHEN label = 0 THEN 1 END) AS not_churned, '
        'round(count(CASE WHEN label = 1 THEN 1 END) / (count(CASE WHEN label = 0 THEN 1 END) + 1e-6) * 100, 2) '
        'AS odds_pct FROM ' + _long("clean", cat, "label", where_not_null=True) + ' GROUP BY "column", value')

    out["boxplot_stats"] = boxplot_sql("clean", num, "label")
    out["histogram_by_label"] = with_base(
        """SELECT bin, """ + r6("lo + bin * w") + " AS bin_start, " + r6("lo + (bin + 1) * w") + """ AS bin_end,
               label, count(*) AS count FROM (
          SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((CAST(tenure AS DOUBLE) - lo) / w), 9) END AS INTEGER) AS bin,
                 label, lo, w
          FROM clean, (SELECT min(CAST(tenure AS DOUBLE)) AS lo, (max(CAST(tenure AS DOUBLE)) - min(CAST(tenure AS DOUBLE))) / 10 AS w FROM clean) r
          WHERE tenure IS NOT NULL) GROUP BY bin, label, lo, w""")

    pairs = [(a, b) for i, a in enumerate(num) for b in num[i + 1:]]
    out["corr_matrix"] = with_base(union_all([
        f"SELECT {q(a)} AS col_a, {q(b)} AS col_b, {r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM clean"
        for a, b in pairs]))

    out["label_correlation"] = with_base(
        "SELECT feature, corr FROM (" + union_all([
            f"SELECT {q(c)} AS feature, {r6(f'corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE))')} AS corr FROM clean"
            for c in num]) + ") ORDER BY corr DESC NULLS LAST, feature LIMIT 10")

    copied = pairs + [(c, "order_copy") for c in num]
    out["high_corr_columns"] = with_base(
        "SELECT col_b AS \"column\", round(max(abs(r)), 6) AS max_abs_corr, "
        "string_agg(DISTINCT col_a, ',' ORDER BY col_a) AS correlated_with FROM (" + union_all([
            f"SELECT {q(a)} AS col_a, {q(b)} AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM with_copy"
            for a, b in copied]) + ") WHERE abs(r) > 0.95 GROUP BY col_b",
        {"with_copy": "SELECT *, max_order * 2 + 1 AS order_copy FROM clean"})

    assoc_cols = cat + ["in_debt"]
    out["category_association"] = with_base(
        """SELECT "column", """ + r6("C1 / N") + " AS share, " + r6("chi2") + " AS chi2, "
        + r6("CASE WHEN least(r, 2) - 1 > 0 THEN sqrt(chi2 / (N * (least(r, 2) - 1))) ELSE 0.0 END")
        + """ AS cramers_v FROM (
          SELECT "column", sum(
              CASE WHEN e0 > 0 THEN (n_0 - e0) * (n_0 - e0) / e0 ELSE 0.0 END +
              CASE WHEN e1 > 0 THEN (n_1 - e1) * (n_1 - e1) / e1 ELSE 0.0 END) AS chi2,
              first(N) AS N, first(C1) AS C1, first(r) AS r
          FROM (SELECT ct.*, N, C1, r, (n_0 + n_1) * C0 / N AS e0, (n_0 + n_1) * C1 / N AS e1
                FROM ct JOIN (SELECT "column", sum(n_0 + n_1) AS N, sum(n_0) AS C0, sum(n_1) AS C1, count(*) AS r
                              FROM ct GROUP BY "column") t USING ("column"))
          GROUP BY "column")
        ORDER BY cramers_v DESC, "column" LIMIT 3""",
        {"ct": 'SELECT "column", value, count(CASE WHEN label = 0 THEN 1 END) AS n_0, '
               'count(CASE WHEN label = 1 THEN 1 END) AS n_1 FROM '
               + _long("clean", assoc_cols, "label", where_not_null=True) + ' GROUP BY "column", value'})

    out["numeric_association"] = with_base(
        "SELECT feature, abs_corr FROM (" + union_all([
            f"SELECT {q(c)} AS feature, {r6(f'coalesce(abs(corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE))), 0.0)')} AS abs_corr FROM clean"
            for c in num]) + ") ORDER BY abs_corr DESC, feature LIMIT 3")

    clean_all = ["id"] + cat + num + ["label"]
    out["dataset_summary"] = with_base(union_all(
        ["SELECT 'records' AS section, 'total' AS key, CAST(count(*) AS DOUBLE) AS value FROM clean",
         "SELECT 'label_share' AS section, CAST(label AS VARCHAR) AS key, "
         + r6("count(*) / (SELECT count(*) FROM clean)") + " AS value FROM clean GROUP BY label"]
        + [f"SELECT 'missing' AS section, {q(c)} AS key, CAST(count(*) - count({c}) AS DOUBLE) AS value FROM clean"
           for c in clean_all]
        + ["SELECT 'label_corr' AS section, feature AS key, corr AS value FROM ("
           + union_all([f"SELECT {q(c)} AS feature, {r6(f'corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE))')} AS corr FROM clean"
                        for c in num]) + ")"]))
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(sql_sources())
    out.update(sql_profile())
    out.update(sql_features())
    out.update(sql_evaluate())
    out.update(sql_resample())
    out.update(sql_lineitem())
    out.update(sql_other())
    out.update(sql_checks())
    return out


# --------------------------------------------------------------------- split / features
SPLIT_CTES = {
    "sp_cnt": "SELECT label, count(*) AS n_c FROM typed GROUP BY label",
    "sp_tot": "SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_train FROM sp_cnt",
    "sp_fl": "SELECT label, n_c, n_train * n_c / n AS cont, floor(n_train * n_c / n) AS fl FROM sp_cnt, sp_tot",
    "sp_q": """SELECT label, n_c - fl - CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, label)
                 <= (SELECT max(n_train) FROM sp_tot) - (SELECT sum(fl) FROM sp_fl) THEN 1 ELSE 0 END AS test_quota
               FROM sp_fl""",
    "sp_rank": """SELECT c.*, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 AS rnk
                  FROM typed c""",
    "sp_typed": """SELECT r.*, CASE WHEN rnk < test_quota THEN 'test' ELSE 'train' END AS split
                FROM sp_rank r JOIN sp_q USING (label)""",
    "tr_med": "SELECT quantile_cont(total_charges, 0.5) AS med FROM sp_typed WHERE split = 'train'",
    "split": "SELECT * REPLACE (coalesce(total_charges, (SELECT med FROM tr_med)) AS total_charges) FROM sp_typed",
}
#: The training vocabulary, as (source, category).
VOCABULARY = "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS source, {c} AS category FROM split WHERE split = 'train' AND {c} IS NOT NULL" for c in CATEGORICAL)
UNKNOWN = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN (SELECT category FROM voc WHERE source = '{c}') THEN '{c}=' || {c} END"
    for c in CATEGORICAL) + ")"
CHECKED = f"SELECT *, {UNKNOWN} AS unknown FROM ({RECORD_CHECK})"
REJECTS = ("SELECT id, CASE WHEN missing_fields <> '' THEN 'missing:' || missing_fields WHEN bad_numeric <> '' "
           "THEN 'not_numeric:' || bad_numeric ELSE 'unknown_category:' || unknown END AS reason FROM checked "
           "WHERE missing_fields <> '' OR bad_numeric <> '' OR unknown <> ''")
DOMAINS = {
    "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "urgent_user": ["No", "Yes"],
}


def _safe(v: str) -> str:
    import re
    return re.sub(r"[^0-9A-Za-z]+", "_", v).strip("_")


def onehot_cols(drop_first: bool = True) -> list[tuple[str, str, str]]:
    out = []
    for c in CATEGORICAL:
        vals = DOMAINS[c][1:] if drop_first else DOMAINS[c]
        out += [(f"{c}_{_safe(v)}", c, v) for v in vals]
    return out


def _onehot_select(drop_first: bool = True) -> str:
    return ", ".join(f"CAST(CASE WHEN {c} = {q(v)} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {n}"
                     for n, c, v in onehot_cols(drop_first))


def sql_features() -> dict[str, str]:
    num = NUMERIC_CLEAN
    oh = onehot_cols(True)
    out: dict[str, str] = {}
    out["stratified_split"] = with_base("SELECT id, label, split FROM split", SPLIT_CTES)
    out["random_split"] = with_base(
        "SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 "
        "< ceil(0.2 * (SELECT count(*) FROM typed)) THEN 'test' ELSE 'train' END AS split FROM typed")
    rejects = {**SPLIT_CTES, "voc": VOCABULARY, "checked": CHECKED}
    out["reject_records"] = with_base(REJECTS, rejects)
    out["reject_stream"] = with_base(REJECTS, rejects)
    out["check_scoring"] = with_base(
        "SELECT id, 1 AS sums_to_one, 1 AS stream_agrees, 1 AS label_agrees FROM checked "
        "WHERE missing_fields = '' AND bad_numeric = '' AND unknown = ''", rejects)
    out["kfold_assign"] = with_base(
        "SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold "
        "FROM split WHERE split = 'train'", SPLIT_CTES)
    out["split_distribution"] = with_base(
        """SELECT label, CAST(count(CASE WHEN split = 'train' THEN 1 END) AS BIGINT) AS n_train,
                  CAST(count(CASE WHEN split = 'test' THEN 1 END) AS BIGINT) AS n_test, """
        + r6("count(CASE WHEN split = 'train' THEN 1 END) / (SELECT count(*) FROM split WHERE split = 'train')") + " AS share_train, "
        + r6("count(CASE WHEN split = 'test' THEN 1 END) / (SELECT count(*) FROM split WHERE split = 'test')") + " AS share_test "
        "FROM split GROUP BY label", SPLIT_CTES)
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in num)
    out["standard_scale"] = with_base(
        "SELECT id, split, " + ", ".join(
            r6(f"(CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END)") + f" AS {c}"
            for c in num) + " FROM split, st",
        {**SPLIT_CTES, "st": f"SELECT {stats} FROM split WHERE split = 'train'"})
    allf = num + [n for n, _, _ in oh]
    mm = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in allf)
    out["minmax_scale"] = with_base(
        "SELECT id, split, " + ", ".join(
            r6(f"({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END)") + f" AS {c}"
            for c in allf) + " FROM enc, mm",
        {**SPLIT_CTES,
         "enc": "SELECT id, split, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in num) + ", " + _onehot_select(True) + " FROM split",
         "mm": f"SELECT {mm} FROM enc WHERE split = 'train'"})
    out["onehot"] = with_base("SELECT id, " + _onehot_select(True) + " FROM split", SPLIT_CTES)
    n_num = len(num)
    numeric_rows = union_all([
        f"SELECT CAST({i} AS INTEGER) AS idx, {q(c)} AS feature, 'numeric' AS role, {q(c)} AS source, CAST(NULL AS VARCHAR) AS category"
        for i, c in enumerate(num)])
    cat_order = " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(CATEGORICAL))
    vocab = VOCABULARY
    one_left_out = union_all([f"SELECT DISTINCT {q(c)} AS source, {c} AS category FROM split WHERE split = 'train' "
                              f"AND region <> 'EUROPE' AND {c} IS NOT NULL" for c in CATEGORICAL])
    out["feature_names"] = with_base(
        numeric_rows + "\nUNION ALL\n"
        f"SELECT CAST({n_num} + row_number() OVER (ORDER BY CASE source {cat_order} END, category) - 1 AS INTEGER) AS idx, "
        "source || '_' || trim(regexp_replace(category, '[^0-9A-Za-z]+', '_', 'g'), '_') AS feature, 'onehot' AS role, source, category "
        "FROM (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY category) AS k FROM voc) WHERE k > 1",
        {**SPLIT_CTES, "voc": vocab})
    out["unknown_categories"] = with_base(
        'SELECT r.id, r."column", r.value FROM ' + _long_id("cc", CATEGORICAL) + " r "
        'WHERE r.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM voc v WHERE v.source = r."column" AND v.category = r.value)',
        {**SPLIT_CTES, "voc": one_left_out})
    out["align_features"] = with_base(
        "SELECT id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in num) + ", " + _onehot_select(True)
        + " FROM split WHERE split = 'test'", SPLIT_CTES)
    std_exprs = [(c, f"(CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END)")
                 for c in num] + [(n, f"CASE WHEN {c} = {q(v)} THEN 1.0 ELSE 0.0 END") for n, c, v in oh]
    out["feature_matrix"] = with_base(union_all(
        [f"SELECT id, {q(n)} AS feature, {r6(e)} AS value FROM split, st" for n, e in std_exprs]),
        {**SPLIT_CTES, "st": f"SELECT {stats} FROM split WHERE split = 'train'"})
    st2 = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in ["tenure", "acctbal"])
    out["align_join"] = with_base(
        "SELECT s.id, s.split, c.churn, c.segment, "
        + ", ".join(r6(f"(CAST(s.{c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END)") + f" AS {c}"
                    for c in ["tenure", "acctbal"])
        + " FROM split s JOIN cc c ON s.id = c.id, st",
        {**SPLIT_CTES, "st": f"SELECT {st2} FROM split WHERE split = 'train'"})
    clean_cols = ["id"] + CATEGORICAL + num + ["label"]
    out["parse_kv_report"] = with_base(union_all(
        ["SELECT 'total_records' AS key, CAST(count(*) AS VARCHAR) AS value FROM clean",
         "SELECT 'churned' AS key, CAST(sum(label) AS VARCHAR) AS value FROM clean",
         "SELECT 'retained' AS key, CAST(count(*) - sum(label) AS VARCHAR) AS value FROM clean"]
        + [f"SELECT 'missing_{c}' AS key, CAST(count(*) - count({c}) AS VARCHAR) AS value FROM clean" for c in clean_cols]))
    return out


def _long_id(table: str, cols: list[str]) -> str:
    return "(" + union_all([f'SELECT id, {q(c)} AS "column", CAST({c} AS VARCHAR) AS value FROM {table}' for c in cols]) + ")"


# --------------------------------------------------------------------- evaluation
RULES = {
    "rule_tenure": "365.0 / (tenure + 365.0)",
    "rule_orders": "5.0 / (n_orders + 5.0)",
    "rule_blend": "0.5 * (365.0 / (tenure + 365.0)) + 0.3 * (5.0 / (n_orders + 5.0)) + 0.2 * in_debt",
}


def _scores_cte() -> dict[str, str]:
    parts = union_all([
        f"SELECT id, label, split, {q(k)} AS model, {i} AS model_order, CAST({v} AS DOUBLE) AS score FROM split"
        for i, (k, v) in enumerate(RULES.items())])
    return {**SPLIT_CTES,
            "scores": f"SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM ({parts})",
            "cm": """SELECT model, split,
                       CAST(count(CASE WHEN label = 0 AND prediction = 0 THEN 1 END) AS DOUBLE) AS tn,
                       CAST(count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS DOUBLE) AS fp,
                       CAST(count(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS DOUBLE) AS fn,
                       CAST(count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS DOUBLE) AS tp
                     FROM scores GROUP BY model, split""",
            "auc": """SELECT model, model_order, sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
                        SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY s
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
                        FROM (SELECT model, model_order, score AS s, sum(label) AS pos, sum(1 - label) AS neg
                              FROM scores WHERE split = 'test' GROUP BY model, model_order, score))
                      GROUP BY model, model_order"""}


def _sd(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"


def sql_evaluate() -> dict[str, str]:
    out: dict[str, str] = {}
    ctes = _scores_cte()
    out["confusion_matrix"] = with_base(union_all([
        f"SELECT model, {a} AS actual, {p} AS predicted, count(CASE WHEN label = {a} AND prediction = {p} THEN 1 END) AS n "
        "FROM scores WHERE split = 'test' GROUP BY model" for a in (0, 1) for p in (0, 1)]), ctes)
    p1, r1 = _sd("tp", "tp + fp"), _sd("tp", "tp + fn")
    p0, r0 = _sd("tn", "tn + fn"), _sd("tn", "tn + fp")
    f1, f0 = _sd(f"2 * {p1} * {r1}", f"{p1} + {r1}"), _sd(f"2 * {p0} * {r0}", f"{p0} + {r0}")
    n = "(tn + fp + fn + tp)"
    acc = _sd("tn + tp", n)
    rows = [("'0'", p0, r0, f0, "tn + fp"), ("'1'", p1, r1, f1, "tp + fn"),
            ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("'weighted avg'", _sd(f"{p0} * (tn + fp) + {p1} * (tp + fn)", n), _sd(f"{r0} * (tn + fp) + {r1} * (tp + fn)", n),
             _sd(f"{f0} * (tn + fp) + {f1} * (tp + fn)", n), n),
            ("'accuracy'", acc, acc, acc, n), ("'specificity'", r0, r0, r0, "tn + fp")]
    out["classification_report"] = with_base(union_all([
        f"SELECT model, {c} AS class, {r6(p)} AS precision, {r6(r)} AS recall, {r6(f)} AS f1, CAST({s} AS BIGINT) AS support "
        "FROM cm WHERE split = 'test'" for c, p, r, f, s in rows]), ctes)
    out["roc_auc"] = with_base(f"SELECT model, {r6('auc')} AS auc FROM auc", ctes)
    out["train_test_gap"] = with_base(
        "SELECT model, " + r6("max(CASE WHEN split = 'train' THEN a END)") + " AS train_accuracy, "
        + r6("max(CASE WHEN split = 'test' THEN a END)") + " AS test_accuracy, "
        + r6("max(CASE WHEN split = 'train' THEN a END) - max(CASE WHEN split = 'test' THEN a END)") + " AS gap "
        "FROM (SELECT model, split, avg(CAST(label = prediction AS DOUBLE)) AS a FROM scores GROUP BY model, split) GROUP BY model",
        ctes)
    out["best_model"] = with_base(
        f"SELECT model, {r6('auc')} AS auc FROM auc ORDER BY auc DESC, model_order LIMIT 1", ctes)
    out["topk_features"] = with_base(
        f"SELECT id, label, {r6('score')} AS score FROM scores WHERE model = 'rule_blend' ORDER BY score DESC, id LIMIT 20", ctes)
    return out


# --------------------------------------------------------------------- kNN / SMOTE
def _u(expr: str, seed: str) -> str:
    return (f"(CAST(('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 13)) AS UBIGINT) / 4503599627370496.0)")


def _minmax_ctes() -> tuple[dict[str, str], list[str]]:
    oh = onehot_cols(True)
    allf = NUMERIC_CLEAN + [n for n, _, _ in oh]
    mm = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in allf)
    ctes = {**SPLIT_CTES,
            "enc": "SELECT id, label, split, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_CLEAN)
                   + ", " + _onehot_select(True) + " FROM split",
            "mm": f"SELECT {mm} FROM enc WHERE split = 'train'",
            "sc": "SELECT id, label, split, " + ", ".join(
                f"({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END) AS {c}" for c in allf)
                  + " FROM enc, mm",
            "tr": "SELECT * FROM sc WHERE split = 'train'",
            "cnt": "SELECT label, count(*) AS n FROM tr GROUP BY label",
            "minl": "SELECT label AS min_label, n AS n_min FROM cnt ORDER BY n, label LIMIT 1",
            "majl": "SELECT n AS n_maj FROM cnt ORDER BY n DESC, label LIMIT 1",
            "mins": "SELECT tr.*, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 AS midx "
                    "FROM tr WHERE label = (SELECT min_label FROM minl)"}
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in allf)
    ctes["knn"] = ("SELECT * FROM (SELECT a.id, b.id AS nn_id, " + d2 + " AS dist2, "
                   "row_number() OVER (PARTITION BY a.id ORDER BY " + d2 + ", md5('42:' || CAST(b.id AS VARCHAR)), b.id) AS nn_rank "
                   "FROM mins a JOIN mins b ON a.id <> b.id) WHERE nn_rank <= 5")
    return ctes, allf


def sql_resample() -> dict[str, str]:
    ctes, allf = _minmax_ctes()
    out: dict[str, str] = {}
    out["knn_embeddings"] = (
        "WITH v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), "
        "d AS (SELECT a.id, b.id AS nn_id, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.e, b.e)]) AS d2 "
        "FROM v a JOIN v b ON a.id <> b.id) "
        f"SELECT id, CAST(r AS INTEGER) AS nn_rank, nn_id, {r6('d2')} AS dist2 FROM (SELECT *, row_number() OVER (PARTITION BY id "
        "ORDER BY d2, md5('42:' || CAST(nn_id AS VARCHAR)), nn_id) AS r FROM d) WHERE r <= 5")
    out["knn_minority"] = with_base(
        f"SELECT id, CAST(nn_rank AS INTEGER) AS nn_rank, nn_id, {r6('dist2')} AS dist2 FROM knn", ctes)
    syn_ctes = dict(ctes)
    syn_ctes["syn"] = (
        "SELECT j, CAST(floor(" + _u("j", "42b") + " * (SELECT n_min FROM minl)) AS BIGINT) AS midx, "
        "CAST(floor(" + _u("j", "42n") + " * 5) + 1 AS BIGINT) AS nn_rank, "
        + _u("j", "42g") + " AS gap FROM (SELECT unnest(range(0, (SELECT n_maj FROM majl) - (SELECT n_min FROM minl))) AS j)")
    out["smote"] = with_base(
        "SELECT 'o:' || CAST(id AS VARCHAR) AS row_id, CAST(label AS INTEGER) AS label, 0 AS synthetic, "
        + ", ".join(f"{r6(c)} AS {c}" for c in allf) + " FROM tr\nUNION ALL\n"
        "SELECT 's:' || CAST(s.j AS VARCHAR) AS row_id, CAST((SELECT min_label FROM minl) AS INTEGER) AS label, 1 AS synthetic, "
        + ", ".join(r6(f"b.{c} + s.gap * (n.{c} - b.{c})") + f" AS {c}" for c in allf)
        + " FROM syn s JOIN mins b ON s.midx = b.midx JOIN knn k ON k.id = b.id AND k.nn_rank = s.nn_rank "
        "JOIN mins n ON n.id = k.nn_id", syn_ctes)
    return out


# --------------------------------------------------------------------- box plots / lineitem
def boxplot_sql(table: str, cols: list[str], label: str) -> str:
    longd = _long(table, cols, label, as_type="DOUBLE", where_not_null=True)
    return with_base(
        """SELECT b."column", b.overall, b.grp AS "group", CAST(b.n AS BIGINT) AS n, """
        + ", ".join(f"{r6('b.' + k)} AS {k}" for k in ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"])
        + ", " + r6("min(CASE WHEN g.value BETWEEN b.lower_fence AND b.upper_fence THEN g.value END)")
        + " AS whisker_low, " + r6("max(CASE WHEN g.value BETWEEN b.lower_fence AND b.upper_fence THEN g.value END)")
        + " AS whisker_high, CAST(count(CASE WHEN g.value < b.lower_fence OR g.value > b.upper_fence THEN 1 END) AS BIGINT)"
        + """ AS n_outliers
        FROM (SELECT "column", overall, grp, n, q1, median, q3, q3 - q1 AS iqr,
                     q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
              FROM (SELECT "column", overall, grp, count(*) AS n, quantile_cont(value, 0.25) AS q1,
                           quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
                    FROM grouped GROUP BY "column", overall, grp)) b
        JOIN grouped g ON g."column" = b."column" AND g.overall = b.overall AND g.grp IS NOT DISTINCT FROM b.grp
        GROUP BY b."column", b.overall, b.grp, b.n, b.q1, b.median, b.q3, b.iqr, b.lower_fence, b.upper_fence""",
        {"lng": f"SELECT * FROM {longd}",
         "grouped": "SELECT \"column\", value, 1 AS overall, CAST(NULL AS VARCHAR) AS grp FROM lng UNION ALL "
                    f"SELECT \"column\", value, 0 AS overall, CAST({label} AS VARCHAR) AS grp FROM lng WHERE {label} IS NOT NULL"})


LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def sql_lineitem() -> dict[str, str]:
    out: dict[str, str] = {}
    parts = []
    for c in LINEITEM_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f'SELECT {q(c)} AS "column", CAST(count({x}) AS BIGINT) AS count, {r6(f"avg({x})")} AS mean, '
            f'{r6(f"stddev_samp({x})")} AS std, {r6(f"min({x})")} AS min, '
            f'{r6(f"quantile_cont({x}, 0.25)")} AS q25, {r6(f"quantile_cont({x}, 0.5)")} AS q50, '
            f'{r6(f"quantile_cont({x}, 0.75)")} AS q75, {r6(f"max({x})")} AS max FROM lineitem')
    out["describe_lineitem"] = union_all(parts)
    pairs = [(a, b) for i, a in enumerate(LINEITEM_NUM) for b in LINEITEM_NUM[i + 1:]]
    out["corr_lineitem"] = union_all([
        f"SELECT {q(a)} AS col_a, {q(b)} AS col_b, {r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM lineitem"
        for a, b in pairs])
    out["boxplot_lineitem"] = boxplot_sql("lineitem", LINEITEM_NUM, "l_returnflag")
    out["value_counts_orders"] = ("SELECT o_orderpriority AS value, count(*) AS count, "
                                  + r6("count(*) / (SELECT count(*) FROM orders)") + " AS share FROM orders GROUP BY o_orderpriority")
    return out


def sql_other() -> dict[str, str]:
    out: dict[str, str] = {}
    docs = {"ld": "SELECT l.doc_id, l.quality AS label, d.lang, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id"}
    out["docs_quality_rate"] = with_base(
        'SELECT "column", value, count(*) AS n, ' + r6("avg(CAST(label AS DOUBLE)) * 100")
        + ' AS churn_rate FROM ' + _long("ld", ["lang", "source"], "label", where_not_null=True)
        + ' WHERE label IS NOT NULL GROUP BY "column", value', docs)
    out["docs_association"] = with_base(
        """SELECT "column", """ + r6("C1 / N") + " AS share, " + r6("chi2") + " AS chi2, "
        + r6("CASE WHEN least(r, 2) - 1 > 0 THEN sqrt(chi2 / (N * (least(r, 2) - 1))) ELSE 0.0 END")
        + """ AS cramers_v FROM (
          SELECT "column", sum(
              CASE WHEN e0 > 0 THEN (n_0 - e0) * (n_0 - e0) / e0 ELSE 0.0 END +
              CASE WHEN e1 > 0 THEN (n_1 - e1) * (n_1 - e1) / e1 ELSE 0.0 END) AS chi2,
              first(N) AS N, first(C1) AS C1, first(r) AS r
          FROM (SELECT ct.*, N, C1, r, (n_0 + n_1) * C0 / N AS e0, (n_0 + n_1) * C1 / N AS e1
                FROM ct JOIN (SELECT "column", sum(n_0 + n_1) AS N, sum(n_0) AS C0, sum(n_1) AS C1, count(*) AS r
                              FROM ct GROUP BY "column") t USING ("column"))
          GROUP BY "column")
        ORDER BY cramers_v DESC, "column" LIMIT 3""",
        {**docs, "ct": 'SELECT "column", value, count(CASE WHEN label = 0 THEN 1 END) AS n_0, '
                       'count(CASE WHEN label = 1 THEN 1 END) AS n_1 FROM '
                       + _long("ld", ["lang", "source"], "label", where_not_null=True) + ' GROUP BY "column", value'})
    out["histogram_events"] = (
        "SELECT bin, " + r6("lo + bin * w") + " AS bin_start, " + r6("lo + (bin + 1) * w") + """ AS bin_end,
               event_type, count(*) AS count FROM (
          SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((value - lo) / w), 9) END AS INTEGER) AS bin, event_type, lo, w
          FROM events, (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events) r
          WHERE value IS NOT NULL) GROUP BY bin, event_type, lo, w""")
    out["parse_event_records"] = (
        "SELECT event_id, k, CASE WHEN k IS NULL THEN 'k' ELSE '' END AS missing_fields, "
        "CAST(k IS NOT NULL AS INTEGER) AS is_valid FROM "
        "(SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)")
    return out


# --------------------------------------------------------------------- what must hold for model output
def sql_checks() -> dict[str, str]:
    out: dict[str, str] = {}
    names = union_all([f"SELECT {q(m)} AS model" for m in (
        "random_forest", "gbt", "logistic_regression", "gbt_categorical", "gbt_ordered")])
    out["check_scores"] = with_base(
        f"SELECT model, id, label, 1 AS probability_ok, 1 AS prediction_ok FROM split, ({names}) WHERE split = 'test'", SPLIT_CTES)
    out["check_linear"] = with_base("SELECT id, 1 AS same FROM split WHERE split = 'test'", SPLIT_CTES)
    features = union_all([f"SELECT {q(c)} AS feature" for c in NUMERIC_CLEAN] + [
        "SELECT source || '_' || trim(regexp_replace(category, '[^0-9A-Za-z]+', '_', 'g'), '_') AS feature "
        "FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY category) AS k FROM voc) WHERE k > 1"])
    voc = {**SPLIT_CTES, "voc": VOCABULARY, "features": features}
    out["check_importance"] = with_base("SELECT feature, 1 AS not_negative, CAST(1.0 AS DOUBLE) AS total FROM features", voc)
    out["check_permutation"] = with_base("SELECT feature, 1 AS is_the_fall FROM features", voc)
    out["check_shapley"] = with_base(
        "SELECT id, (SELECT count(*) FROM features) AS n_features, 1 AS adds_up FROM split WHERE split = 'test'", voc)
    fold = ("CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % {k} AS INTEGER)")
    out["check_search"] = with_base(
        "SELECT p.learner, CAST(p.point AS INTEGER) AS point, p.params, fold, count(*) AS n, 1 AS best_is_top, CAST(1 AS BIGINT) AS n_best "
        f"FROM (SELECT {fold.format(k=3)} AS fold FROM split WHERE split = 'train') f, (VALUES "
        "('logistic_regression', 0, 'regParam=0.0'), ('logistic_regression', 1, 'regParam=0.01'), "
        "('gbt', 0, 'maxDepth=3,maxIter=100'), ('gbt', 1, 'maxDepth=5,maxIter=100')) p(learner, point, params) "
        "GROUP BY p.learner, p.point, p.params, fold", SPLIT_CTES)
    out["check_run_summary"] = (
        "SELECT 'compared' AS stage, CAST(3 AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_best, 1 AS chosen_right, 1 AS sound "
        "UNION ALL SELECT 'tuned', CAST(1 AS BIGINT), CAST(1 AS BIGINT), 1, 1")
    compared = union_all([f"SELECT {q(m)} AS model" for m in ("random_forest", "gbt", "logistic_regression")])
    out["check_comparison"] = with_base(
        "SELECT model, part, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, 1 AS sound FROM ("
        "SELECT 'test' AS part, label FROM split WHERE split = 'test' UNION ALL "
        f"SELECT 'valid', label FROM (SELECT label, {fold.format(k=5)} AS fold FROM split WHERE split = 'train') WHERE fold = 0 UNION ALL "
        f"SELECT 'fold' || CAST({fold.format(k=3)} AS VARCHAR), label FROM split WHERE split = 'train') p, ({compared}) "
        "GROUP BY model, part", SPLIT_CTES)
    out["check_early_stopping"] = "SELECT 1 AS cut_at_best, 1 AS best_is_smallest, 1 AS stopped_by_patience"
    # categoricals as smoothed means: of earlier training rows in hash order, or of all training rows
    earlier = "(PARTITION BY {c} ORDER BY md5('42:' || CAST(id AS VARCHAR)), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    own = ", ".join(r6(f"(coalesce(sum(label) OVER {earlier.format(c=c)}, 0) + 0.5) / (count(label) OVER {earlier.format(c=c)} + 1.0)")
                    + f" AS {c}_stat" for c in CATEGORICAL)
    rest = ", ".join(r6(f"(coalesce((SELECT sum(label) FROM split t WHERE t.split = 'train' AND t.{c} IS NOT DISTINCT FROM s.{c}), 0) + 0.5) / "
                        f"((SELECT count(label) FROM split t WHERE t.split = 'train' AND t.{c} IS NOT DISTINCT FROM s.{c}) + 1.0)")
                     + f" AS {c}_stat" for c in CATEGORICAL)
    out["ordered_target_stats"] = with_base(
        f"SELECT id, split, {own} FROM split WHERE split = 'train' UNION ALL SELECT id, split, {rest} FROM split s WHERE split = 'test'", SPLIT_CTES)
    out["check_knn_lsh"] = ("SELECT count(*) AS queries, CAST(5 * count(*) AS BIGINT) AS neighbours, 1 AS recall_reached "
                            "FROM embeddings WHERE vec_id % 100 = 0")
    out["corr_embeddings"] = (
        "WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
        "SELECT CAST(a.i AS INTEGER) AS dim_a, CAST(b.i AS INTEGER) AS dim_b, " + r6("corr(a.x, b.x)") + " AS corr "
        "FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i")
    number = ("SELECT {c} AS v, row_number() OVER (ORDER BY md5('42:' || CAST({c} AS VARCHAR)), CAST({c} AS VARCHAR)) - 1 AS idx "
              "FROM (SELECT DISTINCT {c} FROM orders WHERE o_orderkey % 2 = 0 AND {c} IS NOT NULL)")
    out["onehot_wide"] = (
        "WITH a AS (" + number.format(c="o_custkey") + "), b AS (" + number.format(c="o_orderpriority") + ") "
        "SELECT o_orderkey, a.idx AS o_custkey_idx, b.idx AS o_orderpriority_idx, "
        "CAST((a.idx IS NOT NULL)::INT + (b.idx IS NOT NULL)::INT AS BIGINT) AS ones, "
        "CAST((SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS BIGINT) AS width "
        "FROM orders LEFT JOIN a ON o_custkey = a.v LEFT JOIN b ON o_orderpriority = b.v")
    out["class_balance"] = with_base(
        "SELECT label, CAST(n AS BIGINT) AS n_before, CAST(CASE WHEN n_min > 5 AND n = n_min THEN n_max ELSE n END AS BIGINT) AS n_after, "
        + r6("n / total") + " AS share_before, "
        + r6("CASE WHEN n_min > 5 AND n = n_min THEN n_max ELSE n END / CASE WHEN n_min > 5 THEN total + n_max - n_min ELSE total END")
        + " AS share_after FROM (SELECT label, count(*) AS n, min(count(*)) OVER () AS n_min, max(count(*)) OVER () AS n_max, "
        "sum(count(*)) OVER () AS total FROM split WHERE split = 'train' GROUP BY label)", SPLIT_CTES)
    docs = """WITH d AS (SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id),
        cnt AS (SELECT quality, count(*) AS n_c FROM d GROUP BY quality),
        tot AS (SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_train FROM cnt),
        fl AS (SELECT quality, n_c, n_train * n_c / n AS cont, floor(n_train * n_c / n) AS fl FROM cnt, tot),
        quota AS (SELECT quality, n_c - fl - CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, quality NULLS LAST)
                 <= (SELECT max(n_train) FROM tot) - (SELECT sum(fl) FROM fl) THEN 1 ELSE 0 END AS test_quota FROM fl),
        ranked AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
                   ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rnk FROM d)
    """
    out["docs_split"] = docs + ("SELECT doc_id, r.quality, CASE WHEN rnk < test_quota THEN 'test' ELSE 'train' END AS split "
                                "FROM ranked r JOIN quota t ON r.quality IS NOT DISTINCT FROM t.quality")
    out["docs_folds"] = docs + "SELECT doc_id, quality, CAST(rnk % 5 AS INTEGER) AS fold FROM ranked"
    return out
