"""Plain-SQL oracles (DuckDB dialect) for the registered queries.

They compute every answer the direct way: full contingency tables counted from all cells
(zeros included), MI = sum n/N log2(n N / (na nb)) with window sums, and one CTE per
selection iteration.  Nothing here shares code or formulas with the Spark side.
"""

from __future__ import annotations

LI_FEATURES = ["linenumber", "quantity", "discount", "tax", "status", "ship_year", "ship_month"]

LI = """li AS (
  SELECT row_number() OVER () AS inst, l_returnflag AS label,
         CAST(l_linenumber AS INTEGER) AS linenumber,
         CAST(floor(l_quantity) AS INTEGER) AS quantity,
         CAST(round(l_discount * 100) AS INTEGER) AS discount,
         CAST(round(l_tax * 100) AS INTEGER) AS tax,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS status,
         CAST(year(l_shipdate) AS INTEGER) AS ship_year,
         CAST(month(l_shipdate) AS INTEGER) AS ship_month
  FROM lineitem)"""


def _li_long(extra: str = "") -> str:
    parts = [f"SELECT inst, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS v{extra} FROM li" for f in LI_FEATURES]
    return "li_long AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


EMB = """bits AS (
  SELECT vec_id, label,
         list_transform(embedding, lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS DOUBLE)) AS bits
  FROM embeddings),
emb_long AS (
  SELECT vec_id AS inst, label, generate_subscripts(bits, 1) - 1 AS feature, unnest(bits) AS v FROM bits)"""

DOCS = """docs AS (
  SELECT d.doc_id, l.quality, list_distinct(string_split(lower(d.text), ' ')) AS toks
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tok AS (SELECT DISTINCT doc_id AS inst, quality, unnest(toks) AS feature FROM docs),
ndocs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs),
nb AS (SELECT quality AS b, CAST(count(*) AS DOUBLE) AS nb FROM docs GROUP BY quality),
dfreq AS (SELECT feature, CAST(count(*) AS DOUBLE) AS df FROM tok GROUP BY feature)"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# ------------------------------------------------------------------------------ statistics
def stat_mi(src: str) -> str:
    """(feature, other, val): MI of every (feature, other) table of aligned rows ``src``."""
    return f"""SELECT feature, other, sum(n / nt * log2(n * nt / (na * nb))) AS val FROM (
    SELECT feature, other, a, b, n,
           sum(n) OVER (PARTITION BY feature, other, a) AS na,
           sum(n) OVER (PARTITION BY feature, other, b) AS nb,
           sum(n) OVER (PARTITION BY feature, other) AS nt
    FROM (SELECT feature, other, a, b, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY feature, other, a, b))
  GROUP BY feature, other"""


def stat_su(src: str) -> str:
    """(feature, other, val): symmetric uncertainty 2 MI / (H(a) + H(b))."""
    return f"""SELECT feature, other,
         CASE WHEN hf + ho > 0 THEN 2 * mi / (hf + ho) ELSE 0 END AS val FROM (
    SELECT feature, other, sum(n / nt * log2(n * nt / (na * nb))) AS mi,
           -sum(n / nt * log2(na / nt)) AS hf, -sum(n / nt * log2(nb / nt)) AS ho FROM (
      SELECT feature, other, a, b, n,
             sum(n) OVER (PARTITION BY feature, other, a) AS na,
             sum(n) OVER (PARTITION BY feature, other, b) AS nb,
             sum(n) OVER (PARTITION BY feature, other) AS nt
      FROM (SELECT feature, other, a, b, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY feature, other, a, b))
    GROUP BY feature, other)"""


def stat_abs_corr(src: str) -> str:
    return f"SELECT feature, other, abs(corr(a, b)) AS val FROM {src} GROUP BY feature, other"


# ------------------------------------------------------------------------------ scores
def score_mrmr(rel: str, red: str, nsel: int) -> str:
    coef = 1.0 if nsel <= 1 else 1.0 / nsel
    return f"{rel} - {coef!r} * {red}"


def score_miq(rel: str, red: str, nsel: int) -> str:
    if nsel == 0:
        return rel
    return f"CASE WHEN {red} / {float(nsel)!r} > 0 THEN {rel} / ({red} / {float(nsel)!r}) ELSE CAST('inf' AS DOUBLE) END"


def score_rel(rel: str, red: str, nsel: int) -> str:
    return rel


# ------------------------------------------------------------------------------ generator
def iterative(prelude: str, rel_src: str, pair_src, stat, score, k: int, per_iter: int = 1,
              feature_sql: str = "CAST(feature AS BIGINT)", max_iter: int | None = None) -> str:
    """SQL of an iterative selection.

    ``rel_src``: aligned rows ``(feature, other, a, b)`` of every candidate with the class.
    ``pair_src(winners_cte)``: aligned rows of every candidate with each winner of a CTE.
    """
    ctes = [prelude, f"relsrc AS ({rel_src})", f"rel AS ({stat('relsrc')})"]
    n_iter = max_iter if max_iter is not None else -(-k // per_iter)
    selected, outs = 0, []
    for i in range(1, n_iter + 1):
        m = min(per_iter, k - selected)
        if m <= 0:
            break
        excl = f"WHERE rel.feature NOT IN (SELECT feature FROM sel{i - 1})" if i > 1 else ""
        if i > 1:
            ctes.append(f"red{i} AS (SELECT feature, sum(val) AS red FROM ("
                        + " UNION ALL ".join(f"SELECT feature, val FROM p{j}" for j in range(1, i))
                        + ") GROUP BY feature)")
            ctes.append(f"s{i} AS (SELECT rel.feature, {score('rel.val', 'coalesce(red' + str(i) + '.red, 0)', selected)} "
                        f"AS score FROM rel LEFT JOIN red{i} ON rel.feature = red{i}.feature {excl})")
        else:
            ctes.append(f"s{i} AS (SELECT rel.feature, {score('rel.val', '0.0', 0)} AS score FROM rel)")
        ctes.append(f"w{i} AS (SELECT feature, score, {selected} + row_number() OVER "
                    f"(ORDER BY round(score, 12) DESC NULLS LAST, feature) AS rnk FROM s{i} "
                    f"QUALIFY row_number() OVER (ORDER BY round(score, 12) DESC NULLS LAST, feature) <= {m})")
        prev = f"SELECT feature FROM sel{i - 1} UNION ALL " if i > 1 else ""
        ctes.append(f"sel{i} AS ({prev}SELECT feature FROM w{i})")
        selected += m
        outs.append(f"SELECT rnk, feature, score FROM w{i}")
        if i < n_iter and selected < k:
            ctes.append(f"psrc{i} AS ({pair_src(f'w{i}', f'sel{i}')})")
            ctes.append(f"p{i} AS ({stat(f'psrc{i}')})")
    body = "WITH " + ",\n".join(ctes)
    return (body + "\nSELECT CAST(rnk AS INTEGER) AS rank, " + feature_sql + " AS feature, "
            + r6("score") + " AS score FROM (" + " UNION ALL ".join(outs) + ")")


# dense instance tables: x(inst, feature, v) full, class per inst
def _dense_sources(long: str):
    rel = f"SELECT feature, 0 AS other, v AS a, label AS b FROM {long}"

    def pairs(w, sel):
        return (f"SELECT x.feature, z.feature AS other, x.v AS a, z.v AS b FROM {long} x "
                f"JOIN {long} z ON x.inst = z.inst "
                f"WHERE z.feature IN (SELECT feature FROM {w}) AND x.feature NOT IN (SELECT feature FROM {sel})")
    return rel, pairs


def emb_selection(k: int, stat=stat_mi, score=score_mrmr, per_iter: int = 1, max_iter=None) -> str:
    rel, pairs = _dense_sources("emb_long")
    return iterative(EMB, rel, pairs, stat, score, k, per_iter, max_iter=max_iter)


def li_selection(k: int, score=score_mrmr, per_iter: int = 1, max_iter=None) -> str:
    rel, pairs = _dense_sources("li_long")
    return iterative(LI + ",\n" + _li_long(), rel, pairs, stat_mi, score, k, per_iter,
                     feature_sql="CAST(feature AS VARCHAR)", max_iter=max_iter)


def token_selection(k: int, label: str = "quality") -> str:
    """Sparse presence data: the four cells of each 2 x |class| table are counted directly."""
    prelude = DOCS + """,
tc AS (SELECT feature, quality AS b, CAST(count(*) AS DOUBLE) AS n1b FROM tok GROUP BY feature, quality),
relcells AS (
  SELECT f.feature, nb.b, coalesce(tc.n1b, 0) AS n, f.df AS na, nb.nb FROM dfreq f CROSS JOIN nb
    LEFT JOIN tc ON tc.feature = f.feature AND tc.b = nb.b
  UNION ALL
  SELECT f.feature, nb.b, nb.nb - coalesce(tc.n1b, 0), (SELECT n FROM ndocs) - f.df, nb.nb FROM dfreq f CROSS JOIN nb
    LEFT JOIN tc ON tc.feature = f.feature AND tc.b = nb.b)"""
    N = "(SELECT n FROM ndocs)"

    def stat(src):
        return f"SELECT feature, other, val FROM {src}"  # sources already hold (feature, other, val)

    rel = (f"SELECT feature, 0 AS other, sum(CASE WHEN n > 0 THEN n / {N} * log2(n * {N} / (na * nb)) ELSE 0 END) AS val "
           f"FROM relcells GROUP BY feature")

    def pairs(w, sel):
        return f"""SELECT feature, other, sum(CASE WHEN n > 0 THEN n / {N} * log2(n * {N} / (na * nb)) ELSE 0 END) AS val FROM (
      SELECT c.feature, c.other, v.n, v.na, v.nb FROM (
        SELECT f.feature, wf.feature AS other, f.df AS dft, wf.df AS dfw, coalesce(j.n11, 0) AS n11
        FROM dfreq f CROSS JOIN (SELECT d.feature, d.df FROM dfreq d WHERE d.feature IN (SELECT feature FROM {w})) wf
        LEFT JOIN (SELECT x.feature, z.feature AS other, CAST(count(*) AS DOUBLE) AS n11 FROM tok x
                   JOIN tok z ON x.inst = z.inst WHERE z.feature IN (SELECT feature FROM {w}) GROUP BY x.feature, z.feature) j
          ON j.feature = f.feature AND j.other = wf.feature
        WHERE f.feature NOT IN (SELECT feature FROM {sel})) c,
      LATERAL (VALUES (c.n11, c.dft, c.dfw),
                      (c.dft - c.n11, c.dft, {N} - c.dfw),
                      (c.dfw - c.n11, {N} - c.dft, c.dfw),
                      ({N} - c.dft - c.dfw + c.n11, {N} - c.dft, {N} - c.dfw)) v(n, na, nb))
    GROUP BY feature, other"""
    if label != "quality":
        prelude = prelude.replace("l.quality", f"l.{label} AS quality")
    return iterative(prelude, rel, pairs, stat, score_mrmr, k, feature_sql="CAST(feature AS VARCHAR)")


def _mi_table(src: str) -> str:
    return stat_mi(src)


ORACLE: dict[str, str] = {}

ORACLE["class_histogram"] = "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag"

ORACLE["feature_levels"] = f"""WITH {LI},
{_li_long()}
SELECT feature, CAST(count(DISTINCT v) AS BIGINT) AS n_levels, CAST(count(*) AS BIGINT) AS nnz
FROM li_long WHERE v <> 0 GROUP BY feature"""

ORACLE["dataset_profile"] = f"""WITH {EMB}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(len(bits)) AS INTEGER) AS n_cols,
       CAST(sum(len(list_filter(bits, lambda x: x <> 0)) + 1) AS BIGINT) AS n_points FROM bits"""

ORACLE["to_cells"] = f"""WITH {EMB}
SELECT inst AS vec_id, CAST(feature AS BIGINT) AS feature, v AS value FROM emb_long WHERE v <> 0"""

ORACLE["contingency_class"] = f"""WITH {LI},
{_li_long()}
SELECT feature, v AS a, label AS b, CAST(count(*) AS BIGINT) AS n FROM li_long WHERE v <> 0
GROUP BY feature, v, label"""

ORACLE["contingency_feature"] = f"""WITH {LI},
{_li_long(", CAST(ship_month AS DOUBLE) AS w")}
SELECT feature, v AS a, w AS b, CAST(count(*) AS BIGINT) AS n FROM li_long
WHERE v <> 0 AND feature <> 'ship_month' GROUP BY feature, v, w"""

ORACLE["marginals"] = f"""WITH {LI},
{_li_long()}
SELECT feature, v AS level, CAST(count(*) AS BIGINT) AS n FROM li_long GROUP BY feature, v"""

ORACLE["zero_recovery"] = f"""WITH {DOCS},
t1 AS (SELECT feature, quality AS b, count(*) AS n FROM tok GROUP BY feature, quality)
SELECT feature, CAST(1 AS DOUBLE) AS a, CAST(b AS INTEGER) AS b, CAST(n AS BIGINT) AS n FROM t1
UNION ALL
SELECT f.feature, CAST(0 AS DOUBLE), CAST(nb.b AS INTEGER), CAST(nb.nb - coalesce(t1.n, 0) AS BIGINT)
FROM dfreq f CROSS JOIN nb LEFT JOIN t1 ON t1.feature = f.feature AND t1.b = nb.b
WHERE nb.nb - coalesce(t1.n, 0) > 0"""

ORACLE["mutual_information"] = f"""WITH {LI},
{_li_long()},
src AS (SELECT feature, 0 AS other, v AS a, label AS b FROM li_long),
m AS ({stat_mi('src')})
SELECT feature, {r6('val')} AS mi FROM m"""

ORACLE["redundancy"] = f"""WITH {EMB},
src AS (SELECT x.feature, z.feature AS other, x.v AS a, z.v AS b FROM emb_long x JOIN emb_long z
        ON x.inst = z.inst WHERE z.feature IN (0, 1, 2) AND x.feature NOT IN (0, 1, 2)),
m AS ({stat_mi('src')})
SELECT CAST(feature AS BIGINT) AS feature, {r6('sum(val)')} AS red FROM m GROUP BY feature"""

ORACLE["max_relevance_topk"] = emb_selection(10, score=score_rel, per_iter=10, max_iter=1)
ORACLE["max_relevance_lineitem"] = li_selection(5, score=score_rel, per_iter=5, max_iter=1)
ORACLE["mrmr_instance"] = emb_selection(5)
ORACLE["mrmr_feature"] = emb_selection(5)
ORACLE["mrmr_lineitem"] = li_selection(4)
ORACLE["mrmr_sparse"] = token_selection(5)
ORACLE["custom_score_expr"] = emb_selection(4, score=score_miq)
ORACLE["custom_score_table"] = emb_selection(4, stat=stat_su)
ORACLE["custom_score_vector"] = emb_selection(4, stat=stat_abs_corr)
ORACLE["batch_policy"] = emb_selection(4, per_iter=2)
ORACLE["mrmr_sparse_toxic"] = token_selection(3, label="toxic")
ORACLE["chi2_relevance"] = f"""WITH {EMB},
ct AS (SELECT feature, v AS a, label AS b, CAST(count(*) AS DOUBLE) AS n FROM emb_long GROUP BY feature, v, label),
fa AS (SELECT feature, a, sum(n) AS na FROM ct GROUP BY feature, a),
fb AS (SELECT feature, b, sum(n) AS nb FROM ct GROUP BY feature, b),
tot AS (SELECT feature, sum(n) AS nt FROM ct GROUP BY feature),
grid AS (SELECT fa.feature, fa.a, fb.b, fa.na, fb.nb, tot.nt, coalesce(ct.n, 0) AS o
         FROM fa JOIN fb ON fa.feature = fb.feature JOIN tot ON tot.feature = fa.feature
         LEFT JOIN ct ON ct.feature = fa.feature AND ct.a = fa.a AND ct.b = fb.b),
chi AS (SELECT feature, sum((o - na * nb / nt) * (o - na * nb / nt) / (na * nb / nt)) AS chi2 FROM grid GROUP BY feature)
SELECT CAST(row_number() OVER (ORDER BY round(chi2, 12) DESC, feature) AS INTEGER) AS rank,
       CAST(feature AS BIGINT) AS feature, {r6('chi2')} AS score
FROM chi QUALIFY row_number() OVER (ORDER BY round(chi2, 12) DESC, feature) <= 10"""

ORACLE["select_and_reduce"] = ("WITH sel AS (" + emb_selection(3) + f"""),
{EMB}
SELECT vec_id, label,
       list_extract(bits, (SELECT feature FROM sel WHERE rank = 1) + 1) AS sel_1,
       list_extract(bits, (SELECT feature FROM sel WHERE rank = 2) + 1) AS sel_2,
       list_extract(bits, (SELECT feature FROM sel WHERE rank = 3) + 1) AS sel_3
FROM bits""")

ORACLE["transpose"] = f"""WITH {EMB}
SELECT CAST(feature AS BIGINT) AS feature, inst AS pos, v AS value FROM emb_long"""

ORACLE["class_line"] = ("SELECT vec_id AS pos, CAST(vec_id AS VARCHAR) || ',' || CAST(label AS VARCHAR) AS line "
                        "FROM embeddings")

ORACLE["tree_label"] = f"""WITH {EMB},
ib AS (SELECT vec_id, list_transform(bits, lambda x: CAST(x AS INTEGER)) AS b FROM bits)
SELECT vec_id, ((b[1] & b[2]) | (b[3] & b[4])) & ((b[5] & b[6]) | (b[7] & b[8])) AS y FROM ib"""

ORACLE["selection_report"] = ("SELECT rank AS \"order\", CAST(feature AS VARCHAR) AS name, printf('%.3f', score) AS score FROM ("
                              + emb_selection(5).replace(r6("score") + " AS score", "score AS score") + ")")

ORACLE["csv_scan"] = ORACLE["max_relevance_topk"]
ORACLE["tsv_scan"] = emb_selection(3)
ORACLE["libsvm_scan"] = emb_selection(3)
ORACLE["feature_csv_scan"] = emb_selection(3)
ORACLE["class_vector_scan"] = "SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS pos, label FROM embeddings"
ORACLE["class_line_scan"] = ORACLE["class_vector_scan"]
ORACLE["feature_lines_scan"] = ORACLE["transpose"]

ORACLE["selection_job"] = ORACLE["selection_report"]

ORACLE["feature_libsvm_scan"] = emb_selection(5)
ORACLE["selection_job_feature_wise"] = f"""WITH rep AS ({ORACLE["selection_report"]}),
{EMB}
SELECT rep.*, (SELECT CAST(count(DISTINCT feature) AS BIGINT) FROM emb_long) AS n_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM embeddings) AS n_cols,
       (SELECT CAST(count(*) FILTER (WHERE v <> 0) + count(DISTINCT feature) AS BIGINT) FROM emb_long) AS n_points
FROM rep"""
ORACLE["estimator_reduce"] = ORACLE["select_and_reduce"]
ORACLE["mi_two_columns"] = f"""WITH {LI},
src AS (SELECT 0 AS feature, 0 AS other, ship_month AS a, quantity AS b FROM li),
m AS ({stat_mi('src')})
SELECT {r6('val')} AS mi FROM m"""

MIXED = """o AS (
  SELECT row_number() OVER () AS inst, o_orderstatus AS label, o_orderpriority, o_custkey % 17 AS cust_mod,
         year(o_orderdate) AS year, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS dear FROM orders),
o_all AS (""" + " UNION ALL ".join(
    f"SELECT inst, label, '{f}' AS feature, CAST({f} AS VARCHAR) AS v FROM o"
    for f in ("o_orderpriority", "cust_mod", "year", "dear")) + """),
o_long AS (SELECT * FROM o_all WHERE feature IN (SELECT feature FROM o_all GROUP BY feature HAVING count(*) FILTER (WHERE v <> '0') > 0))"""


def mixed_selection(k: int) -> str:
    rel, pairs = _dense_sources("o_long")
    return iterative(MIXED, rel, pairs, stat_mi, score_mrmr, k, feature_sql="CAST(feature AS VARCHAR)")


ORACLE["mrmr_mixed"] = mixed_selection(4)


def joint_selection(k: int) -> str:
    """Each iteration measures candidate, class and all selected vectors anew."""
    ctes, outs = [EMB], []
    for i in range(1, k + 1):
        extra = "".join(
            f" + coalesce(abs(corr(x.v * s{j}.v, x.label)), 0)" for j in range(1, i))
        joins = "".join(f" JOIN emb_long s{j} ON s{j}.inst = x.inst AND s{j}.feature = (SELECT feature FROM w{j})"
                        for j in range(1, i))
        gone = f" WHERE x.feature NOT IN ({' UNION ALL '.join(f'SELECT feature FROM w{j}' for j in range(1, i))})" if i > 1 else ""
        ctes.append(f"s_{i} AS (SELECT x.feature, abs(corr(x.v, x.label)) + (0.0{extra}) / {max(1, i - 1)}.0 AS score "
                    f"FROM emb_long x{joins}{gone} GROUP BY x.feature)")
        ctes.append(f"w{i} AS (SELECT feature, score FROM s_{i} ORDER BY round(score, 12) DESC NULLS LAST, feature LIMIT 1)")
        outs.append(f"SELECT {i} AS rnk, feature, score FROM w{i}")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT CAST(rnk AS INTEGER) AS rank, CAST(feature AS BIGINT) AS feature, "
            + r6("score") + " AS score FROM (" + " UNION ALL ".join(outs) + ")")


def max_redundancy_selection(k: int) -> str:
    rel, pairs = _dense_sources("emb_long")
    sql = iterative(EMB, rel, pairs, stat_mi, lambda r, d, n: f"{r} - {d}", k)
    return sql.replace("SELECT feature, sum(val) AS red FROM (", "SELECT feature, max(val) AS red FROM (")


ORACLE["custom_score_joint"] = joint_selection(4)
ORACLE["custom_score_max_redundancy"] = max_redundancy_selection(5)
ORACLE["row_sample"] = ("SELECT vec_id, label FROM embeddings "
                        "WHERE substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 13) < '8000000000000'")
ORACLE["row_sample_exact"] = ("SELECT vec_id, label FROM embeddings "
                              "QUALIFY row_number() OVER (ORDER BY md5('7:' || CAST(vec_id AS VARCHAR))) <= 200")
ORACLE["mrmr_lazy"] = ORACLE["mrmr_sparse"]
ORACLE["mrmr_bitmaps"] = ORACLE["mrmr_sparse"]
ORACLE["mrmr_stored"] = ORACLE["mrmr_feature"]
ORACLE["mi_aligned_vectors"] = f"""WITH src AS (
  SELECT 0 AS feature, 0 AS other, year(o_orderdate) AS a, o_orderpriority AS b FROM orders),
m AS ({stat_mi('src')})
SELECT {r6('val')} AS mi FROM m"""


def stat_spearman(src: str) -> str:
    """|corr| of mean ranks."""
    def rank(c):
        return (f"rank() OVER (PARTITION BY feature, other ORDER BY {c}) "
                f"+ (count(*) OVER (PARTITION BY feature, other, {c}) - 1) / 2.0")
    return f"""SELECT feature, other, abs(corr(ra, rb)) AS val FROM (
    SELECT feature, other, {rank('a')} AS ra, {rank('b')} AS rb FROM {src}) GROUP BY feature, other"""


def kendall(src: str) -> str:
    """(feature, other, tau): tau-b from all pairs of cells of each table."""
    return f"""SELECT feature, other, s / sqrt((pairs - ta) * (pairs - tb)) AS tau FROM (
    WITH c AS (SELECT feature, other, a, b, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY feature, other, a, b)
    SELECT * FROM (SELECT x.feature, x.other, sum(x.n * y.n * sign(y.b - x.b)) AS s FROM c x JOIN c y
                   ON x.feature = y.feature AND x.other = y.other AND x.a < y.a GROUP BY x.feature, x.other)
    JOIN (SELECT feature, other, sum(n) * (sum(n) - 1) / 2 AS pairs FROM c GROUP BY feature, other) USING (feature, other)
    JOIN (SELECT feature, other, sum(m * (m - 1) / 2) AS ta FROM (SELECT feature, other, sum(n) AS m FROM c GROUP BY feature, other, a)
          GROUP BY feature, other) USING (feature, other)
    JOIN (SELECT feature, other, sum(m * (m - 1) / 2) AS tb FROM (SELECT feature, other, sum(n) AS m FROM c GROUP BY feature, other, b)
          GROUP BY feature, other) USING (feature, other))"""


def stat_kendall(src: str) -> str:
    return f"SELECT feature, other, abs(tau) AS val FROM ({kendall(src)})"


def quantity_selection(k: int, stat) -> str:
    long = "q_long AS (SELECT x.inst, CAST(q.quantity AS DOUBLE) AS label, x.feature, x.v FROM li_long x JOIN li q ON q.inst = x.inst " \
           "WHERE x.feature <> 'quantity')"
    rel, pairs = _dense_sources("q_long")
    return iterative(LI + ",\n" + _li_long() + ",\n" + long, rel, pairs, stat, score_mrmr, k, feature_sql="CAST(feature AS VARCHAR)")


ORACLE["spearman_mrmr"] = quantity_selection(4, stat_spearman)
ORACLE["kendall_mrmr"] = quantity_selection(4, stat_kendall)
ORACLE["rank_correlations"] = f"""WITH e AS (
  SELECT generate_subscripts(embedding, 1) - 1 AS feature, 0 AS other, CAST(unnest(embedding) AS DOUBLE) AS a, CAST(label AS DOUBLE) AS b
  FROM embeddings),
r AS (SELECT feature, corr(ra, rb) AS rho FROM (
  SELECT feature, rank() OVER (PARTITION BY feature ORDER BY a) + (count(*) OVER (PARTITION BY feature, a) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY feature ORDER BY b) + (count(*) OVER (PARTITION BY feature, b) - 1) / 2.0 AS rb FROM e) GROUP BY feature),
k AS ({kendall('e')})
SELECT CAST(r.feature AS BIGINT) AS feature, {r6('r.rho')} AS spearman, {r6('k.tau')} AS kendall FROM r JOIN k ON k.feature = r.feature"""


def tables_selection(k: int) -> str:
    """Relevance less the sum over the candidate's levels of the largest redundancy any selected feature has there."""
    def level_info(src):
        return f"""SELECT feature, other, a, sum(n / nt * log2(n * nt / (na * nb))) AS i FROM (
      SELECT feature, other, a, b, n, sum(n) OVER (PARTITION BY feature, other, a) AS na,
             sum(n) OVER (PARTITION BY feature, other, b) AS nb, sum(n) OVER (PARTITION BY feature, other) AS nt
      FROM (SELECT feature, other, a, b, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY feature, other, a, b))
    GROUP BY feature, other, a"""
    rel, pairs = _dense_sources("emb_long")
    ctes = [EMB, f"relsrc AS ({rel})", f"rel AS (SELECT feature, sum(i) AS val FROM ({level_info('relsrc')}) GROUP BY feature)"]
    outs = []
    for i in range(1, k + 1):
        if i == 1:
            ctes.append("s1 AS (SELECT feature, val AS score FROM rel)")
        else:
            known = " UNION ALL ".join(f"SELECT feature, a, i FROM p{j}" for j in range(1, i))
            ctes.append(f"worst{i} AS (SELECT feature, sum(i) AS w FROM (SELECT feature, a, max(i) AS i FROM ({known}) GROUP BY feature, a) "
                        "GROUP BY feature)")
            ctes.append(f"s{i} AS (SELECT rel.feature, val - coalesce(w, 0) AS score FROM rel LEFT JOIN worst{i} USING (feature) "
                        f"WHERE rel.feature NOT IN (SELECT feature FROM sel{i - 1}))")
        ctes.append(f"w{i} AS (SELECT feature, score FROM s{i} ORDER BY round(score, 12) DESC NULLS LAST, feature LIMIT 1)")
        ctes.append(f"sel{i} AS (" + " UNION ALL ".join(f"SELECT feature FROM w{j}" for j in range(1, i + 1)) + ")")
        outs.append(f"SELECT {i} AS rnk, feature, score FROM w{i}")
        if i < k:
            ctes.append(f"psrc{i} AS ({pairs(f'w{i}', f'sel{i}')})")
            ctes.append(f"p{i} AS ({level_info(f'psrc{i}')})")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT CAST(rnk AS INTEGER) AS rank, CAST(feature AS BIGINT) AS feature, "
            + r6("score") + " AS score FROM (" + " UNION ALL ".join(outs) + ")")


ORACLE["custom_score_tables"] = tables_selection(4)
ORACLE["mrmr_journal"] = emb_selection(3)
ORACLE["estimator_saved"] = ORACLE["estimator_reduce"]
