"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables in full; scores are rounded to 6 decimals (plus 0.0,
so -0.0 prints as 0.0) to compare with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.format import score_text
from ..functions.tree import tree_label
from ..operators import contingency as ctg
from ..operators import stats
from ..operators.alignment import mutual_information_aligned, store_by_position
from ..operators.bitmaps import BitmapCells
from ..operators.cells import ArrayInstances, FeatureWise, MapInstances, WideInstances, to_cells
from ..operators.information import mi_from_pairs, mutual_information_columns
from ..operators.reduce import reduce_to
from ..operators.ranks import rank_terms
from ..operators.sample import bernoulli_sample, exact_sample
from ..operators.scores import (MIQ, ExprScore, JointAgg, RankTerm, TablesTerm, VectorAgg, chi2_term, max_redundancy_mrmr,
                                symmetric_uncertainty_mrmr)
from ..operators.selection import select_features
from ..operators.transpose import class_lines, transpose_long
from ..session import scratch_path
from .. import sources
from .tables import LINEITEM_FEATURES, document_tokens, embedding_bits, lineitem_features, table


def _r6(c):
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select(F.col("rank").cast("int").alias("rank"), F.col("feature").cast("long").alias("feature"),
                     _r6(F.col("score")).alias("score"))


def _ranked_str(df: DataFrame) -> DataFrame:
    return df.select(F.col("rank").cast("int").alias("rank"), F.col("feature").cast("string").alias("feature"),
                     _r6(F.col("score")).alias("score"))


def _emb_layout(spark, sf, cache=True):
    return ArrayInstances(embedding_bits(spark, sf), "label", "bits", cache=cache)


def _emb_featurewise(spark, sf):
    b = embedding_bits(spark, sf)
    cells = to_cells(b, "vec_id", array_col="bits").select("feature", F.col("vec_id").alias("pos"), "value")
    classes = b.select(F.col("vec_id").alias("pos"), F.col("label").alias("b"))
    # every position of the widest vector is a feature, all-zero ones included (one aggregate)
    ids = b.agg(F.max(F.size("bits")).alias("w")).select(
        F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("feature"))
    return FeatureWise.from_cells(cells, classes, ids=ids)


def _emb_featurewise_dense(spark, sf):
    """Feature-wise cells with zeros kept (vector scores need whole, aligned vectors)."""
    b = embedding_bits(spark, sf)
    long = transpose_long(b, "vec_id", "bits", keep_zeros=True)
    classes = b.select(F.col("vec_id").alias("pos"), F.col("label").alias("b"))
    return FeatureWise.from_cells(long, classes, ids=long.select("feature").distinct(), dense=True)


# -------------------------------------------------------------------------------- stats
def q_class_histogram(spark, sf):
    li = table(spark, sf, "lineitem")
    return stats.class_histogram(li, "l_returnflag")


def _li_cells(spark, sf):
    li = lineitem_features(spark, sf).withColumn("row", F.monotonically_increasing_id())
    return to_cells(li, "row", LINEITEM_FEATURES), li


def q_feature_levels(spark, sf):
    cells, _ = _li_cells(spark, sf)
    return stats.feature_levels(cells)


def q_dataset_profile(spark, sf):
    return stats.profile(embedding_bits(spark, sf), "bits")


def q_to_cells(spark, sf):
    return to_cells(embedding_bits(spark, sf), "vec_id", array_col="bits").select(
        "vec_id", F.col("feature").cast("long").alias("feature"), "value")


def q_marginals(spark, sf):
    cells, li = _li_cells(spark, sf)
    n = li.count()
    return stats.histograms(cells, n).select("feature", F.col("level").cast("double").alias("level"), "n")


# -------------------------------------------------------------------------------- tables
def q_contingency_class(spark, sf):
    lay = WideInstances(lineitem_features(spark, sf), "label", LINEITEM_FEATURES, cache=False)
    return ctg.count_pairs(lay.class_rows([]), ["feature"]).select("feature", F.col("a").cast("double").alias("a"), "b", "n")


def q_contingency_feature(spark, sf):
    lay = WideInstances(lineitem_features(spark, sf), "label", LINEITEM_FEATURES, cache=False)
    rows = lay.winner_rows(["ship_month"], ["ship_month"])
    return ctg.count_pairs(rows, ["feature", "other"]).select(
        "feature", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "n")


def q_zero_recovery(spark, sf):
    lay = MapInstances(document_tokens(spark, sf), "quality", "tokens", cache=False, hash_keys=False)
    prep = lay.prepare(1_000_000)
    pairs = ctg.count_pairs(lay.class_rows([]), ["feature"])
    full = ctg.full_table(pairs.checkpoint(), prep.hist, ["feature"])
    return full.select("feature", "a", F.col("b").cast("int").alias("b"), "n")


def q_mutual_information(spark, sf):
    lay = WideInstances(lineitem_features(spark, sf), "label", LINEITEM_FEATURES, cache=False)
    prep = lay.prepare(1_000_000)
    pairs = ctg.count_pairs(lay.class_rows([]), ["feature"])
    mi = mi_from_pairs(pairs, prep.hist, prep.n, ["feature"], hist_rows=prep.n_classes)
    return mi.select("feature", _r6(F.col("mi")).alias("mi"))


REDUNDANCY_SET = [0, 1, 2]


def q_redundancy(spark, sf):
    lay = _emb_layout(spark, sf, cache=False)
    prep = lay.prepare(1_000_000)
    ct = ctg.count_pairs(lay.class_rows([]), ["feature"])
    marg = ctg.marginals(ct, ["feature"])
    pairs = ctg.count_pairs(lay.winner_rows(REDUNDANCY_SET, REDUNDANCY_SET), ["feature", "other"])
    nnz = marg.where(F.col("feature").isin(REDUNDANCY_SET)).groupBy("feature").agg(F.sum("n").alias("nnz"))
    hist = (marg.where(F.col("feature").isin(REDUNDANCY_SET))
            .select(F.col("feature").alias("other"), F.col("a").alias("b"), F.col("n").alias("nb"))
            .unionByName(nnz.select(F.col("feature").alias("other"), F.lit(0.0).alias("b"),
                                    (F.lit(prep.n) - F.col("nnz")).alias("nb"))))
    mi = mi_from_pairs(pairs, hist, prep.n, ["feature", "other"], ["other"], hist_rows=None)
    return (mi.groupBy("feature").agg(F.sum("mi").alias("red"))
            .select(F.col("feature").cast("long").alias("feature"), _r6(F.col("red")).alias("red")))


# -------------------------------------------------------------------------------- selection
def q_max_relevance_topk(spark, sf):
    return _ranked(select_features(_emb_layout(spark, sf), 10, "maxrel"))


def q_max_relevance_lineitem(spark, sf):
    lay = WideInstances(lineitem_features(spark, sf), "label", LINEITEM_FEATURES)
    return _ranked_str(select_features(lay, 5, "maxrel"))


def q_mrmr_instance(spark, sf):
    return _ranked(select_features(_emb_layout(spark, sf), 5, "mrmr"))


def q_mrmr_feature(spark, sf):
    return _ranked(select_features(_emb_featurewise(spark, sf), 5, "mrmr", all_zero="keep"))


def q_mrmr_lineitem(spark, sf):
    lay = WideInstances(lineitem_features(spark, sf), "label", LINEITEM_FEATURES)
    return _ranked_str(select_features(lay, 4, "mrmr"))


def q_mrmr_sparse(spark, sf):
    lay = MapInstances(document_tokens(spark, sf), "quality", "tokens", cache=True)
    return _ranked_str(select_features(lay, 5, "mrmr"))


def q_custom_score_expr(spark, sf):
    return _ranked(select_features(_emb_layout(spark, sf), 4, MIQ()))


def q_custom_score_table(spark, sf):
    return _ranked(select_features(_emb_layout(spark, sf), 4, symmetric_uncertainty_mrmr()))


def q_chi2_relevance(spark, sf):
    """Table score with the max-relevance policy: top 10 sign bits by Pearson chi-square."""
    score = ExprScore(lambda rel, red, n, i, k: rel["chi2"], terms={"chi2": chi2_term()}, select_top=10,
                      max_iterations=1, name="chi2")
    return _ranked(select_features(_emb_layout(spark, sf), 10, score))


def q_mrmr_sparse_toxic(spark, sf):
    """Sparse mRMR on token presence against the second label column."""
    lay = MapInstances(document_tokens(spark, sf).select("doc_id", "toxic", "tokens"), "toxic", "tokens")
    return _ranked_str(select_features(lay, 3, "mrmr"))


def abs_corr_mrmr() -> ExprScore:
    """Vector score: |corr(f, class)| - mean |corr(f, s)| over the aligned value vectors."""
    def fn(rel, red, n_selected, i, nfs):
        coef = 1.0 if n_selected <= 1 else 1.0 / n_selected
        return rel["corr"] - F.lit(coef) * red["corr"]
    return ExprScore(fn, terms={"corr": VectorAgg(lambda x, y: F.abs(F.corr(x, y)))}, name="abs_corr_mrmr")


def q_custom_score_vector(spark, sf):
    return _ranked(select_features(_emb_featurewise_dense(spark, sf), 4, abs_corr_mrmr(), all_zero="keep"))


def q_batch_policy(spark, sf):
    def fn(rel, red, n_selected, i, nfs):
        coef = 1.0 if n_selected <= 1 else 1.0 / n_selected
        return rel["mi"] - F.lit(coef) * red["mi"]
    return _ranked(select_features(_emb_layout(spark, sf), 4, ExprScore(fn, select_top=2, name="mrmr2")))


def q_select_and_reduce(spark, sf):
    b = embedding_bits(spark, sf)
    sel = [r["feature"] for r in select_features(ArrayInstances(b, "label", "bits", cache=True), 3, "mrmr").collect()]
    return reduce_to(b, sel, keep=["vec_id", "label"], array_col="bits",
                     names=[f"sel_{i + 1}" for i in range(len(sel))])


def q_transpose(spark, sf):
    b = embedding_bits(spark, sf)
    return transpose_long(b, "vec_id", "bits").select(F.col("feature").cast("long").alias("feature"),
                                                     F.col("pos").alias("pos"), "value")


def q_class_line(spark, sf):
    b = embedding_bits(spark, sf)
    return class_lines(b.select(F.col("vec_id").alias("pos"), "label"))


def q_tree_label(spark, sf):
    b = embedding_bits(spark, sf)
    bits = [F.col("bits")[i].cast("int") for i in range(8)]
    return b.select("vec_id", tree_label(bits).alias("y"))


def q_selection_report(spark, sf):
    r = select_features(_emb_layout(spark, sf), 5, "mrmr")
    return r.select(F.col("rank").alias("order"), F.col("feature").cast("string").alias("name"),
                    score_text(F.col("score")).alias("score"))


# -------------------------------------------------------------------------------- scans
def _write_bits(spark, sf, fmt):
    b = embedding_bits(spark, sf)
    path = scratch_path(spark, f"emb-{fmt}")
    if fmt == "libsvm":
        sources.write_libsvm(b, path, "label", "bits")
    else:
        sources.write_instances_text(b, path, "label", "bits", sep="," if fmt == "csv" else "\t")
    return path


def q_csv_scan(spark, sf):
    df = sources.read_instances_text(spark, _write_bits(spark, sf, "csv"), sep=",")
    return _ranked(select_features(ArrayInstances(df, "label", "features", cache=True), 10, "maxrel"))


def q_tsv_scan(spark, sf):
    df = sources.read_instances_text(spark, _write_bits(spark, sf, "tsv"), sep="tsv")
    return _ranked(select_features(ArrayInstances(df, "label", "features", cache=True), 3, "mrmr"))


def q_libsvm_scan(spark, sf):
    df = sources.read_libsvm(spark, _write_bits(spark, sf, "libsvm"))
    return _ranked(select_features(MapInstances(df, "label", "features"), 3, "mrmr"))


def _write_featurewise(spark, sf):
    b = embedding_bits(spark, sf)
    fpath, cpath = scratch_path(spark, "emb-fw"), scratch_path(spark, "emb-class")
    sources.write_cells_text(transpose_long(b, "vec_id", "bits"), fpath)
    sources.write_class_vector(b.select(F.col("vec_id").alias("pos"), "label"), cpath)
    return fpath, cpath


def q_feature_csv_scan(spark, sf):
    fpath, cpath = _write_featurewise(spark, sf)
    cells = sources.read_cells_text(spark, fpath, id_type="long")
    cl = sources.read_class_positions(spark, cpath).select("pos", F.col("label").alias("b"))
    return _ranked(select_features(FeatureWise.from_cells(cells, cl, dense=True), 3, "mrmr", all_zero="keep"))


def _write_featurewise_libsvm(spark, sf):
    """Feature-wise LibSVM, a line per feature and 1,000 positions so that no line grows with the
    data, and its tagged class file."""
    b = embedding_bits(spark, sf)
    fpath, cpath = scratch_path(spark, "emb-fw-libsvm"), scratch_path(spark, "emb-class")
    sources.write_features_libsvm(transpose_long(b, "vec_id", "bits"), fpath)
    sources.write_class_vector(b.select(F.col("vec_id").alias("pos"), "label"), cpath)
    return fpath, cpath


def q_feature_libsvm_scan(spark, sf):
    fpath, cpath = _write_featurewise_libsvm(spark, sf)
    cells, ids = sources.read_features_libsvm(spark, fpath), sources.read_libsvm_ids(spark, fpath)
    cl = sources.read_classes(spark, cpath).select("pos", F.col("label").alias("b"))
    return _ranked(select_features(FeatureWise.from_cells(cells, cl, ids=ids), 5, "mrmr", all_zero="keep"))


def q_selection_job_feature_wise(spark, sf):
    """M8 on feature-wise LibSVM with a class file: the report, each row with the whole profile."""
    from .job import report_for
    fpath, cpath = _write_featurewise_libsvm(spark, sf)
    report, prof = report_for(spark, fpath, "row-wise", 5, "libsvm", 0, "FeatureWiseMRMR", cpath)
    p = prof.first()
    return report.select("*", *[F.lit(p[c]).cast("long").alias(c) for c in ("n_rows", "n_cols", "n_points")])


def q_estimator_reduce(spark, sf):
    """M7 on sparse ML vectors: fit, then every row reduced to the chosen features."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from .estimator import InfoSelector
    b = embedding_bits(spark, sf).select("vec_id", "label", array_to_vector("bits").alias("features"))
    out = InfoSelector(3).fit(b).transform(b).select("vec_id", "label", vector_to_array("selected").alias("s"))
    return out.select("vec_id", "label", *[F.col("s")[i].alias(f"sel_{i + 1}") for i in range(3)])


def q_mi_two_columns(spark, sf):
    """A10: information shared by the month of shipping and the quantity of a line item."""
    return mutual_information_columns(lineitem_features(spark, sf), "ship_month", "quantity").select(_r6(F.col("mi")).alias("mi"))


def q_mrmr_mixed(spark, sf):
    """Levels of several types, compared exactly: strings, a BIGINT key and small numbers of ``orders``."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("label"), "o_orderpriority", (F.col("o_custkey") % 17).cast("long").alias("cust_mod"),
        F.year("o_orderdate").alias("year"), F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("dear"))
    return _ranked_str(select_features(WideInstances(o, "label"), 4, "mrmr"))


def joint_interaction() -> ExprScore:
    """A vector score of candidate, class and selected vectors together: |corr(x, y)| plus the
    mean over the selected of |corr(x s, y)|."""
    def fn(x, y, s):
        alone = F.abs(F.corr(x, y))
        return alone + sum((F.coalesce(F.abs(F.corr(x * v, y)), F.lit(0.0)) for v in s), F.lit(0.0)) / max(1, len(s))
    return ExprScore(lambda rel, red, n, i, k: rel["joint"], terms={"joint": JointAgg(fn)}, name="joint_interaction")


def q_custom_score_joint(spark, sf):
    return _ranked(select_features(_emb_featurewise_dense(spark, sf), 4, joint_interaction(), all_zero="keep"))


def q_custom_score_max_redundancy(spark, sf):
    return _ranked(select_features(_emb_layout(spark, sf), 5, max_redundancy_mrmr()))


def q_selection_job(spark, sf):
    """M8: the command-line job's work (CSV in, report out) on the embeddings' sign bits."""
    from .job import report_for
    path = _write_bits(spark, sf, "csv")
    report, _ = report_for(spark, path, "column-wise", 5, "csv", 0, "InstanceWiseMRMR")
    return report


def q_class_vector_scan(spark, sf):
    _, cpath = _write_featurewise(spark, sf)
    return sources.read_class_positions(spark, cpath).select("pos", F.col("label").cast("int").alias("label"))


def q_class_line_scan(spark, sf):
    """The class vector as one line over many files, written and read back."""
    path = scratch_path(spark, "class-line")
    sources.write_class_line(embedding_bits(spark, sf).select(F.col("vec_id").alias("pos"), "label"), path)
    return sources.read_class_line(spark, path, label_type="int")


def q_feature_lines_scan(spark, sf):
    """Whole-vector feature lines over many files, written and read back."""
    path = scratch_path(spark, "feature-lines")
    sources.write_feature_lines(transpose_long(embedding_bits(spark, sf), "vec_id", "bits"), path)
    return sources.read_feature_lines(spark, path, id_type="long")


def q_row_sample(spark, sf):
    return bernoulli_sample(embedding_bits(spark, sf).select("vec_id", "label"), 0.5, "vec_id", seed=42)


def q_row_sample_exact(spark, sf):
    """exactly 200 rows, those of the smallest digests."""
    return exact_sample(embedding_bits(spark, sf).select("vec_id", "label"), 200, "vec_id", seed=7)


def q_mrmr_lazy(spark, sf):
    """Sparse mRMR that counts redundancy only for candidates whose upper bound reaches the best."""
    lay = MapInstances(document_tokens(spark, sf), "quality", "tokens", cache=True)
    return _ranked_str(select_features(lay, 5, "mrmr", lazy=True))


def q_mrmr_bitmaps(spark, sf):
    """Sparse mRMR whose tables are counted by AND and popcount of position bitmaps."""
    lay = BitmapCells(MapInstances(document_tokens(spark, sf), "quality", "tokens", cache=True))
    return _ranked_str(select_features(lay, 5, "mrmr"))


#: Buckets of stored tables at the given sizes; more for larger input.
BUCKETS = 8


def q_mrmr_stored(spark, sf):
    """Feature-wise mRMR on stored cells: features fetched by key, vectors aligned without an exchange."""
    b = embedding_bits(spark, sf)
    cells = to_cells(b, "vec_id", array_col="bits").select("feature", F.col("vec_id").alias("pos"), "value")
    classes = b.select(F.col("vec_id").alias("pos"), F.col("label").alias("b"))
    ids = b.agg(F.max(F.size("bits")).alias("w")).select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("feature"))
    return _ranked(select_features(FeatureWise.from_cells(cells, classes, ids=ids, store=BUCKETS), 5, "mrmr", all_zero="keep"))


def q_mi_aligned_vectors(spark, sf):
    """MI of two long vectors, stored in buckets by position and merged where they lie."""
    o = table(spark, sf, "orders")
    pos = F.col("o_orderkey").cast("long").alias("pos")
    x = store_by_position(o.select(pos, F.year("o_orderdate").alias("value")), BUCKETS)
    y = store_by_position(o.select(pos, F.col("o_orderpriority").alias("value")), BUCKETS)
    return mutual_information_aligned(x, y).select(_r6(F.col("mi")).alias("mi"))


def rank_mrmr(kind: str) -> ExprScore:
    """|rank correlation with the class| less the mean |rank correlation| with the selected features."""
    def fn(rel, red, n_selected, i, nfs):
        return rel["r"] - F.lit(1.0 if n_selected <= 1 else 1.0 / n_selected) * red["r"]
    return ExprScore(fn, terms={"r": RankTerm(kind)}, pair_values=lambda t: {"r": F.abs(t["r"])}, name=f"{kind}_mrmr",
                     bounded=True)


def _quantity_layout(spark, sf):
    li = lineitem_features(spark, sf).drop("label").withColumnRenamed("quantity", "label")
    return WideInstances(li, "label", [f for f in LINEITEM_FEATURES if f != "quantity"])


def q_spearman_mrmr(spark, sf):
    return _ranked_str(select_features(_quantity_layout(spark, sf), 4, rank_mrmr("spearman")))


def q_kendall_mrmr(spark, sf):
    return _ranked_str(select_features(_quantity_layout(spark, sf), 4, rank_mrmr("kendall")))


def q_rank_correlations(spark, sf):
    """Spearman and Kendall of every dimension of ``embeddings``, ties and all, with the class."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("feature", "a"))
    counts = e.groupBy("feature", F.col("a").cast("double").alias("a"), F.col("label").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = rank_terms(counts, ["feature"], {"spearman": "spearman", "kendall": "kendall"})
    return both.select(F.col("feature").cast("long").alias("feature"), _r6(F.col("spearman")).alias("spearman"),
                       _r6(F.col("kendall")).alias("kendall"))


def worst_level_redundancy() -> ExprScore:
    """Relevance less, level by level of the candidate, the largest redundancy with any selected feature: a function
    of all tables together that no sum, maximum or minimum over whole tables gives."""
    def value(cells):
        info = F.expr("n / total * log2(n * total / (na * nb))")
        worst = (cells.where("place > 0").groupBy("feature", "a", "place").agg(info_sum(info))
                 .groupBy("feature", "a").agg(F.max("i").alias("i")).groupBy("feature").agg(F.sum("i").alias("worst")))
        rel = cells.where("place = 0").groupBy("feature").agg(info_sum(info))
        return rel.join(worst, "feature", "left").select(
            "feature", (F.col("i") - F.coalesce("worst", F.lit(0.0))).alias("value"))

    def info_sum(info):
        return F.sum(info).alias("i")
    return ExprScore(lambda rel, red, n, i, k: rel["v"], terms={"v": TablesTerm(value)}, name="worst_level_redundancy")


def q_custom_score_tables(spark, sf):
    return _ranked(select_features(_emb_layout(spark, sf), 4, worst_level_redundancy()))


def q_mrmr_journal(spark, sf):
    """M8: a selection that keeps a journal; a second driver with the same journal takes its result from there."""
    path = scratch_path(spark, "journal")
    select_features(_emb_layout(spark, sf), 3, "mrmr", journal=path)
    return _ranked(select_features(_emb_layout(spark, sf), 3, "mrmr", journal=path))


def q_estimator_saved(spark, sf):
    """M7: a pipeline with the selector, fitted, saved, loaded and applied to every row."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from .estimator import InfoSelector
    b = embedding_bits(spark, sf).select("vec_id", "label", array_to_vector("bits").alias("features"))
    path = scratch_path(spark, "pipeline-model")
    Pipeline(stages=[InfoSelector(3)]).fit(b).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(b).select("vec_id", "label", vector_to_array("selected").alias("s"))
    return out.select("vec_id", "label", *[F.col("s")[i].alias(f"sel_{i + 1}") for i in range(3)])


QUERIES = {
    "class_histogram": q_class_histogram,
    "feature_levels": q_feature_levels,
    "dataset_profile": q_dataset_profile,
    "to_cells": q_to_cells,
    "contingency_class": q_contingency_class,
    "contingency_feature": q_contingency_feature,
    "marginals": q_marginals,
    "zero_recovery": q_zero_recovery,
    "mutual_information": q_mutual_information,
    "redundancy": q_redundancy,
    "max_relevance_topk": q_max_relevance_topk,
    "max_relevance_lineitem": q_max_relevance_lineitem,
    "mrmr_instance": q_mrmr_instance,
    "mrmr_feature": q_mrmr_feature,
    "mrmr_lineitem": q_mrmr_lineitem,
    "mrmr_sparse": q_mrmr_sparse,
    "custom_score_expr": q_custom_score_expr,
    "custom_score_table": q_custom_score_table,
    "custom_score_vector": q_custom_score_vector,
    "chi2_relevance": q_chi2_relevance,
    "mrmr_sparse_toxic": q_mrmr_sparse_toxic,
    "batch_policy": q_batch_policy,
    "select_and_reduce": q_select_and_reduce,
    "transpose": q_transpose,
    "class_line": q_class_line,
    "tree_label": q_tree_label,
    "selection_report": q_selection_report,
    "csv_scan": q_csv_scan,
    "tsv_scan": q_tsv_scan,
    "libsvm_scan": q_libsvm_scan,
    "feature_csv_scan": q_feature_csv_scan,
    "class_vector_scan": q_class_vector_scan,
    "class_line_scan": q_class_line_scan,
    "feature_lines_scan": q_feature_lines_scan,
    "feature_libsvm_scan": q_feature_libsvm_scan,
    "selection_job": q_selection_job,
    "selection_job_feature_wise": q_selection_job_feature_wise,
    "estimator_reduce": q_estimator_reduce,
    "mi_two_columns": q_mi_two_columns,
    "mrmr_mixed": q_mrmr_mixed,
    "custom_score_joint": q_custom_score_joint,
    "custom_score_max_redundancy": q_custom_score_max_redundancy,
    "row_sample": q_row_sample,
    "row_sample_exact": q_row_sample_exact,
    "mrmr_lazy": q_mrmr_lazy,
    "mrmr_bitmaps": q_mrmr_bitmaps,
    "mrmr_stored": q_mrmr_stored,
    "mi_aligned_vectors": q_mi_aligned_vectors,
    "spearman_mrmr": q_spearman_mrmr,
    "kendall_mrmr": q_kendall_mrmr,
    "rank_correlations": q_rank_correlations,
    "custom_score_tables": q_custom_score_tables,
    "mrmr_journal": q_mrmr_journal,
    "estimator_saved": q_estimator_saved,
}
