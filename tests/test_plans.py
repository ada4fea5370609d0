"""Plan shape: pruned scans, map-side combining, no cartesian products, no extra exchanges."""

import re

from pyspark.sql import functions as F

from infosieve.operators import contingency as ctg
from infosieve.operators.cells import MapInstances, WideInstances
from infosieve.plans.tables import LINEITEM_FEATURES, document_tokens, lineitem_features

SF = "/root/testdata/sf0.001"


def _plan(df, mode="formatted"):
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
    return text.split("== Initial Plan ==")[-1]


def test_lineitem_scan_reads_only_the_needed_columns(spark):
    lay = WideInstances(lineitem_features(spark, SF), "label", LINEITEM_FEATURES, cache=False)
    plan = _plan(ctg.count_pairs(lay.class_rows([]), ["feature"]))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    cols = {c.split(":")[0] for c in schema.split(",")}
    assert cols == {"l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    "l_shipdate"}


def test_class_pass_is_one_map_side_combined_exchange(spark):
    lay = WideInstances(lineitem_features(spark, SF), "label", LINEITEM_FEATURES, cache=False)
    plan = _plan(ctg.count_pairs(lay.class_rows([]), ["feature"]), "simple")
    assert plan.count("Exchange") == 1
    assert "partial_count" in plan and "Expand" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_winner_pass_reads_the_winner_from_the_same_row(spark):
    lay = MapInstances(document_tokens(spark, SF), "quality", "tokens", cache=False)
    plan = _plan(ctg.count_pairs(lay.winner_rows(["en"], ["en"]), ["feature", "other"]), "simple")
    # documents x labels is the only join; pairing the winner needs none
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_heavy_stage_runs_in_whole_stage_codegen(spark):
    lay = WideInstances(lineitem_features(spark, SF), "label", LINEITEM_FEATURES)
    lay.prepare(1000)
    df = ctg.count_pairs(lay.winner_rows(["ship_month"], ["ship_month"]), ["feature", "other"])
    df.collect()
    raw = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    plan = raw.split("== Initial Plan ==")[0]            # the executed (final) plan
    lines = [ln.strip(" +-:") for ln in plan.splitlines()]
    for op in ("Expand", "Filter"):
        assert any(ln.startswith("*(") and op in ln.split("[")[0] for ln in lines), op
    assert any(ln.startswith("*(") and "partial_count" in ln for ln in lines)
    lay.unpersist()
