"""Plan checks: no single-partition exchange over full-size rows, no cartesian / nested-loop joins,
no row-at-a-time Python UDFs, and column pruning at the scan."""

import re

import pytest

from conftest import SF_SMALL
from dialoglab.operators import prompts as B
from dialoglab.operators import sampling as R
from dialoglab.operators import scoring as M
from dialoglab.plans import fixtures as fx
from dialoglab.plans import ranking
from dialoglab.plans.catalog import QUERIES, train_examples
from dialoglab.plans.catalog import test_rows as rows_of_test

SKIP = {"train_binary", "train_multilabel", "train_epochs", "best_training_run", "annotator_reliability"}  # model fits run jobs while they are built


def _plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _operator(line: str) -> str:
    s = re.sub(r"^[\s:+\-|]*", "", line)
    s = re.sub(r"^\*\(\d+\)\s*", "", s)
    return s.split(" ")[0].split("(")[0]


def _single_partition_inputs(plan: str):
    """For every SinglePartition exchange, the first operator below it that is not a pass-through."""
    lines = plan.splitlines()
    passthrough = {"Project", "Filter", "Sort", "ColumnarToRow", "InputAdapter", "WholeStageCodegen"}
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :|+-"))
        for nxt in lines[i + 1:]:
            d = len(nxt) - len(nxt.lstrip(" :|+-"))
            if d <= depth:
                break
            op = _operator(nxt)
            if op not in passthrough:
                out.append(op)
                break
    return out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_plan_shape(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF
    for op in _single_partition_inputs(plan):
        # one partition only ever receives aggregated rows (partial aggregates or a count table), or a few thousand of them
        assert op in {"HashAggregate", "ObjectHashAggregate", "SortAggregate", "LocalLimit"}, (name, op)


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "split_exact")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(s == "doc_id:bigint" for s in schemas)


def test_checker_sees_single_partition_exchanges(spark):
    # the cuts need single-partition exchanges over per-bucket counts and aggregates alone
    assert set(_single_partition_inputs(_plan(spark, "split_exact"))) <= {"HashAggregate", "SortAggregate"}
    ops = _single_partition_inputs(_plan(spark, "pooled_auc"))
    assert ops and set(ops) <= {"HashAggregate", "ObjectHashAggregate"}


@pytest.mark.parametrize("name", ["zeroshot_messages", "zeroshot_messages_technique", "attach_examples", "batch_score",
                                  "split_exact", "sample_cap", "holdout"])
def test_no_text_is_shuffled_for_a_split(spark, name):
    """No scan that reads the text lies below a shuffle."""
    lines = _plan(spark, name).splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :|+-"))
    for i, line in enumerate(lines):
        if "Scan parquet" in line and re.search(r"ReadSchema: struct<[^>]*\btext:", line):
            level = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < level:
                    level = depth(above)
                    if "Exchange" in above and "examples" not in name:
                        pytest.fail(f"{name}: text goes through {above.strip()[:80]}")


def _shuffled_rows(df, columns):
    """Rows that went through shuffles which hold one of the columns, over the whole plan and its subqueries."""
    df.write.format("noop").mode("overwrite").save()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            names = {node.output().apply(i).name() for i in range(node.output().size())}
            if names & set(columns):
                out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for more in (node.children(), node.subqueries()):
            todo += [more.apply(i) for i in range(more.size())]
    return out


GROUPED = {
    "balance_classes": lambda s: R.balance_classes(fx.fx_gold(s, SF_SMALL), "manipulative", tie_cols=()),
    "sample_per_group": lambda s: R.sample_per_group(fx.fx_corpora(s, SF_SMALL), "dataset", n=20, tie_cols=()),
    "select_examples": lambda s: train_examples(s, SF_SMALL),
    "fewshot_messages": lambda s: B.fewshot_messages(rows_of_test(s, SF_SMALL), train_examples(s, SF_SMALL), "binary"),
    "attach_examples": lambda s: B.attach_examples(rows_of_test(s, SF_SMALL), train_examples(s, SF_SMALL)),
    "standardize": lambda s: M.standardize(fx.fx_embeddings(s, SF_SMALL), "class"),
    "project_2d": lambda s: M.project_2d(fx.fx_embeddings(s, SF_SMALL), "class"),
}


@pytest.mark.parametrize("name", sorted(GROUPED))
def test_no_text_or_vector_is_shuffled_for_a_group(spark, name):
    """With Spark's own broadcasts off, as for large tables: only the few chosen examples move with their text."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sum(_shuffled_rows(GROUPED[name](spark), ["dialogue", "text", "embedding", "_v"])) <= 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_more_groups_than_are_broadcast(spark):
    n = ranking.MAX_GROUPS + 50
    df = spark.range(3 * n).selectExpr("cast(id as string) AS id", f"id % {n} AS g", "array(cast(id as double)) AS embedding")
    want = {str(i) for i in range(3 * n)}
    assert {r.id for r in R.sample_per_group(df, "g", n=5, many_groups=True).collect()} == want
    assert M.standardize(df, "g", many_groups=True).count() == 3 * n
    for few in (R.sample_per_group(df, "g", n=5), M.standardize(df, "g")):
        with pytest.raises(Exception, match="many_groups"):
            few.collect()
