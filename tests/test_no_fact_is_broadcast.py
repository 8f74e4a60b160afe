"""Facts that look small by their files."""

import pytest
from pyspark.sql import functions as F

from loomstar.operators.star import seeds
from loomstar.plans import catalogue


def broadcast_sides(df):
    """What stands below each broadcast of a plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return plan, [line for line in plan if "BroadcastHashJoin" in line]


@pytest.mark.parametrize("name", ["response_time_by_type", "workflow_replay"])
def test_no_fact_is_broadcast(spark, tmp_path, name):
    kinds = {
        "fact_messages": "message_type_key string, response_time_seconds float", "dim_tool": "tool_key string, tool_name string, tool_category string",
        "fact_tool_chain_steps": "chain_id string, step_position int, tool_key string, tool_call_id string, session_key string, time_since_prev_seconds float",
        "fact_tool_calls": "tool_call_id string, input_summary string", "fact_session_insights": "session_key string, task_completed boolean, outcome_status string",
    }
    tables = dict(seeds(spark))
    for table, kind in kinds.items():
        spark.range(20).select(*[F.col("id").cast(k).alias(c) for c, k in (x.split() for x in kind.split(", "))]).write.parquet(str(tmp_path / table))
        tables[table] = spark.read.parquet(str(tmp_path / table))
    plan, joins = broadcast_sides(catalogue.run(spark, name, tables.__getitem__))
    if name == "workflow_replay":
        assert sum("SortMergeJoin [tool_call_id" in line for line in plan) == 1
    else:
        assert len(joins) == 1 and "Inner, BuildRight" in joins[0]
