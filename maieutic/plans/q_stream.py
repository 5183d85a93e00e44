"""Catalogue: step metrics (X1-X5, batch form) and the forward as-of attach."""

from __future__ import annotations

from maieutic.operators.behavior import METRIC_COLUMNS
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import RESPONSES_SELECT_SQL, responses, table
from maieutic.streaming.asof import attach_next_log
from maieutic.streaming.step_metrics import (
    eval_subset_ids,
    prefixed_metric_rows,
    step_metrics,
)

EVERY, MAX_SAMPLES = 150, 200
_EVAL_ROWS = f"SELECT * FROM ({RESPONSES_SELECT_SQL}) r WHERE step > 0 AND step % {EVERY} = 0"
_STEP_SQL = (f"WITH {o.behavior_features_ctes(_EVAL_ROWS)}\n"
             f"{o.behavior_metric_select(('run_id', 'step'))} FROM f GROUP BY run_id, step")


@register("x1_x3_step_metrics", _STEP_SQL)
def q_step_metrics(spark, sf_dir):
    return step_metrics(_repeated(spark, sf_dir), EVERY)


def _repeated(spark, sf_dir):
    """Every third response is reported twice; the oracle has each once."""
    r = responses(spark, sf_dir)
    return r.unionByName(r.where("response_id % 3 = 0"))


_SUBSET_SQL = f"""SELECT prompt_id FROM (SELECT prompt_id, row_number() OVER (ORDER BY
  md5(concat_ws(':', '42', CAST(prompt_id AS VARCHAR))), prompt_id) AS rk FROM (SELECT DISTINCT o_custkey AS prompt_id
  FROM orders) d) r WHERE rk <= {MAX_SAMPLES}"""
_SUBSET_ROWS = f"SELECT * FROM ({_EVAL_ROWS}) e WHERE prompt_id IN ({_SUBSET_SQL})"


@register(
    "x4_subset_step_metrics",
    f"WITH {o.behavior_features_ctes(_SUBSET_ROWS)}\n{o.behavior_metric_select(('run_id', 'step'))} FROM f "
    "GROUP BY run_id, step",
)
def q_subset_step_metrics(spark, sf_dir):
    subset = eval_subset_ids(responses(spark, sf_dir), MAX_SAMPLES, "prompt_id")
    return step_metrics(_repeated(spark, sf_dir), EVERY, subset_ids=subset)


_METRICS = METRIC_COLUMNS


PREFIXED_SQL = f"""WITH s AS ({_STEP_SQL})
SELECT run_id, step, 'custom/' || metric AS metric, value FROM (
  UNPIVOT (SELECT run_id, step, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in _METRICS)} FROM s)
  ON {', '.join(_METRICS)} INTO NAME metric VALUE value) u"""


@register("x5_prefixed_metric_rows", PREFIXED_SQL)
def q_prefixed_rows(spark, sf_dir):
    return prefixed_metric_rows(step_metrics(_repeated(spark, sf_dir), EVERY))


@register(
    "j9_attach_next_log",
    """WITH ev AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('error', 'view')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev),
n AS (SELECT *, min(CASE WHEN event_type = 'view' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_log_rn FROM o),
m AS (SELECT user_id, next_log_rn, max(rn) AS metric_rn FROM n WHERE event_type = 'error' AND next_log_rn IS NOT NULL
  GROUP BY user_id, next_log_rn)
SELECT m.user_id, l.event_id AS log_id, e.event_id AS metric_id FROM m
JOIN o l ON l.user_id = m.user_id AND l.rn = m.next_log_rn
JOIN o e ON e.user_id = m.user_id AND e.rn = m.metric_rn""",
)
def q_attach_next_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return attach_next_log(ev, "user_id", "ts", "event_id", "event_type", "error", "view")
