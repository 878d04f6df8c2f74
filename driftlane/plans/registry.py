"""Named queries over the sample tables, with SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.params import small_sessions as P
from driftlane.sources.events import sequence_view
from driftlane.sources.sinks import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_view(table(spark, sf_dir, "lineitem"), P)


#: Rows of events that a bucket holds, about.
BUCKET_ROWS = 300_000


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """How many buckets the events of a run are dealt into."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(table(spark, sf_dir, "lineitem").count() / BUCKET_ROWS))


def bucketed_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The events (those columns), shuffled once and written in buckets by entity."""
    n = buckets(spark, sf_dir)
    return materialise(sequence_view(table(spark, sf_dir, "lineitem").repartition(n, "l_suppkey"), P).select(*columns), "entity_id", n)


def r6(**columns):
    """Columns rounded to 6 places under the given names."""
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


SESSION_SQL = "(year(l_shipdate) * 10 + quarter(l_shipdate))::BIGINT"
EV = f"""ev AS (
  SELECT *, ceil(event_no / 3.0)::BIGINT AS group_no, event_no <= {P.calibration} AS is_calibration,
         CASE WHEN session_date <= DATE '{P.train_end}' THEN 'train' WHEN session_date <= DATE '{P.validation_end}' THEN 'validation' WHEN session_date >= DATE '{P.test_start}' THEN 'test' ELSE 'unassigned' END AS split
  FROM (SELECT l_suppkey AS entity_id, {SESSION_SQL} AS session_id, date_trunc('quarter', l_shipdate)::DATE AS session_date,
          row_number() OVER (PARTITION BY l_suppkey, {SESSION_SQL} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS event_no,
          l_returnflag AS kind, l_linestatus AS line_status, l_quantity AS f1, l_extendedprice / 1000 AS f2, l_discount * 100 AS f3, l_tax * 100 AS f4, l_discount * 10 AS raw_outcome, l_orderkey
        FROM lineitem))"""
BASE = f"""sess AS (SELECT entity_id, session_id, min(session_date) AS d FROM ev GROUP BY 1, 2
), ordd AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, session_id) AS ord,
         count(*) OVER (PARTITION BY entity_id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS k FROM sess
), past AS (SELECT ev.*, ord FROM ev JOIN ordd USING (entity_id, session_id)
), base AS (
  SELECT c.entity_id, c.session_id, c.kind, c.k, count(p.f1) AS n, avg(p.f1) AS m0, avg(p.f2) AS m1, var_samp(p.f1) AS v0, var_samp(p.f2) AS v1, covar_samp(p.f1, p.f2) AS c01,
         CASE WHEN c.k < {P.min_prior} THEN 'INSUFFICIENT_HISTORY' WHEN count(p.f1) < {P.min_observations} THEN 'INSUFFICIENT_KIND_OBSERVATIONS' ELSE 'QUALIFIED' END AS state
  FROM (SELECT DISTINCT entity_id, session_id, kind, k FROM past JOIN ordd USING (entity_id, session_id, ord)) c
  LEFT JOIN past p ON p.entity_id = c.entity_id AND p.kind = c.kind AND p.ord > c.k - {P.window_sessions} AND p.ord <= c.k
  GROUP BY 1, 2, 3, 4)"""
SCORED = f"""{EV}, {BASE}, cal AS (
  SELECT *, count(*) FILTER (event_no <= {P.calibration}) OVER w AS en, avg(f1) FILTER (event_no <= {P.calibration}) OVER w AS e0, avg(f2) FILTER (event_no <= {P.calibration}) OVER w AS e1
  FROM ev WINDOW w AS (PARTITION BY entity_id, session_id, kind)
), mixed AS (
  SELECT cal.*, b.k, b.n, b.m0, b.m1, b.v0, b.v1, b.c01, b.state,
         CASE WHEN en >= 3 THEN {1 - P.shrinkage} * m0 + {P.shrinkage} * e0 ELSE m0 END AS cm0, CASE WHEN en >= 3 THEN {1 - P.shrinkage} * m1 + {P.shrinkage} * e1 ELSE m1 END AS cm1,
         CASE WHEN is_calibration THEN 'CALIBRATION' WHEN state <> 'QUALIFIED' THEN state ELSE 'AVAILABLE' END AS availability,
         (v0 + {P.ridge}) AS a0, (v1 + {P.ridge}) AS a1, (v0 + {P.ridge}) * (v1 + {P.ridge}) - c01 * c01 AS det
  FROM cal JOIN base b USING (entity_id, session_id, kind)
), sc AS (
  SELECT *, CASE WHEN availability = 'AVAILABLE' THEN sqrt(((f1 - cm0)**2 * a1 - 2 * (f1 - cm0) * (f2 - cm1) * c01 + (f2 - cm1)**2 * a0) / det) END AS distance FROM mixed)"""
CUSUM = f"""{SCORED}, inc AS (SELECT *, (distance - {P.mean}) / {P.std} - {P.cusum_k} AS i FROM sc
), cu AS (
  SELECT *, CASE WHEN i IS NOT NULL THEN round(list_reduce(list_prepend(0.0::DOUBLE, list(i) FILTER (i IS NOT NULL) OVER (PARTITION BY entity_id, session_id ORDER BY event_no ROWS UNBOUNDED PRECEDING)), lambda a, x: greatest(0.0, a + x)), 6) END AS cusum
  FROM inc)"""
GROUPS = f"""grp AS (
  SELECT entity_id, session_id, group_no, arg_max(raw_outcome, event_no) AS outcome, arg_max((f1 >= 45)::INT, event_no) AS strong, arg_max((f4 >= 8)::INT, event_no) AS free, min(event_no) AS first_no, max(event_no) AS last_no
  FROM ev GROUP BY 1, 2, 3
), roll AS (
  SELECT *, CASE WHEN count(*) OVER w >= 2 THEN round(avg(outcome) OVER w, 3) END AS ro, CASE WHEN count(*) OVER w >= 2 THEN sum(strong) OVER w END AS rs, CASE WHEN count(*) OVER w >= 2 THEN sum(free) OVER w END AS rf
  FROM grp WINDOW w AS (PARTITION BY entity_id, session_id ORDER BY group_no ROWS {P.label_groups - 1} PRECEDING)
), fl AS (
  SELECT *, concat_ws('+', CASE WHEN ro >= {P.label_threshold} THEN 'OUTCOME' END, CASE WHEN rs >= {P.label_strong} THEN 'STRONG' END, CASE WHEN rf >= {P.label_free} THEN 'FREE' END) AS reason FROM roll
), isl AS (SELECT *, group_no - row_number() OVER (PARTITION BY entity_id, session_id ORDER BY group_no) AS g FROM fl WHERE reason <> ''
), epi AS (
  SELECT entity_id, session_id, row_number() OVER (PARTITION BY entity_id, session_id ORDER BY min(group_no)) AS episode_id, min(first_no) AS onset_no, max(last_no) AS end_no, min(group_no) AS onset_group, count(*) AS n_groups, arg_min(reason, group_no) AS reason
  FROM isl GROUP BY entity_id, session_id, g
), lens AS (SELECT entity_id, session_id, max(event_no) AS len FROM ev GROUP BY 1, 2
), hit AS (
  SELECT ev.entity_id, ev.session_id, ev.event_no, coalesce(bool_or(onset_no > event_no AND onset_no <= event_no + {P.horizon}), false) AS target, coalesce(bool_or(event_no BETWEEN onset_no AND end_no), false) AS active
  FROM ev LEFT JOIN epi USING (entity_id, session_id) GROUP BY 1, 2, 3
), lab AS (SELECT hit.*, len - event_no AS remaining, len - event_no < {P.horizon} AND NOT target AND NOT active AS is_censored FROM hit JOIN lens USING (entity_id, session_id))"""
ALL = f"{CUSUM}, {GROUPS}, full_ev AS (SELECT cu.*, target, active, remaining, is_censored FROM cu JOIN lab USING (entity_id, session_id, event_no))"
