"""Queries on integrity, qualification and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.functions import scalar as S
from driftlane.operators import audit, features, qualify
from driftlane.params import small_sessions as P
from driftlane.plans.registry import EV, SESSION_SQL, events, r6, register, table
from driftlane.sources import events as E

_SPLIT = EV


@register("SELECT count(*) AS n, count(DISTINCT (event_id)) AS ids FROM (SELECT DISTINCT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events))")
def scan_integrity_dedup(spark, sf):
    df = table(spark, sf, "events")
    return df.unionByName(df).dropDuplicates().agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT DISTINCT * FROM lineitem) GROUP BY ALL HAVING count(*) > 1")
def conflicting_keys(spark, sf):
    return E.conflicting(table(spark, sf, "lineitem").dropDuplicates(), ["l_orderkey", "l_linenumber"])


@register(f"WITH {EV} SELECT split, count(*) AS n_events, count(DISTINCT (entity_id, session_id)) AS n_sessions, min(session_date)::VARCHAR AS lo, max(session_date)::VARCHAR AS hi FROM ev GROUP BY 1")
def temporal_split(spark, sf):
    return events(spark, sf).groupBy("split").agg(F.count("*").alias("n_events"), F.count_distinct("entity_id", "session_id").alias("n_sessions"), F.min("session_date").cast("string").alias("lo"), F.max("session_date").cast("string").alias("hi"))


@register("""SELECT CASE WHEN o_orderdate::DATE <= DATE '1996-12-31' THEN 'train' WHEN o_orderdate::DATE <= DATE '1997-12-31' THEN 'validation' WHEN o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' THEN 'test' ELSE 'unassigned' END AS split, count(*) AS n FROM orders GROUP BY 1""")
def historical_split(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(E.historical_split(day, "1996-12-31", "1997-12-31", "1998-01-01", "1998-06-30").alias("split")).agg(F.count("*").alias("n"))


@register("""WITH x AS (SELECT year(l_shipdate)::BIGINT AS season, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_tax END AS b FROM lineitem),
y AS (SELECT season, 'a' AS "column", count(*) AS rows, count(*) - count(a) AS missing FROM x GROUP BY 1 UNION ALL SELECT season, 'b', count(*), count(*) - count(b) FROM x GROUP BY 1)
SELECT season, rows, "column", missing, round(missing / rows, 6) AS share FROM y""")
def missingness_by_year(spark, sf):
    df = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("long").alias("season"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")).alias("b"))
    return E.missingness(df, ["a", "b"]).withColumn("share", F.round("share", 6))


@register(f"WITH {EV} SELECT entity_id, session_id, max(event_no) AS n_events, max(group_no) AS n_groups, min(session_date)::VARCHAR AS day FROM ev GROUP BY 1, 2")
def session_counters(spark, sf):
    return events(spark, sf).groupBy("entity_id", "session_id").agg(F.max("event_no").alias("n_events"), F.max("group_no").alias("n_groups"), F.min("session_date").cast("string").alias("day"))


@register(f"""WITH {EV}, f AS (SELECT entity_id, session_id, kind, min(event_no) AS first_no FROM ev GROUP BY 1, 2, 3)
SELECT entity_id, session_id, event_no, kind, (SELECT count(*) FROM f g WHERE g.entity_id = f.entity_id AND g.session_id = f.session_id AND g.first_no <= f.first_no) AS number FROM ev JOIN f USING (entity_id, session_id, kind)""")
def group_factorize(spark, sf):
    return qualify.factorized(events(spark, sf), "kind", "number").select("entity_id", "session_id", "event_no", "kind", "number")


@register(f"""SELECT session_id, side, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS entity_id
FROM (SELECT *, {SESSION_SQL} AS session_id, CASE WHEN l_linestatus = 'F' THEN 'top' ELSE 'bottom' END AS side FROM lineitem) GROUP BY 1, 2""")
def starter_first_event(spark, sf):
    day = F.col("l_shipdate")
    df = table(spark, sf, "lineitem").withColumns({"entity_id": F.col("l_suppkey"), "session_id": (F.year(day) * 10 + F.quarter(day)).cast("long")})
    side = F.when(F.col("l_linestatus") == "F", "top").otherwise("bottom")
    return qualify.starters(df, ["session_id"], side, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])


@register(f"""WITH l AS (SELECT *, {SESSION_SQL} AS game FROM lineitem), opened AS (
  SELECT game, l_linestatus, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS l_suppkey FROM l WHERE l_linenumber = 1 GROUP BY 1, 2
) SELECT game, l_suppkey AS entity_id, count(*) AS events FROM l WHERE (game, l_suppkey) IN (SELECT (game, l_suppkey) FROM opened) GROUP BY 1, 2""")
def starter_outings(spark, sf):
    """Outings of starters alone: first in the opening part (line 1) of the game, on either side; later ones are relief."""
    day = F.col("l_shipdate")
    df = table(spark, sf, "lineitem").withColumns({"entity_id": F.col("l_suppkey"), "game": (F.year(day) * 10 + F.quarter(day)).cast("long")})
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    opened = qualify.starters(df, ["game"], F.col("l_linestatus"), order, F.col("l_linenumber") == 1)
    return qualify.started(df, opened, ["game"]).groupBy("game", "entity_id").agg(F.count("*").alias("events"))


@register(f"WITH {EV} SELECT entity_id, session_id, arg_min(line_status, event_no) AS line_status, arg_min(kind, event_no) AS kind FROM ev GROUP BY 1, 2")
def outing_provenance(spark, sf):
    ev, shape, spin = _sessions(spark, sf)
    return qualify.outing_reasons(ev, shape, spin, P, ("line_status", "kind")).select("entity_id", "session_id", "line_status", "kind")


_SHAPE, _SPIN = "CASE WHEN event_no % 19 = 0 THEN NULL ELSE f1 END", "CASE WHEN event_no % 23 = 0 THEN NULL ELSE f2 END"
_OUT = f"""{EV}, out AS (
  SELECT entity_id, session_id, min(session_date) AS session_date, max(event_no) AS events, avg(({_SHAPE} IS NULL)::INT) AS shape_missing, avg(({_SPIN} IS NULL)::INT) AS spin_missing FROM ev GROUP BY 1, 2
), sess AS (SELECT *, CASE WHEN spin_missing > 0.05 THEN 'MISSING_SPIN' WHEN shape_missing > 0.05 THEN 'MISSING_SHAPE' WHEN events < {P.min_events} THEN 'TOO_FEW_EVENTS' ELSE 'INCLUDED' END AS reason FROM out
), elig AS (SELECT entity_id, count(*) FILTER (reason = 'INCLUDED' AND session_date <= DATE '{P.validation_end}') AS sessions FROM sess GROUP BY 1)"""


def _sessions(spark, sf):
    ev = events(spark, sf)
    return ev, F.when(F.col("event_no") % 19 != 0, F.col("f1")), F.when(F.col("event_no") % 23 != 0, F.col("f2"))


@register(f"WITH {_OUT} SELECT entity_id, session_id, events, round(shape_missing, 6) AS shape_missing, round(spin_missing, 6) AS spin_missing, reason FROM sess")
def outing_qualification(spark, sf):
    ev, shape, spin = _sessions(spark, sf)
    return qualify.outing_reasons(ev, shape, spin, P).select("entity_id", "session_id", "events", *r6(shape_missing=F.col("shape_missing"), spin_missing=F.col("spin_missing")), "reason")


@register(f"WITH {_OUT} SELECT entity_id, sessions, sessions >= {P.min_sessions} AS eligible FROM elig")
def cohort_eligibility(spark, sf):
    ev, shape, spin = _sessions(spark, sf)
    return qualify.cohort_eligibility(ev.select("entity_id").distinct(), qualify.outing_reasons(ev, shape, spin, P), P, P.validation_end)


@register(f"WITH {EV}, c AS (SELECT l_suppkey AS entity_id, p_brand AS kind, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, kind) AS rank FROM c QUALIFY rank <= {P.top_kinds}")
def top_n_kinds(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("entity_id"), F.col("p_brand").alias("kind"))
    return qualify.top_kinds(df, P)


@register(f"WITH {_OUT} SELECT entity_id, session_id, CASE WHEN reason <> 'INCLUDED' THEN reason ELSE 'ENTITY_TOO_FEW_SESSIONS' END AS reason FROM sess JOIN elig USING (entity_id) WHERE reason <> 'INCLUDED' OR sessions < {P.min_sessions}")
def exclusions_anti(spark, sf):
    ev, shape, spin = _sessions(spark, sf)
    return qualify.qualify(ev, shape, spin, P, P.validation_end)["excluded"]


@register(f"""WITH {_OUT}, ks AS (SELECT entity_id, session_id, split, kind, event_no, group_no, max(group_no) OVER (PARTITION BY entity_id, session_id) - group_no AS groups_left FROM ev JOIN sess USING (entity_id, session_id) JOIN elig USING (entity_id) WHERE reason = 'INCLUDED' AND sessions >= {P.min_sessions})
SELECT split, kind, count(*) AS n, count(*) FILTER (groups_left < 3) AS short, count(DISTINCT (entity_id, session_id)) AS n_sessions FROM ks GROUP BY 1, 2""")
def qualified_events(spark, sf):
    ev, shape, spin = _sessions(spark, sf)
    out = qualify.qualify(ev, shape, spin, P, P.validation_end)["events"]
    return out.groupBy("split", "kind").agg(F.count("*").alias("n"), F.count_if("followup_short").alias("short"), F.count_distinct("entity_id", "session_id").alias("n_sessions"))


_RECORDS = "rec AS (SELECT o_custkey AS entity_id, c_name AS name, year(o_orderdate)::BIGINT AS season, count(*) AS starts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@register(f"""WITH {_RECORDS}, pool AS (SELECT entity_id, min(name) AS name, sum(starts)::BIGINT AS starts FROM rec WHERE season <= 1997 GROUP BY 1 HAVING sum(starts) >= 5),
r AS (SELECT *, sha256('20250917:' || entity_id) AS rank_hash, row_number() OVER (ORDER BY entity_id) <= 20 AS old FROM pool), n AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY rank_hash) AS k FROM r)
SELECT entity_id, name, starts, rank_hash, old OR k <= 20 AS selected, CASE WHEN old THEN 'RETAINED' WHEN k <= 20 THEN 'SEEDED_SAMPLE' ELSE 'NOT_SAMPLED' END AS selection_reason, '1997-12-31' AS selection_cutoff, 20250917::BIGINT AS selection_seed FROM n""")
def hash_rank_cohort(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rec = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("starts"))
    retained = rec.filter("season <= 1997").groupBy("entity_id").agg(F.sum("starts").alias("n")).filter("n >= 5").orderBy("entity_id").limit(20)
    return qualify.select_cohort(rec, retained, 40, 5, 1997, 20250917)


_EVENTS = [*S.OUTCOME_WEIGHTS, "balk"]
_PICK = "['" + "', '".join(_EVENTS) + "'][(l_orderkey % 13) + 1]"


@register(f"""WITH w AS (SELECT unnest([{", ".join(f"'{k}'" for k in S.OUTCOME_WEIGHTS)}]) AS e, unnest([{", ".join(map(str, S.OUTCOME_WEIGHTS.values()))}]::DOUBLE[]) AS v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 10 ELSE coalesce(v, 0) END, 6) AS outcome FROM lineitem LEFT JOIN w ON e = {_PICK}""")
def outcome_values(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _EVENTS)), (F.col("l_orderkey") % 13 + 1).cast("int"))
    name = F.when(F.col("l_linenumber") == 2, F.upper(name)).otherwise(name)
    value = S.outcome_value(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount") * 10), name)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 6).alias("outcome"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s >= 98 AND a BETWEEN 26 - (s - 98) AND 30 + (s - 98), false) AS strong
FROM (SELECT *, CASE WHEN l_linenumber <> 5 THEN 70 + l_quantity END AS s, l_discount * 600 AS a FROM lineitem)""")
def strong_contact(spark, sf):
    speed = F.when(F.col("l_linenumber") != 5, 70 + F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.strong_contact(speed, F.col("l_discount") * 600).alias("strong"))


_ANGLE = "((l_extendedprice * 7) - 360 * floor((l_extendedprice * 7) / 360))"
_XY = "(l_quantity - 25) / 10 AS x, (l_discount * 100 - 5) / 3 AS z"


@register(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cos(radians(a)), 6) AS c, round(sin(radians(a)), 6) AS s, round(sqrt(x * x + z * z), 6) AS d FROM (SELECT *, {_ANGLE} AS a, {_XY} FROM lineitem)")
def circular_features(spark, sf):
    q = F.col("l_extendedprice") * 7
    df = table(spark, sf, "lineitem").withColumns({"a": q - 360 * F.floor(q / 360), "x": (F.col("l_quantity") - 25) / 10, "z": (F.col("l_discount") * 100 - 5) / 3})
    cos, sin = S.circle(F.col("a"), None)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *r6(c=cos, s=sin, d=S.distance2(F.col("x"), F.col("z"), None)))


@register("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -120 - l_quantity / 5 AS vy, CASE WHEN l_linenumber = 3 THEN 0.0 WHEN l_linenumber = 5 THEN NULL ELSE 20 + l_tax * 100 END AS ay, -5 - l_discount * 30 AS vz, -20 - l_tax * 50 AS az FROM lineitem),
t AS (SELECT *, CASE WHEN abs(ay) < 1e-4 THEN (17 / 12 - 50) / vy ELSE (-vy - sqrt(vy * vy - 2 * ay * (50 - 17 / 12))) / ay END AS t FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(t, 6) AS t, round(degrees(atan((vz + az * t) / -(vy + ay * t))), 6) AS vaa FROM t""")
def kinematics_vaa(spark, sf):
    n = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").withColumns({"vy": -120 - F.col("l_quantity") / 5, "ay": F.when(n == 3, 0.0).when(n != 5, 20 + F.col("l_tax") * 100), "vz": -5 - F.col("l_discount") * 30, "az": -20 - F.col("l_tax") * 50})
    c = F.col
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *r6(t=S.flight_time(c("vy"), c("ay")), vaa=S.approach_angle(c("vz"), c("az"), c("vy"), c("ay"), None)))


@register(f"""WITH {EV}, x AS (SELECT *, CASE WHEN event_no % 7 = 0 THEN NULL ELSE f1 END AS v FROM ev)
SELECT entity_id, session_id, event_no, CASE WHEN count(v) OVER w5 >= 2 THEN round(stddev_samp(v) OVER w5, 6) END AS s5, CASE WHEN count(v) OVER w10 >= 3 THEN round(stddev_samp(v) OVER w10, 6) END AS s10 FROM x
WINDOW w5 AS (PARTITION BY entity_id, session_id ORDER BY event_no ROWS 4 PRECEDING), w10 AS (PARTITION BY entity_id, session_id ORDER BY event_no ROWS 9 PRECEDING)""")
def rolling_std(spark, sf):
    v = F.when(F.col("event_no") % 7 != 0, F.col("f1"))
    df = events(spark, sf).withColumn("v", v)
    return df.select("entity_id", "session_id", "event_no", *r6(s5=features.rolling_std(F.col("v"), 5, 2), s10=features.rolling_std(F.col("v"), 10, 3)))


@register(f"""WITH {EV}, x AS (SELECT *, (f2 * 7 - 360 * floor(f2 * 7 / 360)) AS a FROM ev), m AS (SELECT *, count(*) OVER w AS n, avg(sin(radians(a))) OVER w AS s, avg(cos(radians(a))) OVER w AS c FROM x WINDOW w AS (PARTITION BY entity_id, session_id ORDER BY event_no ROWS 9 PRECEDING))
SELECT entity_id, session_id, event_no, CASE WHEN n >= 3 THEN round(least(180, degrees(sqrt(-2 * ln(greatest(1e-12, least(1.0, sqrt(s * s + c * c))))))), 5) END AS sd FROM m""")
def rolling_circular_std(spark, sf):
    q = F.col("f2") * 7
    df = events(spark, sf).withColumn("a", q - 360 * F.floor(q / 360))
    return df.select("entity_id", "session_id", "event_no", F.round(features.rolling_circular_std(F.col("a"), 10, 3), 5).alias("sd"))


@register(f"""WITH {EV}, m AS (SELECT *, avg(f1) FILTER (event_no <= {P.calibration}) OVER (PARTITION BY entity_id, session_id, kind) AS base, count(*) FILTER (event_no <= {P.calibration}) OVER (PARTITION BY entity_id, session_id, kind) AS nb, avg(f1) OVER w AS roll, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY entity_id, session_id, kind ORDER BY event_no ROWS 4 PRECEDING))
SELECT entity_id, session_id, event_no, CASE WHEN kind IN ('N', 'R') AND NOT is_calibration AND nb >= 2 AND n >= 3 THEN round(base - roll, 6) END AS drop FROM m""")
def velocity_drop(spark, sf):
    return events(spark, sf).select("entity_id", "session_id", "event_no", *r6(drop=features.value_drop(F.col("f1"), ["N", "R"], P)))


@register("SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def raw_qualified_anti(spark, sf):
    orders = table(spark, sf, "orders")
    return audit.missing_keys(orders, orders.filter("o_orderpriority = '1-URGENT'"), ["o_custkey"])


@register("SELECT c_custkey AS entity_id, season FROM (SELECT DISTINCT c_custkey FROM customer) CROSS JOIN (SELECT DISTINCT year(o_orderdate)::BIGINT AS season FROM orders) WHERE (c_custkey, season) NOT IN (SELECT o_custkey, year(o_orderdate)::BIGINT FROM orders)")
def segment_completeness(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").cast("long").alias("season"))
    return audit.segment_gaps(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id")), orders.select("season"), orders)


@register("""WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT side, count(*) AS n FROM (SELECT 'left' AS side, k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT 'right', k FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) GROUP BY 1""")
def key_alignment(spark, sf):
    a, b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return audit.same_rows(a, b).groupBy("side").agg(F.count("*").alias("n"))


@register("SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts)::DATE::VARCHAR AS lo, max(ts)::DATE::VARCHAR AS hi FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) > 1)")
def sql_audit(spark, sf):
    text = "SELECT count(*) AS n, count(DISTINCT user_id) AS users, string(date(min(ts))) AS lo, string(date(max(ts))) AS hi FROM {e} WHERE event_type IN (SELECT event_type FROM {e} GROUP BY event_type HAVING count(*) > 1)"
    return E.query(spark, text, e=table(spark, sf, "events"))


@register("""SELECT o_custkey AS entity_id, year(o_orderdate)::BIGINT AS season, count(*) AS rows, 'loaded' AS status FROM orders WHERE year(o_orderdate) <> 1996 GROUP BY 1, 2
UNION ALL SELECT c, s, 0, CASE WHEN s = 1996 THEN 'verified_empty' ELSE 'missing' END FROM (SELECT DISTINCT o_custkey AS c FROM orders) CROSS JOIN (SELECT DISTINCT year(o_orderdate)::BIGINT AS s FROM orders)
WHERE (c, s) NOT IN (SELECT o_custkey, year(o_orderdate)::BIGINT FROM orders WHERE year(o_orderdate) <> 1996)""")
def segment_audit(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").cast("long").alias("season"))
    pairs = rows.select("entity_id").distinct().withColumn("season", F.lit(1996).cast("long"))
    return E.segment_audit(rows, rows, rows.filter("season <> 1996"), pairs)


@register(f"""WITH {EV}, c AS (SELECT split, quantile_cont(f2, 0.005) FILTER (split = 'train') OVER () AS lo, quantile_cont(f2, 0.995) FILTER (split = 'train') OVER () AS hi, f2 FROM ev)
SELECT split, round(min(least(hi, greatest(lo, f2))), 6) AS lo, round(max(least(hi, greatest(lo, f2))), 6) AS hi, round(avg(least(hi, greatest(lo, f2))), 6) AS mean FROM c GROUP BY 1""")
def quantile_clipping(spark, sf):
    from driftlane.operators.models import clipped

    out = clipped(events(spark, sf), ["f2"], F.col("split") == "train")
    return out.groupBy("split").agg(*r6(lo=F.min("f2"), hi=F.max("f2"), mean=F.avg("f2")))
