"""Control flow, identities under Spark, error modes, and sequences with null keys and repeated rows."""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .. import sources
from ..operators.flow import tapped
from ..seq import Seq
from .advanced import _BY, _main, _rails
from .registry import DAY, EV, HOUR, by_user, events, kind, listed, query, whole

#: Events whose user is unknown for one event in five, and each tenth of them twice.
NV = f"{EV}, nv AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, event_id, event_type, us, v FROM ev UNION ALL SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END, event_id, event_type, us, v FROM ev WHERE event_id % 10 = 0)"


def _unknown(spark, sf, repeated: bool = True):
    rows = events(spark, sf).withColumn("user_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")))
    return rows.unionByName(rows.where("event_id % 10 = 0")) if repeated else rows


@query(f"WITH {EV} SELECT s.event_id AS opened, count(*) AS n FROM ev s JOIN ev e ON s.user_id = e.user_id AND e.event_type = 'click' AND e.us >= s.us WHERE s.event_type = 'signup' GROUP BY s.event_id")
def src_never(spark, sf):
    """Spans that never end."""
    spans = kind(spark, sf, "signup").select("user_id", F.col("event_id").alias("opened"), F.col("us").alias("s"), sources.never().alias("e"))
    clicks = kind(spark, sf, "click").select("user_id", F.col("us").alias("at"), (F.col("us") + 1).alias("until"))
    return Seq(spans, "opened", "user_id").join_overlapping(clicks, ("s", "e"), ("at", "until")).groupBy("opened").agg(F.count("*").alias("n"))


@query("SELECT ord::BIGINT AS ord, value FROM (VALUES (0, 1), (1, 4), (2, 9)) t(ord, value)")
def src_stream(spark, sf):
    return sources.from_stream(spark, (k * k for k in (1, 2, 3))).df


@query("SELECT 0::BIGINT AS ord, 11 AS value")
def src_future(spark, sf):
    future: Future = Future()
    future.set_result(11)
    return sources.from_future(spark, future).df


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events")
def k_subscribe(spark, sf):
    """Rows handed to a function on the executors."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    whole(spark, sf).subscribe(lambda row: (n.add(1), total.add(row["event_id"])))
    return spark.range(1).select(F.lit(n.value).cast("long").alias("n"), F.lit(total.value).cast("long").alias("total"))


@query("SELECT max(event_id) AS event_id FROM events")
def k_peek_last(spark, sf):
    return spark.range(1).select(F.lit(whole(spark, sf).peek_last()["event_id"]).cast("long").alias("event_id"))


@query("SELECT min(event_id) AS first_id, true AS in_time FROM events")
def k_first_in_time(spark, sf):
    found = whole(spark, sf).blocking_first(timeout=600)
    return spark.range(1).select(F.lit(found["event_id"]).cast("long").alias("first_id"), F.lit(True).alias("in_time"))


@query("SELECT true AS checked, true AS refused")
def k_test(spark, sf):
    """The assertion helper accepts what is so and refuses what isn't."""
    helper = sources.range_(spark, 1, 3).test().assert_values("value", 1, 2, 3).assert_count(3).assert_complete()
    sources.error(spark, "no such luck").test().assert_error("no such luck")
    try:
        helper.assert_count(4)
        refused = False
    except AssertionError:
        refused = True
    return spark.range(1).select(F.lit(True).alias("checked"), F.lit(refused).alias("refused"))


@query("SELECT user_id, event_id FROM events")
def p_hide(spark, sf):
    return by_user(spark, sf).hide().df.select("user_id", "event_id")


_PARTS = "p AS (SELECT user_id, event_id, i::INTEGER AS pos, event_id * 10 + i AS value, v FROM ev, range(2) t(i))"


def _two(column):
    return F.array(column * 10, column * 10 + 1)


@query(f"WITH {EV}, {_PARTS}, f AS (SELECT *, max(CASE WHEN v >= 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS failed FROM p) SELECT user_id, event_id, pos, value FROM f WHERE failed = 0")
def p_concatmap_immediate(spark, sf):
    return by_user(spark, sf).concat_map(_two(F.col("event_id")), error=F.col("v") >= 95).df


@query(f"WITH {EV}, {_PARTS} SELECT user_id, event_id, pos, value FROM p WHERE v < 95")
def p_concatmap_end(spark, sf):
    return by_user(spark, sf).concat_map(_two(F.col("event_id")), error=F.col("v") >= 95, mode="end").df


@query(f"WITH {EV}, {_PARTS} SELECT user_id, event_id, value FROM p WHERE v < 95")
def p_flatmap_delayed(spark, sf):
    return by_user(spark, sf).flat_map(_two(F.col("event_id")), error=F.col("v") >= 95, delay_error=True).df


@query(f"WITH {EV} SELECT user_id, count(*) FILTER (v >= 95) AS errors FROM ev GROUP BY user_id")
def e_delayed_errors(spark, sf):
    return by_user(spark, sf).errors(F.col("v") >= 95)


_CAT = f"WITH {EV}, c AS (SELECT 0 AS source_index, event_id, v FROM ev WHERE event_type = 'click' UNION ALL SELECT 1, event_id, v FROM ev WHERE event_type = 'purchase')"


@query(f"{_CAT}, f AS (SELECT *, max(CASE WHEN v >= 98 THEN 1 ELSE 0 END) OVER (PARTITION BY source_index ORDER BY event_id) AS failed FROM c) SELECT source_index, event_id FROM f WHERE failed = 0")
def j_concat_delayed(spark, sf):
    seq = Seq(kind(spark, sf, "click"), "event_id")
    return seq.concat_with(kind(spark, sf, "purchase"), error=F.col("v") >= 98, delay_error=True).df.select("source_index", "event_id")


@query(f"{_CAT}, f AS (SELECT *, max(CASE WHEN v >= 98 THEN 1 ELSE 0 END) OVER (ORDER BY source_index, event_id) AS failed FROM c) SELECT source_index, event_id FROM f WHERE failed = 0")
def j_concat_error(spark, sf):
    seq = Seq(kind(spark, sf, "click"), "event_id")
    return seq.concat_with(kind(spark, sf, "purchase"), error=F.col("v") >= 98).df.select("source_index", "event_id")


@query(f"WITH {EV}, s AS (SELECT user_id, event_id, us, us + (event_id % 4 + 1) * {DAY} AS until FROM ev WHERE event_type = 'signup') SELECT s.user_id, s.event_id AS window_id, count(*) AS n, sum(e.v)::BIGINT AS total FROM s JOIN ev e ON e.user_id = s.user_id AND e.us >= s.us AND e.us < s.until AND e.event_type <> 'signup' GROUP BY ALL")
def w_window2(spark, sf):
    """Windows whose end each opening row chooses for itself."""
    spans = kind(spark, sf, "signup").select("user_id", "event_id", F.col("us").alias("s"), (F.col("us") + (F.col("event_id") % 4 + 1) * DAY).alias("e"))
    found = _main(spark, sf).window_begin_end(spans, "us", "s", "e", "event_id")
    return found.df.groupBy(*found.key).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM events")
def m_direct(spark, sf):
    """A direct processor with two consumers."""
    shared = whole(spark, sf).process()
    stop = shared.connect()
    try:
        n, clicks = shared.subscribe().df.count(), shared.subscribe().filter(F.col("event_type") == "click").df.count()
    finally:
        stop()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(clicks).cast("long").alias("clicks"))


@query("SELECT event_id, event_type FROM events")
def b_observe_on(spark, sf):
    return whole(spark, sf).observe_on(5).df.select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events")
def b_subscribe_on(spark, sf):
    seq = whole(spark, sf).subscribe_on("reports")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    return seq.df.select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def b_identities(spark, sf):
    """Operators that Spark's runtime makes unnecessary leave the rows as they are."""
    return Seq(kind(spark, sf, "view"), "event_id").on_terminate_detach().await_on_subscribe().on_assembly().df.select("event_id")


@query("SELECT count(*) AS n, 'subscribed,completed,terminated' AS told FROM events")
def b_tapped(spark, sf):
    told = []
    n = tapped(whole(spark, sf).df.count, lambda: told.append("subscribed"), lambda e: told.append("failed"), lambda: told.append("completed"), lambda: told.append("terminated"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(",".join(told)).alias("told"))


@query(f"{_BY} SELECT rail, event_id, v FROM r")
def l_run_on(spark, sf):
    return _rails(spark, sf).run_on(6).df.select("rail", "event_id", "v")


@query(f"{_BY} SELECT count(*) AS n, max(rail) AS last_rail FROM r")
def l_do_on(spark, sf):
    tap = Observation("rails")
    rows = _rails(spark, sf).do_on(tap, F.count(F.lit(1)).alias("n"), F.max("rail").alias("last_rail")).df
    rows.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(tap.get["n"]).cast("long").alias("n"), F.lit(tap.get["last_rail"]).cast("long").alias("last_rail"))


@query(f"{_BY} SELECT rail, event_id FROM r WHERE v > 50")
def l_compose(spark, sf):
    return _rails(spark, sf).compose(lambda rails: rails.filter(F.col("v") > 50)).df.select("rail", "event_id")


@query(f"""WITH {NV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM nv WHERE event_type = 'click' AND event_id % 10 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM nv WHERE event_type = 'purchase' AND event_id % 10 <> 0)
SELECT a.user_id, a.place, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.place = b.place""")
def n_zip(spark, sf):
    """Null keys are a sequence like others."""
    rows = _unknown(spark, sf).where("event_id % 10 <> 0").select("event_id", "user_id", "event_type")
    a, b = (Seq(rows.where(F.col("event_type") == n).drop("event_type"), "event_id", "user_id") for n in ("click", "purchase"))
    return a.zip_with(b).df.select("user_id", "place", F.col("event_id").alias("left_id"), F.col("event_id_2").alias("right_id"))


@query(f"WITH {NV}, w AS (SELECT user_id, arg_min(event_type, event_id) AS first_type FROM nv WHERE event_type IN ('click', 'purchase') GROUP BY user_id) SELECT nv.* FROM nv JOIN w ON w.user_id IS NOT DISTINCT FROM nv.user_id AND w.first_type = nv.event_type")
def n_amb(spark, sf):
    rows = _unknown(spark, sf)
    return Seq(rows.where("event_type = 'click'"), "event_id", "user_id").amb_with(rows.where("event_type = 'purchase'"), time="us").df


@query(f"""WITH {NV}, l AS (SELECT *, row_number() OVER () AS nr FROM nv WHERE event_type = 'click')
SELECT l.user_id, l.event_id AS l_id, coalesce(string_agg(r.event_id::VARCHAR, ',' ORDER BY r.event_id), '') AS ids FROM l LEFT JOIN nv r ON l.user_id IS NOT DISTINCT FROM r.user_id AND r.event_type = 'purchase' AND l.us < r.us + {2 * HOUR} AND r.us < l.us + {HOUR} GROUP BY l.nr, l.user_id, l.event_id""")
def n_group_join(spark, sf):
    """Repeated left rows stay as many as they are, each with all its matches."""
    rows = _unknown(spark, sf)
    left = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("l_id"), F.col("us").alias("l_from"), (F.col("us") + HOUR).alias("l_to"))
    right = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("r_id"), F.col("us").alias("r_from"), (F.col("us") + 2 * HOUR).alias("r_to"))
    found = Seq(left, "l_id", "user_id").group_join(right, ("l_from", "l_to"), ("r_from", "r_to"), F.col("r_id"), ["r_id"])
    return found.select("user_id", "l_id", listed(F.col("matches")).alias("ids"))


@query(f"""WITH {NV}, m AS (SELECT *, (SELECT count(*) FROM nv t WHERE t.event_type = 'signup' AND t.user_id IS NOT DISTINCT FROM e.user_id AND t.us <= e.us) AS window_id FROM nv e WHERE event_type <> 'signup'),
k AS (SELECT user_id, count(*) AS k FROM nv WHERE event_type = 'signup' GROUP BY user_id) SELECT m.user_id, max(event_id) AS event_id FROM m JOIN k ON m.user_id IS NOT DISTINCT FROM k.user_id WHERE window_id < k GROUP BY m.user_id, window_id""")
def n_sample(spark, sf):
    rows = _unknown(spark, sf)
    ticks = rows.where("event_type = 'signup'").select("user_id", F.col("us").alias("at"))
    return Seq(rows.where("event_type <> 'signup'"), "event_id", "user_id").sample(ticks, "us", "at").df.select("user_id", "event_id")


@query(f"""WITH {NV}, f AS (SELECT user_id, min(event_id) AS at FROM nv WHERE v >= 95 GROUP BY user_id)
SELECT 0 AS source_index, nv.user_id, nv.event_id FROM nv LEFT JOIN f ON nv.user_id IS NOT DISTINCT FROM f.user_id WHERE f.at IS NULL OR nv.event_id < f.at
UNION ALL SELECT 1, nv.user_id, nv.event_id FROM nv JOIN f ON nv.user_id IS NOT DISTINCT FROM f.user_id WHERE event_type = 'signup'""")
def n_resume(spark, sf):
    rows = _unknown(spark, sf)
    found = Seq(rows, ("event_id", "v"), "user_id").on_error_resume(F.col("v") >= 95, rows.where("event_type = 'signup'"))
    return found.df.select("source_index", "user_id", "event_id")
