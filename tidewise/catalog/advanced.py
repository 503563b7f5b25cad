"""Joins, windows, timed operators, errors, multicast, rails, and the flagship."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators.errors import retry, retry_when
from ..operators.parallel import from_sequences
from ..seq import Seq
from .registry import DAY, EV, HOUR, by_user, events, kind, listed, query, read, whole

WEEK = 7 * DAY


@query(f"""WITH {EV}, c AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev) WHERE event_type IS DISTINCT FROM p),
d AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM c) SELECT event_type, count(*) AS n FROM d WHERE nx IS NULL OR nx > us + {6 * HOUR} GROUP BY event_type""")
def flagship(spark, sf):
    settled = by_user(spark, sf).distinct_until_changed("event_type").debounce("us", 6 * HOUR)
    return Seq(settled.df, "event_id").group_by("event_type").count("n")


@query("SELECT 0 AS source_index, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'click'")
def j_concat(spark, sf):
    a, b = kind(spark, sf, "click"), kind(spark, sf, "purchase")
    return Seq(a, "event_id").concat_with(b, a).df.select("source_index", "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE event_type <> 'view'")
def j_merge(spark, sf):
    return Seq(kind(spark, sf, "click"), "event_id").merge_with(events(spark, sf).where("event_type <> 'view'")).df.select("event_id")


@query(f"""WITH {EV}, w AS (SELECT user_id, arg_min(event_type, event_id) AS first_type FROM ev WHERE event_type IN ('click', 'purchase') GROUP BY user_id)
SELECT ev.* FROM ev JOIN w ON w.user_id = ev.user_id AND w.first_type = ev.event_type""")
def j_amb(spark, sf):
    return Seq(kind(spark, sf, "click"), "event_id", "user_id").amb_with(kind(spark, sf, "purchase"), time="us").df


def _numbered(name: str, where: str, partition: str = "PARTITION BY user_id ") -> str:
    return f"{name} AS (SELECT *, row_number() OVER ({partition}ORDER BY event_id) - 1 AS place FROM ev WHERE event_type = '{where}')"


@query(f"WITH {EV}, {_numbered('a', 'click')}, {_numbered('b', 'purchase')} SELECT a.user_id, a.place, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b USING (user_id, place)")
def j_zip(spark, sf):
    a, b = (Seq(kind(spark, sf, n).select("event_id", "user_id"), "event_id", "user_id") for n in ("click", "purchase"))
    return a.zip_with(b).df.select("user_id", "place", F.col("event_id").alias("left_id"), F.col("event_id_2").alias("right_id"))


@query(f"WITH {EV}, {_numbered('a', 'click', '')}, {_numbered('b', 'purchase', '')}, {_numbered('c', 'view', '')} SELECT place, a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM a JOIN b USING (place) JOIN c USING (place)")
def j_zip3(spark, sf):
    a, b, c = (Seq(kind(spark, sf, n).select("event_id"), "event_id") for n in ("click", "purchase", "view"))
    return a.zip_with(b, c).df.select("place", F.col("event_id").alias("a_id"), F.col("event_id_2").alias("b_id"), F.col("event_id_3").alias("c_id"))


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM ev) SELECT event_id, place, ((place + 1) * 10)::BIGINT AS other FROM n WHERE place < 5")
def j_zip_iterable(spark, sf):
    return by_user(spark, sf).zip_with_values([10, 20, 30, 40, 50]).df.select("event_id", "place", "other")


@query(f"""WITH {EV}, u AS (SELECT * FROM ev WHERE event_type IN ('click', 'purchase')),
c AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN v END IGNORE NULLS) OVER w AS click_v, last_value(CASE WHEN event_type = 'purchase' THEN v END IGNORE NULLS) OVER w AS purchase_v
FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT * FROM c WHERE click_v IS NOT NULL AND purchase_v IS NOT NULL""")
def j_combine_latest(spark, sf):
    parts = {n: kind(spark, sf, n).select("user_id", "event_id", "v") for n in ("click", "purchase")}
    found = Seq(parts["click"], "event_id", "user_id").combine_latest(parts)
    return found.df.select("user_id", "event_id", F.col("click.v").alias("click_v"), F.col("purchase.v").alias("purchase_v"))


@query(f"""WITH {EV} SELECT a.user_id, a.event_id, b.event_id AS latest_id FROM ev a ASOF JOIN (SELECT * FROM ev WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.event_id >= b.event_id WHERE a.event_type = 'click'""")
def j_with_latest_from(spark, sf):
    main, other = kind(spark, sf, "click"), kind(spark, sf, "signup").select("user_id", "event_id")
    return Seq(main, "event_id", "user_id").with_latest_from(other).df.select("user_id", "event_id", F.col("latest.event_id").alias("latest_id"))


def _spans(spark, sf, name: str, prefix: str, length: int):
    return kind(spark, sf, name).select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("us").alias(f"{prefix}_from"), (F.col("us") + length).alias(f"{prefix}_to"))


@query(f"WITH {EV} SELECT l.user_id, l.event_id AS l_id, r.event_id AS r_id FROM ev l JOIN ev r ON l.user_id = r.user_id AND l.us < r.us + {2 * DAY} AND r.us < l.us + {DAY} WHERE l.event_type = 'click' AND r.event_type = 'purchase'")
def j_interval_join(spark, sf):
    left, right = _spans(spark, sf, "click", "l", DAY), _spans(spark, sf, "purchase", "r", 2 * DAY)
    return Seq(left, "l_id", "user_id").join_overlapping(right, ("l_from", "l_to"), ("r_from", "r_to")).select("user_id", "l_id", "r_id")


@query(f"WITH {EV} SELECT l.event_id AS l_id, r.event_id AS r_id FROM ev l JOIN ev r ON l.us < r.us + {2 * HOUR} AND r.us < l.us + {HOUR} WHERE l.event_type = 'click' AND r.event_type = 'purchase'")
def j_interval_join_whole(spark, sf):
    """Without a key: by time cells, not by comparing all pairs."""
    left, right = _spans(spark, sf, "click", "l", HOUR), _spans(spark, sf, "purchase", "r", 2 * HOUR).drop("user_id")
    return Seq(left, "l_id").join_overlapping(right, ("l_from", "l_to"), ("r_from", "r_to")).select("l_id", "r_id")


@query(f"""WITH {EV} SELECT l.event_id AS l_id, coalesce(string_agg(r.event_id::VARCHAR, ',' ORDER BY r.event_id), '') AS ids FROM ev l LEFT JOIN ev r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND l.us < r.us + {2 * DAY} AND r.us < l.us + {DAY} WHERE l.event_type = 'click' GROUP BY l.event_id""")
def j_group_join(spark, sf):
    left, right = _spans(spark, sf, "click", "l", DAY), _spans(spark, sf, "purchase", "r", 2 * DAY)
    found = Seq(left, "l_id", "user_id").group_join(right, ("l_from", "l_to"), ("r_from", "r_to"), F.col("r_id"), ["r_id"])
    return found.select("l_id", listed(F.col("matches")).alias("ids"))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, min(event_id) AS first_id, sum(v)::BIGINT AS total FROM ev GROUP BY event_type")
def w_group_by(spark, sf):
    return whole(spark, sf).group_by("event_type").df.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("v").alias("total"))


@query(f"WITH {EV} SELECT user_id, string_agg((-v)::VARCHAR, ',' ORDER BY event_id) AS negated FROM ev GROUP BY user_id")
def w_group_by_value(spark, sf):
    found = whole(spark, sf).group_by("user_id", strict=True, negated=-F.col("v")).to_list(F.col("negated"))
    return found.select("user_id", listed(F.col("list")).alias("negated"))


_R = f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM ev)"


def _buffers(size: int, skip: int, columns: str) -> str:
    return f"""{_R}, g AS (SELECT user_id, unnest(range(0, max(i) + 1, {skip})) AS s FROM r GROUP BY user_id)
SELECT g.user_id, (s // {skip})::BIGINT AS window_id, {columns} FROM g JOIN r ON r.user_id = g.user_id AND i >= s AND i < s + {size} GROUP BY g.user_id, s"""


IDS = "string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids"


def _ids(buffers):
    keep = [c for c in ("user_id", "window_id", "part") if c in buffers.columns]
    return buffers.select(*keep, listed(F.col("buffer")).alias("ids"))


@query(_buffers(4, 4, IDS))
def w_buffer_exact(spark, sf):
    return _ids(by_user(spark, sf).buffer(4, value=F.col("event_id")))


@query(_buffers(2, 5, IDS))
def w_buffer_skip(spark, sf):
    return _ids(by_user(spark, sf).buffer(2, 5, F.col("event_id")))


@query(_buffers(5, 2, IDS))
def w_buffer_overlap(spark, sf):
    return _ids(by_user(spark, sf).buffer(5, 2, F.col("event_id")))


SUMS = "count(*) AS n, sum(v)::BIGINT AS total"


def _sums(windows):
    return windows.df.groupBy(*windows.key).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(_buffers(6, 6, SUMS))
def w_window_exact(spark, sf):
    return _sums(by_user(spark, sf).window(6))


@query(_buffers(3, 7, SUMS))
def w_window_skip(spark, sf):
    return _sums(by_user(spark, sf).window(3, 7))


@query(_buffers(7, 3, SUMS))
def w_window_overlap(spark, sf):
    return _sums(by_user(spark, sf).window(7, 3))


@query(f"WITH {EV}, r AS (SELECT v, row_number() OVER (ORDER BY event_id) - 1 AS i FROM ev) SELECT (i // 100)::BIGINT AS window_id, {SUMS} FROM r GROUP BY ALL")
def w_window_whole(spark, sf):
    """Without a key: windows of 100 rows over the whole table."""
    return _sums(whole(spark, sf).window(100))


def _ticks(spark, sf):
    """Signups as the ticks of each user."""
    return kind(spark, sf, "signup").select("user_id", F.col("us").alias("at"))


def _main(spark, sf):
    return Seq(events(spark, sf).where("event_type <> 'signup'"), "event_id", "user_id")


_T = f"""WITH {EV}, m AS (SELECT e.*, (SELECT count(*) FROM ev t WHERE t.event_type = 'signup' AND t.user_id = e.user_id AND t.us <= e.us) AS window_id FROM ev e WHERE event_type <> 'signup'),
k AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS k FROM ev GROUP BY user_id)"""


@query(f"""{_T}, every AS (SELECT user_id, unnest(range(0, k)) AS window_id FROM k UNION SELECT user_id, window_id FROM m)
SELECT e.user_id, e.window_id, coalesce(string_agg(m.event_id::VARCHAR, ',' ORDER BY m.event_id), '') AS ids FROM every e LEFT JOIN m USING (user_id, window_id) GROUP BY ALL""")
def w_buffer_boundary(spark, sf):
    return _ids(_main(spark, sf).buffer_boundary(_ticks(spark, sf), "us", "at", F.col("event_id")))


@query(f"""{_T}, every AS (SELECT user_id, unnest(range(0, k + 1)) AS window_id FROM k)
SELECT e.user_id, e.window_id, coalesce(string_agg(m.event_id::VARCHAR, ',' ORDER BY m.event_id), '') AS ids FROM every e LEFT JOIN m USING (user_id, window_id) GROUP BY ALL""")
def w_window_boundary(spark, sf):
    return _ids(_main(spark, sf).windows_boundary(_ticks(spark, sf), "us", "at", F.col("event_id")))


_P = f"{_T}, p AS (SELECT *, ((row_number() OVER (PARTITION BY user_id, window_id ORDER BY event_id) - 1) // 3)::BIGINT AS part FROM m), n AS (SELECT user_id, window_id, count(*) AS n FROM m GROUP BY ALL)"


@query(f"""{_P}, every AS (SELECT user_id, window_id, part FROM p UNION SELECT k.user_id, k.k, coalesce(n.n, 0) // 3 FROM k LEFT JOIN n ON n.user_id = k.user_id AND n.window_id = k.k WHERE coalesce(n.n, 0) % 3 = 0)
SELECT e.user_id, e.window_id, e.part, coalesce(string_agg(p.event_id::VARCHAR, ',' ORDER BY p.event_id), '') AS ids FROM every e LEFT JOIN p USING (user_id, window_id, part) GROUP BY ALL""")
def w_buffer_boundary_size(spark, sf):
    return _ids(_main(spark, sf).buffer_boundary_size(_ticks(spark, sf), "us", "at", 3, F.col("event_id")))


@query(f"""{_P}, w AS (SELECT user_id, unnest(range(0, k + 1)) AS window_id FROM k), every AS (SELECT w.user_id, w.window_id, unnest(range(0, coalesce(n.n, 0) // 3 + 1)) AS part FROM w LEFT JOIN n USING (user_id, window_id))
SELECT e.user_id, e.window_id, e.part, coalesce(string_agg(p.event_id::VARCHAR, ',' ORDER BY p.event_id), '') AS ids FROM every e LEFT JOIN p USING (user_id, window_id, part) GROUP BY ALL""")
def w_window_boundary_size(spark, sf):
    return _ids(_main(spark, sf).windows_boundary_size(_ticks(spark, sf), "us", "at", 3, F.col("event_id")))


@query(f"{_P} SELECT user_id, window_id, part, {SUMS} FROM p GROUP BY user_id, window_id, part")
def w_window_boundary_size_nonempty(spark, sf):
    return _sums(_main(spark, sf).window_boundary_size(_ticks(spark, sf), "us", "at", 3))


@query(f"""WITH {EV} SELECT s.user_id, s.event_id AS window_id, coalesce(string_agg(e.event_id::VARCHAR, ',' ORDER BY e.event_id), '') AS ids FROM ev s LEFT JOIN ev e ON e.user_id = s.user_id AND e.us >= s.us AND e.us < s.us + {5 * DAY} AND e.event_type <> 'signup' WHERE s.event_type = 'signup' GROUP BY ALL""")
def w_buffer_start_end(spark, sf):
    spans = kind(spark, sf, "signup").select("user_id", "event_id", F.col("us").alias("s"), (F.col("us") + 5 * DAY).alias("e"))
    return _ids(_main(spark, sf).buffer_start_end(spans, "us", "s", "e", "event_id", F.col("event_id")))


@query(f"""WITH {EV} SELECT s.user_id, s.event_id AS window_id, count(*) AS n, sum(e.v)::BIGINT AS total FROM ev s JOIN ev e ON e.user_id = s.user_id AND e.us >= s.us AND e.us < s.us + {5 * DAY} AND e.event_type <> 'signup' WHERE s.event_type = 'signup' GROUP BY ALL""")
def w_window_start_end(spark, sf):
    spans = kind(spark, sf, "signup").select("user_id", "event_id", F.col("us").alias("s"), (F.col("us") + 5 * DAY).alias("e"))
    return _sums(_main(spark, sf).window_start_end(spans, "us", "s", "e", "event_id"))


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, min(us) OVER (PARTITION BY user_id) AS opened FROM ev),
f(user_id, i, event_id, o, n, w) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, min(opened), 0::BIGINT, -1::BIGINT FROM n GROUP BY user_id
UNION ALL SELECT f.user_id, n.i, n.event_id,
 CASE WHEN (CASE WHEN n.us >= f.o + {WEEK} THEN 0 ELSE f.n END) + 1 = 4 THEN n.us WHEN n.us >= f.o + {WEEK} THEN f.o + ((n.us - f.o) // {WEEK}) * {WEEK} ELSE f.o END,
 ((CASE WHEN n.us >= f.o + {WEEK} THEN 0 ELSE f.n END) + 1) % 4,
 CASE WHEN n.us >= f.o + {WEEK} OR f.n = 0 THEN f.w + 1 ELSE f.w END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, w AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM f WHERE i > 0 GROUP BY ALL""")
def w_window_batch(spark, sf):
    return _ids(by_user(spark, sf).window_batch("us", WEEK, 4).gathered(F.col("event_id")))


@query(f"{_T} SELECT m.user_id, m.window_id, max(event_id) AS event_id FROM m JOIN k USING (user_id) WHERE m.window_id < k.k GROUP BY ALL")
def t_sample(spark, sf):
    seq = _main(spark, sf)
    ticked = seq.with_df(seq._ticked(_ticks(spark, sf), "us", "at"))
    kept = seq.sample(_ticks(spark, sf), "us", "at").df.select("event_id")
    return ticked.df.join(kept, "event_id", "left_semi").select("user_id", "window_id", "event_id")


@query(f"""WITH RECURSIVE {EV}, f(user_id, event_id, us) AS (SELECT user_id, min(event_id), min(us) FROM ev GROUP BY user_id
UNION ALL SELECT user_id, event_id, us FROM (SELECT f.user_id, ev.event_id, ev.us, row_number() OVER (PARTITION BY f.user_id ORDER BY ev.event_id) AS rn FROM f JOIN ev ON ev.user_id = f.user_id AND ev.us >= f.us + {12 * HOUR}) WHERE rn = 1) SELECT user_id, event_id FROM f""")
def t_throttle_first(spark, sf):
    return by_user(spark, sf).throttle_first("us", 12 * HOUR).df.select("user_id", "event_id")


_NEXT = f"WITH {EV}, n AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY event_id) AS nx, lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS pv FROM ev)"


@query(f"{_NEXT} SELECT user_id, event_id FROM n WHERE nx IS NULL OR nx > us + {6 * HOUR}")
def t_debounce(spark, sf):
    return by_user(spark, sf).throttle_timeout("us", 6 * HOUR).df.select("user_id", "event_id")


_LATE = f"{_NEXT}, l AS (SELECT *, coalesce(max(CASE WHEN us > pv + {2 * DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS late FROM n)"


@query(f"{_LATE} SELECT user_id, event_id FROM l WHERE late = 0")
def t_timeout(spark, sf):
    return by_user(spark, sf).timeout("us", 2 * DAY).df.select("user_id", "event_id")


@query(f"{_LATE} SELECT 0 AS source_index, user_id, event_id FROM l WHERE late = 0 UNION ALL SELECT 1, user_id, event_id FROM l x WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM l y WHERE y.user_id = x.user_id AND y.late = 1)")
def t_timeout_fallback(spark, sf):
    return by_user(spark, sf).timeout_fallback("us", 2 * DAY, kind(spark, sf, "signup")).df.select("source_index", "user_id", "event_id")


@query(f"WITH {EV}, g AS (SELECT min(us) AS gate FROM ev WHERE event_type = 'purchase') SELECT event_id FROM ev, g WHERE us >= gate")
def t_delay_subscription(spark, sf):
    return whole(spark, sf).delay_subscription(kind(spark, sf, "purchase").select(F.col("us").alias("at")), "us", "at").df.select("event_id")


_FAIL = f"WITH {EV}, l AS (SELECT *, max(CASE WHEN v >= 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS failed, coalesce(max(CASE WHEN v >= 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ev)"


@query(f"{_FAIL} SELECT 0 AS source_index, user_id, event_id FROM l WHERE failed = 0 UNION ALL SELECT 1, user_id, event_id FROM l x WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM l y WHERE y.user_id = x.user_id AND y.failed = 1)")
def e_resume(spark, sf):
    return by_user(spark, sf).on_error_resume(F.col("v") >= 95, kind(spark, sf, "signup")).df.select("source_index", "user_id", "event_id")


@query(f"{_FAIL} SELECT user_id, event_id, v FROM l WHERE failed = 0 UNION ALL SELECT user_id, event_id, -1 FROM l WHERE failed = 1 AND before = 0")
def e_return(spark, sf):
    return by_user(spark, sf).on_error_return(F.col("v") >= 95, v=-1).df.select("user_id", "event_id", "v")


@query("SELECT 3::BIGINT AS attempts, count(*) AS n FROM events")
def e_retry(spark, sf):
    """An action that fails twice before it is let through."""
    attempts = []

    def action():
        attempts.append(1)
        if len(attempts) < 3:
            raise RuntimeError("not yet")
        return whole(spark, sf).df.count()

    n = retry(action, 5)
    return spark.range(1).select(F.lit(len(attempts)).cast("long").alias("attempts"), F.lit(n).cast("long").alias("n"))


@query("SELECT 2::BIGINT AS attempts, count(*) AS n FROM orders")
def e_retry_when(spark, sf):
    attempts = []

    def action():
        attempts.append(1)
        if len(attempts) < 2:
            raise RuntimeError("not yet")
        return read(spark, sf, "orders").count()

    n = retry_when(action, lambda attempt, error: 0.01 if attempt < 3 else None)
    return spark.range(1).select(F.lit(len(attempts)).cast("long").alias("attempts"), F.lit(n).cast("long").alias("n"))


@query("SELECT copy, n_nationkey FROM nation, range(1, 4) t(copy)")
def e_repeat(spark, sf):
    return Seq(read(spark, sf, "nation").select("n_nationkey"), "n_nationkey").repeat(3).df


@query("SELECT copy, r_regionkey FROM region, range(1, 4) t(copy)")
def e_repeat_when(spark, sf):
    return Seq(read(spark, sf, "region").select("r_regionkey"), "r_regionkey").repeat_when(lambda counts: [c for _, c in zip(range(2), counts)]).df


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev) SELECT a.user_id, a.event_id, b.event_id AS next_id FROM n a JOIN n b ON a.user_id = b.user_id AND b.rn = a.rn + 1")
def m_publish_selector(spark, sf):
    return by_user(spark, sf).publish_select(lambda s: s.zip_with(s.skip(1))).df.select("user_id", "event_id", F.col("event_id_2").alias("next_id"))


@query("SELECT count(*) AS n, max(event_id) AS last_id FROM events")
def m_publish(spark, sf):
    """Two consumers of one shared copy."""
    shared = whole(spark, sf).publish()
    stop = shared.connect()
    try:
        n = shared.subscribe().df.count()
        last = shared.subscribe().blocking_last()["event_id"]
    finally:
        stop()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(last).cast("long").alias("last_id"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10")
def m_process(spark, sf):
    return whole(spark, sf).process(lambda df: df, selector=lambda s: s.replay_last(10)).df.select("event_id")


@query("SELECT true AS connected, count(*) AS n FROM events")
def m_auto_connect(spark, sf):
    shared = whole(spark, sf).publish()
    arrive = shared.auto_connect(2)
    arrive()
    early = shared.connected
    n = arrive().df.count()
    connected = shared.connected and not early
    shared.disconnect()
    return spark.range(1).select(F.lit(connected).alias("connected"), F.lit(n).cast("long").alias("n"))


@query("SELECT count(*) AS n, true AS released FROM events")
def m_ref_count(spark, sf):
    shared = whole(spark, sf).publish()
    with shared.ref_count() as seq:
        n = seq.df.count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(not shared.connected).alias("released"))


@query("SELECT user_id, event_id FROM events")
def m_replay_all(spark, sf):
    return by_user(spark, sf).replay_all().df.select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 4")
def m_replay_last_n(spark, sf):
    return by_user(spark, sf).replay_last(4).df.select("user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def m_async_last(spark, sf):
    return by_user(spark, sf).async_last().df.select("user_id", "event_id")


@query(f"{_T}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_id ORDER BY event_id) AS rn FROM m) SELECT user_id, event_id FROM n WHERE rn <= 2")
def b_drop(spark, sf):
    return _main(spark, sf).on_backpressure_drop(_ticks(spark, sf), "us", "at", 2).df.select("user_id", "event_id")


@query(f"{_T} SELECT user_id, max(event_id) AS event_id FROM m GROUP BY user_id, window_id")
def b_latest(spark, sf):
    return _main(spark, sf).on_backpressure_latest(_ticks(spark, sf), "us", "at").df.select("user_id", "event_id")


@query("SELECT count(*) AS n, max(event_id) AS last_id FROM events")
def b_observe(spark, sf):
    """Metrics tapped from the rows while something else runs."""
    tap = Observation("events")
    whole(spark, sf).do_on_next(tap, F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).drain()
    found = tap.get
    return spark.range(1).select(F.lit(found["n"]).cast("long").alias("n"), F.lit(found["last_id"]).cast("long").alias("last_id"))


_RAIL = "WITH r AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS rail, CAST(floor(value) AS BIGINT) AS v FROM events)"


@query(f"{_RAIL} SELECT rail, event_id FROM r")
def l_parallel(spark, sf):
    return whole(spark, sf).parallel(4).df.select("rail", "event_id")


@query("SELECT 0::BIGINT AS rail, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'purchase'")
def l_from_array(spark, sf):
    return from_sequences(*(Seq(kind(spark, sf, n), "event_id") for n in ("click", "purchase"))).df.select("rail", "event_id")


_BY = "WITH r AS (SELECT *, event_id % 4 AS rail, CAST(floor(value) AS BIGINT) AS v FROM events)"


def _rails(spark, sf):
    return whole(spark, sf).parallel(4, F.col("event_id") % 4)


@query(f"{_BY} SELECT event_id, rail, v * 2 AS doubled FROM r WHERE v > 20")
def l_map_filter(spark, sf):
    return _rails(spark, sf).filter(F.col("v") > 20).map(doubled=F.col("v") * 2).df


@query(f"{_BY} SELECT event_id, rail, v + i AS value FROM r, range(2) t(i)")
def l_flatmap(spark, sf):
    return _rails(spark, sf).flat_map(F.array(F.col("v"), F.col("v") + 1)).df


@query(f"{_BY} SELECT event_id, rail, i::INTEGER AS pos, v + i AS value FROM r, range(2) t(i)")
def l_concatmap(spark, sf):
    return _rails(spark, sf).concat_map(F.array(F.col("v"), F.col("v") + 1)).df


@query(f"{_BY} SELECT sum(v)::BIGINT AS result FROM r")
def l_reduce_full(spark, sf):
    return _rails(spark, sf).reduce(F.sum, F.col("v"))


@query(f"{_BY} SELECT i AS rail, (100 + coalesce(sum(v), 0))::BIGINT AS result FROM range(6) t(i) LEFT JOIN r ON r.rail = i GROUP BY i")
def l_reduce_rail(spark, sf):
    return whole(spark, sf).parallel(6, F.col("event_id") % 4).reduce_rails(F.sum, F.col("v"), 100, lambda seed, v: seed + v)


@query(f"{_BY} SELECT rail, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM r GROUP BY rail")
def l_collect(spark, sf):
    found = _rails(spark, sf).collect(F.col("event_id"))
    return found.select("rail", listed(F.col("list")).alias("ids"))


@query("SELECT event_id FROM events")
def l_sequential(spark, sf):
    return _rails(spark, sf).sequential().df.select("event_id")


@query(f"{_BY} SELECT event_id, v, row_number() OVER (ORDER BY v DESC, rail, event_id) AS place FROM r")
def l_sorted(spark, sf):
    """All rows in the order of the sort, each with its place."""
    rows = _rails(spark, sf).sorted(F.col("v").desc())
    placed = Seq(rows.withColumn("down", -F.col("v")), ("down", "rail", "event_id")).numbered("place")
    return placed.df.select("event_id", "v", (F.col("place") + 1).alias("place")).orderBy("place")


@query(f"{_BY} SELECT string_agg(v::VARCHAR, ',' ORDER BY v) AS vs FROM r")
def l_to_sorted_list(spark, sf):
    found = _rails(spark, sf).to_sorted_list(F.col("v"))
    return found.select(listed(F.col("list")).alias("vs"))


@query(f"{_BY} SELECT rail, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY rail")
def l_groups(spark, sf):
    groups = _rails(spark, sf).groups()
    return groups.df.groupBy(*groups.key).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"{_BY} SELECT rail, event_id, row_number() OVER (PARTITION BY rail ORDER BY event_id) - 1 AS index FROM r")
def l_ordered(spark, sf):
    return _rails(spark, sf).ordered().df.select("rail", "event_id", "index")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS index FROM events")
def l_ordered_whole(spark, sf):
    return _rails(spark, sf).ordered(whole=True).df.select("event_id", "index")
