"""Sources, sinks, projections, filters, aggregates, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import collectors
from ..seq import Seq
from .registry import DAY, EV, by_user, events, kind, listed, query, read, whole


@query("SELECT 0::BIGINT AS ord, 42 AS value")
def src_just(spark: SparkSession, sf: str) -> DataFrame:
    return sources.just(spark, 42).df


@query("SELECT 1 AS value, 0::BIGINT AS ord WHERE false")
def src_empty(spark, sf):
    return sources.empty(spark).df


@query("SELECT true AS failed, true AS named")
def src_error(spark, sf):
    """Whether asking for the rows of an error fails, and with its message."""
    try:
        sources.error(spark, "no such luck").df.collect()
        message = None
    except Exception as error:
        message = str(error)
    return spark.range(1).select(F.lit(message is not None).alias("failed"), F.lit("no such luck" in (message or "")).alias("named"))


@query("SELECT i AS ord, (i + 5)::INTEGER AS value FROM range(1000) t(i)")
def src_range(spark, sf):
    return sources.range_(spark, 5, 1000).df


@query("SELECT ord::BIGINT AS ord, value FROM (VALUES (0, 3), (1, 1), (2, 2)) t(ord, value)")
def src_array(spark, sf):
    return sources.from_array(spark, 3, 1, 2).df


@query("SELECT ord::BIGINT AS ord, value FROM (VALUES (0, 9), (1, 8), (2, 7)) t(ord, value)")
def src_iterable(spark, sf):
    return sources.from_iterable(spark, iter([9, 8, 7])).df


@query("SELECT 0::BIGINT AS ord, 6 * 7 AS value")
def src_callable(spark, sf):
    return sources.from_callable(spark, lambda: 6 * 7).df


@query("SELECT r_regionkey, (i - 1)::INTEGER AS pos, ascii(substr(r_name, i::INTEGER, 1)) AS code FROM region, range(1, 100) t(i) WHERE i <= length(r_name)")
def src_characters(spark, sf):
    return sources.characters(F.col("r_name"), read(spark, sf, "region"), ("r_regionkey",)).df


@query("SELECT count(*) AS n FROM events")
def src_defer(spark, sf):
    build = sources.defer(lambda: whole(spark, sf))
    return build().count("n")


@query("SELECT count(*) AS n, true AS disposed FROM events")
def src_using(spark, sf):
    """A count over a resource that is gone before the query returns."""
    state = {"open": True}
    with sources.using(lambda: sf, lambda path: whole(spark, path), lambda _: state.update(open=False)) as seq:
        n = seq.df.count()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(not state["open"]).alias("disposed"))


@query("WITH RECURSIVE g(ord, value) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL SELECT ord + 1, value * 3 % 1009 FROM g WHERE ord < 40) SELECT * FROM g")
def src_generate(spark, sf):
    return sources.generate_sql(spark, "1L", "value * 3 % 1009", "ord < 40").df


@query("SELECT 1500::BIGINT AS ts, 0::BIGINT AS value")
def src_timer(spark, sf):
    return sources.timer(spark, 1000, 500).df


@query(f"WITH {EV}, b AS (SELECT min(us) AS a, max(us) AS z FROM ev) SELECT a + {DAY} + i * {DAY} AS ts, i AS value FROM b, range(0, 100000) t(i) WHERE a + {DAY} + i * {DAY} <= z")
def src_interval(spark, sf):
    first, last = events(spark, sf).agg(F.min("us"), F.max("us")).first()
    return sources.interval(spark, first, last, DAY).df


@query("SELECT o_orderkey, o_custkey FROM orders")
def src_wrap(spark, sf):
    return sources.wrap(read(spark, sf, "orders"), "o_orderkey").df.select("o_orderkey", "o_custkey")


@query(f"WITH {EV} SELECT * FROM ev ORDER BY event_id LIMIT 1")
def k_first(spark, sf):
    return whole(spark, sf).first_row()


@query(f"WITH {EV} SELECT * FROM ev ORDER BY event_id DESC LIMIT 1")
def k_last(spark, sf):
    return whole(spark, sf).last_row()


@query(f"WITH {EV} SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM ev WHERE event_type = 'click'")
def k_to_iterable(spark, sf):
    """Rows pulled in order on the driver."""
    n = total = 0
    for row in Seq(kind(spark, sf, "click").select("event_id"), "event_id").to_iterable():
        n, total = n + 1, total + row["event_id"]
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("total"))


@query("SELECT max(event_id) AS event_id FROM events")
def k_future(spark, sf):
    last = whole(spark, sf).to_future().result()
    return spark.range(1).select(F.lit(last["event_id"]).cast("long").alias("event_id"))


@query("SELECT user_id, event_id, upper(event_type) AS kind, event_id * 2 AS doubled FROM events")
def p_map(spark, sf):
    return by_user(spark, sf).map(kind=F.upper("event_type"), doubled=F.col("event_id") * 2).df


@query("SELECT user_id, event_id, unnest(string_split(event_type, '_')) AS word FROM events")
def p_flatmap(spark, sf):
    return by_user(spark, sf).flat_map(F.split("event_type", "_"), "word").df


@query("SELECT user_id, event_id, i::INTEGER AS pos, event_id * 10 + i AS value FROM events, range(3) t(i)")
def p_concatmap(spark, sf):
    return by_user(spark, sf).concat_map(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("event_id") * 10 + i)).df


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders)
SELECT o_custkey, o_orderkey, i::INTEGER AS pos, string_split(o_orderpriority, '-')[i + 1] AS value FROM n, range(9) t(i) WHERE i < len(string_split(o_orderpriority, '-'))""")
def p_flatmap_iterable(spark, sf):
    return Seq(read(spark, sf, "orders"), "o_orderkey", "o_custkey").flat_map_iterable(F.split("o_orderpriority", "-")).df


@query(f"""WITH {EV}, o AS (SELECT user_id, us AS at, event_id AS opened, lead(us) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM ev WHERE event_type = 'signup')
SELECT o.user_id, o.opened, i.event_id AS inner_id FROM o JOIN ev i ON i.user_id = o.user_id AND i.event_type = 'click' AND i.us >= o.at AND (o.until IS NULL OR i.us < o.until)""")
def p_switchmap(spark, sf):
    outer = Seq(kind(spark, sf, "signup").select("event_id", "user_id", F.col("us").alias("at"), F.col("event_id").alias("opened")), "event_id", "user_id")
    inner = kind(spark, sf, "click").select("user_id", F.col("us").alias("us"), F.col("event_id").alias("inner_id"))
    return outer.switch_map(inner, "at", "us").df.select("user_id", "opened", "inner_id")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def p_lift(spark, sf):
    """A user's operator, lifted: each user's kinds of event, numbered anew."""
    kinds = lambda df: df.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.min("event_id").alias("event_id"))
    return by_user(spark, sf).lift(kinds).df.drop("event_id")


@query(f"WITH {EV} SELECT * FROM ev WHERE v % 2 = 0 AND event_type = 'view'")
def f_filter(spark, sf):
    return by_user(spark, sf).filter((F.col("v") % 2 == 0) & (F.col("event_type") == "view")).df


def _ranked(test: str, descending: bool = False) -> str:
    return f"WITH {EV} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {'DESC' if descending else ''}) AS rn FROM ev) WHERE {test}"


@query(_ranked("rn <= 3"))
def f_take(spark, sf):
    return by_user(spark, sf).take(3).df


@query(_ranked("rn <= 3", True))
def f_take_last(spark, sf):
    return by_user(spark, sf).take_last(3).df


@query(_ranked("rn > 5"))
def f_skip(spark, sf):
    return by_user(spark, sf).skip(5).df


@query(_ranked("rn > 5", True))
def f_skip_last(spark, sf):
    return by_user(spark, sf).skip_last(5).df


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 500")
def f_skip_whole(spark, sf):
    """Without a key: numbered by ranges, not in one partition."""
    return whole(spark, sf).skip(500).df.select("event_id")


def _flagged(test: str, keep: str, frame: str = "CURRENT ROW") -> str:
    return f"WITH {EV} SELECT * EXCLUDE hit FROM (SELECT *, coalesce(max(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}), 0) AS hit FROM ev) WHERE {keep}"


@query(_flagged("NOT (event_type <> 'purchase')", "hit = 0"))
def f_take_while(spark, sf):
    return by_user(spark, sf).take_while(F.col("event_type") != "purchase").df


@query(_flagged("event_type = 'purchase'", "hit = 0", "1 PRECEDING"))
def f_take_until_pred(spark, sf):
    return by_user(spark, sf).take_until(F.col("event_type") == "purchase").df


@query(_flagged("NOT (event_type <> 'purchase')", "hit = 1"))
def f_skip_while(spark, sf):
    return by_user(spark, sf).skip_while(F.col("event_type") != "purchase").df


@query(f"WITH {EV}, g AS (SELECT user_id, min(us) AS gate FROM ev WHERE event_type = 'signup' GROUP BY user_id) SELECT ev.* FROM ev LEFT JOIN g USING (user_id) WHERE gate IS NULL OR us < gate")
def f_take_until_other(spark, sf):
    return by_user(spark, sf).take_until_other(kind(spark, sf, "signup").select("user_id", F.col("us").alias("at")), "us", "at").df


@query(f"WITH {EV}, g AS (SELECT user_id, min(us) AS gate FROM ev WHERE event_type = 'signup' GROUP BY user_id) SELECT ev.* FROM ev JOIN g USING (user_id) WHERE us >= gate")
def f_skip_until_other(spark, sf):
    return by_user(spark, sf).skip_until_other(kind(spark, sf, "signup").select("user_id", F.col("us").alias("at")), "us", "at").df


@query(_ranked("rn = 5"))
def f_element_at(spark, sf):
    return by_user(spark, sf).element_at(4).df


@query(_ranked("rn = 1"))
def f_next(spark, sf):
    return by_user(spark, sf).next().df


@query(f"WITH {EV} SELECT * FROM ev WHERE event_id = 77")
def f_single(spark, sf):
    return whole(spark, sf).filter(F.col("event_id") == 77).single()


@query(f"WITH {EV} SELECT * FROM ev WHERE false")
def f_ignore(spark, sf):
    return by_user(spark, sf).ignore_elements().df


@query(f"WITH {EV} SELECT user_id, bool_and(v < 90) AS cheap FROM ev GROUP BY user_id")
def f_all(spark, sf):
    return by_user(spark, sf).all(F.col("v") < 90, "cheap")


@query(f"WITH {EV} SELECT user_id, bool_or(event_type = 'signup') AS has_signup FROM ev GROUP BY user_id")
def f_any(spark, sf):
    return by_user(spark, sf).any(F.col("event_type") == "signup", "has_signup")


@query("SELECT coalesce(bool_or(event_type = 'purchase'), false) AS found FROM events")
def f_exists(spark, sf):
    return whole(spark, sf).exists("event_type", "purchase", "found")


@query("SELECT count(*) > 0 AS has_elements FROM events WHERE user_id < 0")
def f_has_elements(spark, sf):
    return whole(spark, sf).filter(F.col("user_id") < 0).has_elements()


@query("SELECT -1::BIGINT AS event_id, 'none' AS event_type")
def f_default_if_empty(spark, sf):
    return Seq(events(spark, sf).where("user_id < 0").select("event_id", "event_type"), "event_id").default_if_empty({"event_id": -1, "event_type": "none"}).df


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def f_switch_if_empty(spark, sf):
    other = kind(spark, sf, "click").select("event_id", "event_type")
    return Seq(events(spark, sf).where("user_id < 0").select("event_id", "event_type"), "event_id").switch_if_empty(other).df


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def a_count(spark, sf):
    return by_user(spark, sf).count("n")


@query(f"WITH {EV}, s AS (SELECT user_id, sum(v * 100000007)::HUGEINT AS s FROM ev GROUP BY user_id), m AS (SELECT user_id, ((s % 4294967296) + 4294967296) % 4294967296 AS m FROM s) SELECT user_id, (CASE WHEN m >= 2147483648 THEN m - 4294967296 ELSE m END)::INTEGER AS total FROM m")
def a_sum_int(spark, sf):
    return by_user(spark, sf).sum_int(F.col("v") * 100000007, "total")


@query("SELECT o_custkey, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY o_custkey")
def a_sum_long(spark, sf):
    return Seq(read(spark, sf, "orders"), "o_orderkey", "o_custkey").sum_long(F.col("o_orderkey"), "total")


@query(f"WITH {EV} SELECT user_id, min(v) AS low FROM ev GROUP BY user_id")
def a_min(spark, sf):
    return by_user(spark, sf).min(F.col("v"), "low")


@query(f"WITH {EV} SELECT user_id, max(v) AS high FROM ev GROUP BY user_id")
def a_max(spark, sf):
    return by_user(spark, sf).max(F.col("v"), "high")


_FOLD = """WITH RECURSIVE {ev}, n AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev),
f(user_id, i, acc) AS ({start} UNION ALL SELECT f.user_id, n.i, (f.acc * 31 + n.v) % 1000003 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, max_by(acc, i) AS result FROM f GROUP BY user_id"""


@query(_FOLD.format(ev=EV, start="SELECT user_id, i, v FROM n WHERE i = 1"))
def a_reduce(spark, sf):
    return by_user(spark, sf).reduce(F.col("v"), lambda a, x: (a * 31 + x) % 1000003)


@query(_FOLD.format(ev=EV, start="SELECT DISTINCT user_id, 0::BIGINT, 7::BIGINT FROM n"))
def a_reduce_seed(spark, sf):
    return by_user(spark, sf).reduce(F.col("v"), lambda a, x: (a * 31 + x) % 1000003, seed=F.lit(7).cast("long"))


@query(f"WITH {EV} SELECT user_id, count(*) AS n, sum(v)::BIGINT AS total, max(us) AS latest FROM ev GROUP BY user_id")
def a_collect(spark, sf):
    found = by_user(spark, sf).collect("c", n=F.count("*"), total=F.sum("v"), latest=F.max("us"))
    return found.select("user_id", "c.*")


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def a_to_list(spark, sf):
    found = by_user(spark, sf).to_list(F.col("event_id"))
    return found.select("user_id", listed(F.col("list")).alias("ids"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS path FROM events GROUP BY user_id")
def a_collector_joining(spark, sf):
    return by_user(spark, sf).collect_with("path", x=collectors.joining(F.col("event_type"), ["event_id"], "|"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def a_collector_to_set(spark, sf):
    found = by_user(spark, sf).collect_with("s", x=collectors.to_set(F.col("event_type")))
    return found.select("user_id", listed(F.col("s")).alias("kinds"))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, sum(v)::BIGINT AS total, round(avg(v), 6) AS mean FROM ev GROUP BY event_type")
def a_collector_grouping(spark, sf):
    return Seq(events(spark, sf), "event_id", "event_type").collect_with(n=collectors.counting(), total=collectors.summing("v"), mean=F.round(collectors.averaging("v"), 6))


@query(f"WITH {EV} SELECT user_id, count(*) FILTER (v < 50) AS low, count(*) FILTER (NOT (v < 50)) AS high FROM ev GROUP BY user_id")
def a_collector_partitioning(spark, sf):
    found = by_user(spark, sf).collect_with("m", x=collectors.partitioning(F.col("v") < 50))
    return found.select("user_id", F.col("m")[True].alias("low"), F.col("m")[False].alias("high"))


@query(f"WITH {EV}, n AS (SELECT user_id, row_number() OVER w AS pos, (5 + sum(v) OVER w)::BIGINT AS acc FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT * FROM n UNION ALL SELECT DISTINCT user_id, 0::BIGINT, 5::BIGINT FROM ev")
def r_scan_sum(spark, sf):
    return by_user(spark, sf).scan("sum", F.col("v"), 5).df


@query("""WITH RECURSIVE """ + EV + """, n AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev),
f(user_id, pos, acc) AS (SELECT DISTINCT user_id, 0::BIGINT, 1::BIGINT FROM n UNION ALL SELECT f.user_id, n.i, (f.acc * 7 + n.v) % 10007 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.pos + 1) SELECT * FROM f""")
def r_scan_fold(spark, sf):
    return by_user(spark, sf).scan_fold(F.col("v"), F.lit(1).cast("long"), lambda a, x: (a * 7 + x) % 10007).df


@query(f"WITH {EV} SELECT *, (sum(v) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS acc FROM ev")
def r_accumulate_sum(spark, sf):
    return by_user(spark, sf).accumulate("sum", F.col("v")).df


@query(f"WITH {EV} SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id) AS acc FROM ev")
def r_accumulate_max(spark, sf):
    return by_user(spark, sf).accumulate("max", F.col("v")).df


@query(f"WITH {EV} SELECT event_id, (sum(v) OVER (ORDER BY event_id))::BIGINT AS acc FROM ev")
def r_accumulate_whole(spark, sf):
    """Without a key: a running total by ranges with carried sums, no single partition."""
    return whole(spark, sf).accumulate("sum", F.col("v")).df.select("event_id", "acc")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def r_distinct(spark, sf):
    return read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").dropDuplicates()


@query(f"WITH {EV} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM ev) WHERE rn = 1")
def r_distinct_key(spark, sf):
    return by_user(spark, sf).distinct("event_type").df


@query(f"WITH {EV} SELECT * EXCLUDE before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM ev) WHERE event_type IS DISTINCT FROM before")
def r_distinct_until_changed(spark, sf):
    return by_user(spark, sf).distinct_until_changed("event_type").df
