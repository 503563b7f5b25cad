"""Literal inputs and expected values of each operator, keyed and unkeyed."""

from random import Random

import pytest
from pyspark.sql import functions as F

from tidewise import Seq, sources
from tidewise.functions import collectors, wrap32
from tidewise.operators.combine import zip_all
from tidewise.operators.errors import retry, retry_when
from tidewise.operators.flow import tapped
from tidewise.operators.parallel import from_sequences

V = F.col("value")


def seq(spark, values):
    return sources.from_iterable(spark, values) if values else sources.empty(spark)


def script(spark, *rows, kinds="ts long, value int"):
    return Seq(spark.createDataFrame(list(rows), kinds), "ts")


def values(result, column="value"):
    if isinstance(result, Seq):
        result = result.df.orderBy(*result.order)
    return [r[column] for r in result.collect()]


def lists(buffers, *by):
    return [r["buffer"] for r in buffers.orderBy(*(by or ("window_id",))).collect()]


TEN = list(range(1, 11))


@pytest.mark.parametrize(
    ("operator", "given", "expected"),
    [
        (lambda s: s.take(3), TEN, [1, 2, 3]),
        (lambda s: s.take(0), TEN, []),
        (lambda s: s.take_last(1), TEN, [10]),
        (lambda s: s.take_last(5), TEN, [6, 7, 8, 9, 10]),
        (lambda s: s.skip(8), TEN, [9, 10]),
        (lambda s: s.skip_last(3), TEN, [1, 2, 3, 4, 5, 6, 7]),
        (lambda s: s.skip_last(0), TEN, TEN),
        (lambda s: s.take_while(V < 4), TEN[:5], [1, 2, 3]),
        (lambda s: s.take_until(V == 3), TEN[:5], [1, 2, 3]),
        (lambda s: s.skip_while(V < 3), TEN[:5], [3, 4, 5]),
        (lambda s: s.element_at(4), TEN, [5]),
        (lambda s: s.element_at(40, {"ord": 0, "value": -1}), TEN, [-1]),
        (lambda s: s.next(), TEN, [1]),
        (lambda s: s.filter(V % 2 == 0), TEN, [2, 4, 6, 8, 10]),
        (lambda s: s.ignore_elements(), TEN, []),
        (lambda s: s.default_if_empty({"ord": 0, "value": 9}), [], [9]),
        (lambda s: s.default_if_empty({"ord": 0, "value": 9}), [1], [1]),
        (lambda s: s.distinct_until_changed("value"), [1, 1, 2, 2, 1, 1, 2, 2, 1, 2, 3, 3], [1, 2, 1, 2, 1, 2, 3]),
        (lambda s: s.distinct("value"), [3, 1, 3, 2, 1], [3, 1, 2]),
        (lambda s: s.repeat(2), TEN[:5], TEN[:5] * 2),
        (lambda s: s.repeat(0), TEN[:5], []),
        (lambda s: s.concat_with(s.df), [1, 2], [1, 2, 1, 2]),
        (lambda s: s.map(value=V * 2), [1, 2], [2, 4]),
        (lambda s: s.flat_map_iterable(F.array(V, -V)), [1, 2], [1, -1, 2, -2]),
        (lambda s: s.hide(), [1, 2], [1, 2]),
        (lambda s: s.async_last(), TEN, [10]),
        (lambda s: s.replay_last(2), TEN, [9, 10]),
    ],
)
def test_sequence_to_sequence(spark, operator, given, expected):
    assert values(operator(seq(spark, given))) == expected


def test_scan_and_accumulate(spark):
    s = seq(spark, TEN)
    assert values(s.scan("last", V, 0), "acc") == [0, *TEN]
    assert values(s.scan("sum", V, 0), "acc") == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45, 55]
    assert values(s.accumulate("last", V, "acc"), "acc") == TEN
    assert values(s.accumulate("sum", V, "acc"), "acc")[-1] == 55
    assert values(s.scan_fold(V, F.lit(0), lambda a, x: x), "acc") == [0, *TEN]
    assert values(seq(spark, []).scan("sum", V, 7), "acc") == [7]


def test_aggregates_and_their_empty_cases(spark):
    ten, none = seq(spark, TEN), seq(spark, [])
    assert [r[0] for a in ("sum_int", "sum_long", "min", "max") for r in getattr(ten, a)(V).collect()] == [55, 55, 1, 10]
    assert [getattr(none, a)(V).collect() for a in ("sum_int", "sum_long", "min", "max")] == [[]] * 4
    assert none.count().first()[0] == 0
    assert none.reduce(V, lambda a, x: a + x).collect() == []
    assert none.reduce(V, lambda a, x: a + x, seed=F.lit(4)).first()[0] == 4
    assert ten.reduce(V, lambda a, x: x, seed=F.lit(0)).first()[0] == 10
    assert seq(spark, [5]).reduce(V, lambda a, x: a * x).first()[0] == 5
    assert (none.all(V > 1).first()[0], none.any(V > 1).first()[0], none.has_elements().first()[0]) == (True, False, False)
    assert (ten.all(V < 6).first()[0], ten.all(V < 60).first()[0], ten.exists("value", 3).first()[0], ten.is_empty().first()[0]) == (False, True, True, False)
    assert none.to_list(V).first()[0] == []
    assert ten.to_list(V).first()[0] == TEN
    assert ten.collect_with("j", x=collectors.joining(V.cast("string"), ["ord"], "-")).first()[0] == "1-2-3-4-5-6-7-8-9-10"


def test_sums_wrap(spark):
    s = seq(spark, [2**31 - 1, 1])
    assert s.sum_int(V).first()[0] == -(2**31)
    big = Seq(spark.createDataFrame([(0, 2**63 - 1), (1, 1)], "ord long, value long"), "ord")
    assert big.sum_long(V).first()[0] == -(2**63)
    assert spark.range(1).select(wrap32(F.lit(-1).cast("long"))).first()[0] == -1


def test_single(spark):
    assert seq(spark, [3]).single().first()["value"] == 3
    assert seq(spark, []).single({"value": 8}).first()["value"] == 8
    for bad in ([], [1, 2]):
        with pytest.raises(Exception, match="single"):
            seq(spark, bad).single().collect()
    with pytest.raises(Exception, match="too short"):
        seq(spark, [1]).element_at(3, strict=True).df.collect()


@pytest.mark.parametrize(("size", "skip", "expected"), [(2, 2, [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]]), (2, 3, [[1, 2], [4, 5], [7, 8], [10]]), (2, 1, [*([k, k + 1] for k in range(1, 10)), [10]]), (3, 1, [*([k, k + 1, k + 2] for k in range(1, 9)), [9, 10], [10]])])
def test_buffers_by_count(spark, size, skip, expected):
    assert lists(seq(spark, TEN).buffer(size, skip, V)) == expected


def ticks(spark, *times):
    return spark.createDataFrame([(t,) for t in times], "at long")


def test_buffers_by_ticks(spark):
    s = script(spark, (1, 1), (2, 2), (5, 3), (6, 4))
    assert lists(s.buffer_boundary(ticks(spark, 3, 4, 7), "ts", "at", V)) == [[1, 2], [], [3, 4]]
    assert lists(script(spark, (1, 1), (2, 2), (3, 3), (5, 4), (6, 5)).windows_boundary(ticks(spark, 4), "ts", "at", V)) == [[1, 2, 3], [4, 5]]
    ten = script(spark, *((t, v) for v, t in enumerate([1, 2, 4, 5, 6, 7, 9, 10, 11, 13], 1)))
    assert lists(ten.buffer_boundary_size(ticks(spark, 3, 8, 12, 14), "ts", "at", 3, V), "window_id", "part") == [[1, 2], [3, 4, 5], [6], [7, 8, 9], [10], []]
    eight = script(spark, *((t, v) for v, t in enumerate([1, 2, 3, 4, 5, 7, 8, 9], 1)))
    assert lists(eight.windows_boundary_size(ticks(spark, 6, 10), "ts", "at", 3, V), "window_id", "part") == [[1, 2, 3], [4, 5], [6, 7, 8], [], []]
    assert lists(seq(spark, TEN).with_df(seq(spark, TEN).df.withColumn("ts", F.col("ord"))).buffer_boundary_size(ticks(spark), "ts", "at", 3, V), "window_id", "part") == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]


def test_windows_by_start_and_end(spark):
    s = script(spark, (1, 1), (3, 2), (4, 3), (5, 4), (7, 5), (9, 6))
    spans = spark.createDataFrame([(1, 2, 6), (2, 8, 10)], "id long, s long, e long")
    assert lists(s.buffer_start_end(spans, "ts", "s", "e", "id", V)) == [[2, 3, 4], [6]]
    overlap = script(spark, (1, 1), (3, 2), (5, 3), (7, 4))
    spans = spark.createDataFrame([(1, 2, 6), (2, 4, 8)], "id long, s long, e long")
    assert lists(overlap.buffer_start_end(spans, "ts", "s", "e", "id", V)) == [[2, 3], [3, 4]]


def test_window_batch(spark):
    s = script(spark, (1, 1), (2, 2), (3, 3), (4, 4))
    assert lists(s.window_batch("ts", 100, 3).gathered(V)) == [[1, 2, 3], [4]]
    late = script(spark, (0, 1), (1, 2), (25, 3), (26, 4))
    assert lists(late.window_batch("ts", 10, 3).gathered(V)) == [[1, 2], [3, 4]]


def test_group_by(spark):
    groups = seq(spark, TEN).with_df(seq(spark, TEN).df.withColumn("k", V % 2)).group_by("k").to_list(V).orderBy("k").collect()
    assert [r["list"] for r in groups] == [[2, 4, 6, 8, 10], [1, 3, 5, 7, 9]]
    nulls = Seq(spark.createDataFrame([(0, None)], "ord long, k int"), "ord")
    with pytest.raises(Exception, match="null key"):
        nulls.group_by("k", strict=True).df.collect()


def test_zip(spark):
    s = seq(spark, [1, 2])
    assert [r["value"] + r["value_2"] for r in s.zip_with(s).df.orderBy("place").collect()] == [2, 4]
    five = seq(spark, TEN[:5])
    assert [r["value"] + r["other"] for r in five.zip_with_values([10, 20, 30, 40, 50, 60]).df.orderBy("place").collect()] == [11, 22, 33, 44, 55]
    assert five.zip_with_values([]).df.count() == 0
    assert zip_all(five, s, five).df.count() == 2


def test_latest(spark):
    a, b = (spark.createDataFrame(r, "ts long, v int") for r in ([(1, 1), (2, 2)], [(3, 1), (4, 2), (6, 3)]))
    both = Seq(a, "ts").combine_latest({"a": a, "b": b}).df.orderBy("ts").collect()
    assert [(r["a"]["v"], r["b"]["v"]) for r in both] == [(2, 1), (2, 2), (2, 3)]
    just = spark.createDataFrame([(0, 10)], "ts long, v int")
    main = script(spark, *((t, t) for t in TEN))
    assert [r["value"] + r["latest"]["v"] for r in main.with_latest_from(just).df.orderBy("ts").collect()] == list(range(11, 21))
    assert main.with_latest_from(just.limit(0)).df.count() == 0


@pytest.mark.parametrize("grain", [None, 1, 3])
def test_overlap_join(spark, grain):
    kinds = "v int, s long, e long"
    left = Seq(spark.createDataFrame([(1, 1, 4), (2, 2, 4), (4, 5, None), (8, 6, None)], kinds).withColumnsRenamed({"s": "ls", "e": "le", "v": "lv"}), "ls")
    right = spark.createDataFrame([(16, 3, None)], kinds)
    assert sorted(r["lv"] + r["v"] for r in left.join_overlapping(right, ("ls", "le"), ("s", "e"), grain=grain).collect()) == [17, 18, 20, 24]
    found = left.group_join(right.where("v > 100"), ("ls", "le"), ("s", "e"), F.col("v"), ["v"], grain=grain)
    assert sorted((r["lv"], r["matches"]) for r in found.collect()) == [(1, []), (2, []), (4, []), (8, [])]


def test_switch_map(spark):
    outer = Seq(spark.createDataFrame([(1, "b"), (4, "c")], "at long, which string"), "at")
    inner = spark.createDataFrame([(2, "b", 10), (3, "b", 20), (5, "b", 30), (6, "c", 300), (7, "b", 40), (8, "c", 400)], "ts long, which string, v int")
    assert [r["v"] for r in outer.switch_map(inner, "at", "ts", on=["which"]).df.orderBy("ts").collect()] == [10, 20, 300, 400]


def test_rate_operators(spark):
    assert values(script(spark, (1, 1), (4, 2)).sample(ticks(spark, 2, 3, 5), "ts", "at")) == [1, 2]
    assert values(script(spark, (1, 1), (9, 2)).sample(ticks(spark, 2), "ts", "at")) == [1]
    assert values(script(spark, (1, 1), (2, 2), (4, 3)).throttle_first("ts", 2)) == [1, 3]
    assert values(script(spark, (1, 1), (5, 2), (6, 3), (7, 4), (12, 5)).debounce("ts", 2)) == [1, 4, 5]
    s = script(spark, (1, 1), (2, 2), (9, 3))
    assert values(s.timeout("ts", 2)) == [1, 2]
    with pytest.raises(Exception, match="timeout"):
        s.timeout("ts", 2, strict=True).df.collect()
    other = spark.createDataFrame([(1, 7), (2, 8)], "ts long, value int")
    assert values(s.timeout_fallback("ts", 2, other)) == [1, 2, 7, 8]
    assert values(s.take_until_other(ticks(spark, 2), "ts", "at")) == [1]
    assert values(s.skip_until_other(ticks(spark, 2), "ts", "at")) == [2, 3]
    assert values(s.delay_subscription()) == [1, 2, 3]
    assert values(s.on_backpressure_latest(ticks(spark, 3), "ts", "at")) == [2, 3]
    assert values(s.on_backpressure_drop(ticks(spark, 3), "ts", "at", 1)) == [1, 3]


def test_errors_and_retries(spark):
    s = seq(spark, TEN)
    fallback = seq(spark, [70, 80]).df
    assert values(s.on_error_resume(V == 3, fallback)) == [1, 2, 70, 80]
    assert values(s.on_error_resume(V == 30, fallback)) == TEN
    assert values(s.on_error_return(V == 3, value=-1)) == [1, 2, -1]
    tries = []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError("no")
        return "yes"

    assert retry(action, 2) == "yes" and len(tries) == 3
    tries.clear()
    with pytest.raises(ValueError):
        retry(action, 1)
    tries.clear()
    assert retry_when(action, lambda k, e: 0) == "yes"
    with pytest.raises(Exception, match="boom"):
        sources.error(spark, "boom").df.collect()
    seen = []
    with pytest.raises(Exception):
        tapped(lambda: sources.error(spark, "boom").df.collect(), on_error=seen.append, after_terminate=lambda: seen.append("end"))
    assert seen[-1] == "end" and len(seen) == 2
    assert values(s.repeat_while(iter([True, False]).__next__).take(12)).count(1) == 2


def test_amb_merge_and_rails(spark):
    early, late = script(spark, (1, 1), (5, 2)), script(spark, (2, 3))
    assert values(late.amb_with(early.df, time="ts")) == [1, 2]
    assert sorted(values(late.merge_with(early.df))) == [1, 2, 3]
    s = seq(spark, TEN)
    for n in (1, 3, 16):
        rails = s.parallel(n)
        assert rails.reduce(F.sum, V).first()[0] == 55
        assert values(rails.sequential()) == TEN
        assert rails.to_sorted_list(V).first()[0] == TEN
        assert rails.reduce_rails(F.sum, V, 0, lambda seed, v: seed + v).count() == n
        assert [r["value"] for r in rails.sorted(V.desc()).collect()] == TEN[::-1]
    assert s.filter(V > 99).parallel(2).reduce(F.sum, V).collect() == []
    assert values(s.parallel(2).groups().to_list(V).orderBy("rail"), "list") == [[1, 3, 5, 7, 9], [2, 4, 6, 8, 10]]
    assert from_sequences(early, late).df.select("rail").distinct().count() == 2
    assert values(s.parallel(3).map(value=V + 1).filter(V > 9).sequential()) == [10, 11]


def test_sharing(spark):
    shared = seq(spark, TEN).publish()
    arrive = shared.auto_connect(2)
    arrive()
    assert not shared.connected
    arrive()
    assert shared.connected
    shared.disconnect()
    with shared.ref_count() as s:
        assert s.df.count() == 10 and shared.connected
    assert not shared.connected
    assert seq(spark, TEN).to_future().result()["value"] == 10
    assert seq(spark, []).to_future(default=3).result() == 3
    with pytest.raises(LookupError):
        seq(spark, []).to_future().result()
    assert seq(spark, []).blocking_first() is None and seq(spark, TEN).blocking_last()["value"] == 10
    assert [r["value"] for r in seq(spark, TEN).to_iterable()] == TEN


def test_sources(spark):
    assert values(sources.range_(spark, 3, 4)) == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        sources.range_(spark, 2**31 - 2, 3)
    with pytest.raises(ValueError):
        sources.just(spark, None)
    assert values(sources.generate(spark, 1, lambda s: (s, s * 2) if s < 20 else None, 100)) == [1, 2, 4, 8, 16]
    assert values(sources.interval(spark, 0, 10, 3)) == [0, 1, 2] and values(sources.interval(spark, 0, 10, 3), "ts") == [3, 6, 9]
    text = spark.createDataFrame([(0, "Hello world!")], "ord long, t string")
    assert len(values(sources.characters(F.col("t"), text, ("ord",)), "code")) == 12
    closed = []
    with pytest.raises(RuntimeError), sources.using(lambda: 1, lambda r: (_ for _ in ()).throw(RuntimeError()), closed.append):
        pass
    assert closed == [1]
    with pytest.raises(ValueError):
        Seq(text, "nowhere")


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_whole_sequences_do_not_depend_on_partitions(spark, partitions):
    rows = spark.createDataFrame([(k, (k * 37) % 101) for k in range(500)], "ord long, value int").repartition(partitions)
    s = Seq(rows, "ord")
    running = s.accumulate("sum", V, "acc").df.orderBy("ord").collect()
    total = 0
    for r in running:
        total += r["value"]
        assert r["acc"] == total
    assert [r["place"] for r in s.numbered().df.orderBy("ord").collect()] == list(range(500))
    assert "SinglePartition, ENSURE" not in s.numbered().df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


# null keys, repeated rows, one busy key


def keyed(spark, *rows, kinds="ts long, k string, value int"):
    return Seq(spark.createDataFrame(list(rows), kinds), "ts", "k")


def test_null_keys_are_a_sequence_like_others(spark):
    a = keyed(spark, (1, None, 10), (2, "x", 11), (3, None, 12))
    b = keyed(spark, (4, None, 20), (5, "x", 21), (6, None, 22))
    assert sorted((str(r["k"]), r["value"], r["value_2"]) for r in a.zip_with(b).df.collect()) == [("None", 10, 20), ("None", 12, 22), ("x", 11, 21)]
    assert sorted(values(a.amb_with(b.df, time="ts").df)) == [10, 11, 12]
    ticks = spark.createDataFrame([(None, 2), (None, 4), ("x", 9)], "k string, at long")
    assert sorted(values(a.sample(ticks, "ts", "at").df)) == [10, 11, 12]
    assert sorted(values(a.on_error_resume(V == 12, b.df).df)) == [10, 11, 20, 22]
    assert sorted(values(a.timeout_fallback("ts", 1, b.df).df)) == [10, 11, 20, 22]
    assert sorted(values(a.take_until_other(ticks, "ts", "at").df)) == [10, 11]
    found = {(r["k"], r["window_id"]): r["buffer"] for r in a.windows_boundary(ticks, "ts", "at", V).collect()}
    assert found == {(None, 0): [10], (None, 1): [12], (None, 2): [], ("x", 0): [11], ("x", 1): []}
    inner = spark.createDataFrame([(None, 1), (None, 5), ("x", 5)], "k string, it long")
    assert sorted((str(r["k"]), r["value"], r["it"]) for r in a.switch_map(inner, "ts", "it").df.collect()) == [("None", 10, 1), ("None", 12, 5), ("x", 11, 5)]


@pytest.mark.parametrize("key", ["k", ()])
def test_group_join_keeps_repeated_rows(spark, key):
    left = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), (None, 50, 60)], "k string, s long, e long")
    right = spark.createDataFrame([("a", 4, 9, 9), ("a", 30, 31, 8)], "k string, rs long, re long, v int")
    found = Seq(left, "s", key).group_join(right if key else right.drop("k"), ("s", "e"), ("rs", "re"), F.col("v"), ["v"])
    assert sorted((r["s"], r["matches"]) for r in found.collect()) == [(1, [9]), (1, [9]), (50, [])]


def test_overlaps_of_one_busy_key_are_joined_by_cells(spark):
    rows = spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("s"), (F.col("id") + 1).alias("e"))
    other = rows.withColumnsRenamed({"s": "rs", "e": "re"})
    found = Seq(rows, "s", "k").join_overlapping(other, ("s", "e"), ("rs", "re"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 4000 and any("Join" in x and "_cell#" in x.split("]")[0] for x in plan.splitlines())


def test_left_overlap_join_has_each_lonely_row_once(spark):
    left = spark.createDataFrame([(0, 100), (200, 201), (None, 5), (0, 100)], "s long, e long")
    right = spark.createDataFrame([(5, 6), (7, 8)], "rs long, re long")
    found = Seq(left, "s").join_overlapping(right, ("s", "e"), ("rs", "re"), how="left", grain=10)
    assert sorted((r["s"] if r["s"] is not None else -1, r["rs"] if r["rs"] is not None else -1) for r in found.collect()) == [(-1, -1), (0, 5), (0, 5), (0, 7), (0, 7), (200, -1)]


def test_numbering_with_one_first_value_for_all(spark):
    rows = spark.range(3000).select(F.lit(7).alias("a"), F.col("id").alias("b"))
    found = Seq(rows, ("a", "b")).numbered("n").df
    assert found.where("n <> b").count() == 0


def test_error_modes_and_limits_in_time(spark):
    s = sources.from_array(spark, 1, 2, 3, 4)
    two = F.array(V, V * 10)
    assert values(s.concat_map(two, "x", error=V == 3), "x") == [1, 10, 2, 20]
    assert values(s.concat_map(two, "x", error=V == 3, mode="end"), "x") == [1, 10, 2, 20, 4, 40]
    with pytest.raises(ValueError, match="error mode"):
        s.concat_map(two, mode="never")
    assert s.errors(V > 2).first()["errors"] == 2
    assert values(s.concat_with(s.df, error=V == 3)) == [1, 2] and values(s.concat_with(s.df, error=V == 3, delay_error=True)) == [1, 2, 1, 2]
    assert s.blocking_first(timeout=300)["value"] == 1
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "int")
    with pytest.raises(TimeoutError):
        s.map(value=slow(V)).blocking_last(timeout=0.5)
    s.test().assert_values("value", 1, 2, 3, 4).assert_count(4).assert_complete()
    with pytest.raises(AssertionError):
        s.test().assert_count(5)
    sources.error(spark, "bad").test().assert_error("bad")


def test_generate_without_limit_and_using_in_both_orders(spark):
    told = []
    made = sources.generate(spark, 1, lambda x: (x, x * 2) if x < 100 else None, consume=told.append)
    assert values(made) == [1, 2, 4, 8, 16, 32, 64] and told == [128]
    with pytest.raises(ValueError, match="more than 3"):
        sources.generate(spark, 1, lambda x: (x, x), most=3)
    for eager, expected in ((True, ["gone", "done"]), (False, ["done", "gone"])):
        told = []
        with sources.using(lambda: 1, lambda x: sources.just(spark, x), lambda _: told.append("gone"), eager, lambda: told.append("done")) as seq_:
            assert values(seq_) == [1]
        assert told == expected


def rows_made(df, name):
    """Rows that the operators of a name made in the run of ``df.collect()``."""

    def walk(node):
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in kind:
            return walk(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if kind == name else 0
        return own + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_endless_and_long_spans_have_few_cells(spark):
    """Each of 300 spans would have up to 100,000 cells of the short ones' size."""
    left = spark.range(300).select((F.col("id") * 10_000_000).alias("s"), F.when(F.col("id") % 3 == 0, 1 << 60).alias("e"))
    right = spark.range(300).select((F.col("id") * 10_000_000 + 5).alias("rs"), (F.col("id") * 10_000_000 + 6).alias("re"))
    for how in ("inner", "left"):
        found = Seq(left, "s").join_overlapping(right, ("s", "e"), ("rs", "re"), how)
        assert sorted((r["s"], r["rs"]) for r in found.collect()) == [(k * 10_000_000, n * 10_000_000 + 5) for k in range(300) for n in range(k, 300)]
        assert rows_made(found, "Generate") < 10_000
    assert Seq(right, "rs").join_overlapping(left, ("rs", "re"), ("s", "e")).count() == 300 * 301 // 2


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_overlaps_of_spans_of_all_lengths_equal_all_pairs(spark, kind, how):
    random = Random(7)

    def rows(n):
        for k in range(n):
            s = random.choice([None, *(random.randrange(1000) for _ in range(9))])
            e = None if s is None or random.random() < 0.1 else s + random.choice([-2, 0, 1, 1, 2, 3, 7, 8, 9, 60, 500, 10**9])
            yield random.choice([None, 1, 2]), k, s if s is None or kind == "long" else s + random.randrange(4) / 4, e if e is None or kind == "long" else e + random.randrange(4) / 4

    a, b = list(rows(150)), list(rows(150))
    left, right = (spark.createDataFrame(r, f"k long, {p}i long, {p}s {kind}, {p}e {kind}") for p, r in (("l", a), ("r", b)))

    def full(s, e):
        return s is not None and (e is None or e > s)

    def meets(l, r):
        return l[0] == r[0] and full(*l[2:]) and full(*r[2:]) and (r[3] is None or l[2] < r[3]) and (l[3] is None or r[2] < l[3])

    want = [(l[1], r[1]) for l in a for r in b if meets(l, r)]
    if how == "left":
        want += [(l[1], None) for l in a if not any(meets(l, r) for r in b)]
    for grain in (None, 1, 50):
        found = Seq(left, "li", "k").join_overlapping(right, ("ls", "le"), ("rs", "re"), how, grain=grain)
        assert sorted(((r["li"], r["ri"]) for r in found.collect()), key=str) == sorted(want, key=str)


def test_group_join_of_near_spans_forms_no_pairs(spark):
    left = spark.range(300).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("s"), (F.col("id") + 1000).alias("e"))
    right = spark.range(400).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("rs"), (F.col("id") + 1000).alias("re"))
    found = Seq(left, "s", "k").group_join(right, ("s", "e"), ("rs", "re"), F.col("rs"), ["rs"])
    assert [r["matches"] for r in found.collect()] == [list(range(400))] * 300
    assert sum(rows_made(found, n) for n in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin")) == 300


@pytest.mark.parametrize("lengths", [[1, 2, 3], [-1, 0, 1, 9, 300, None], [5]])
@pytest.mark.parametrize("others", [[1, 2, 3], [0, 7, 500, None]])
def test_group_join_of_spans_of_all_lengths_equals_all_pairs(spark, lengths, others):
    random = Random(3)

    def rows(n, lengths):
        for k in range(n):
            s, d = random.choice([None, *(random.randrange(200) for _ in range(9))]), random.choice(lengths)
            yield random.choice([None, 1]), k // 2, s, None if s is None or d is None else s + d

    a, b = list(rows(80, lengths)), list(rows(80, others))
    left, right = (spark.createDataFrame(r, f"k long, {p}i long, {p}s long, {p}e long") for p, r in (("l", a), ("r", b)))

    def meets(l, r):
        full = all(x[2] is not None and (x[3] is None or x[3] > x[2]) for x in (l, r))
        return full and l[0] == r[0] and (r[3] is None or l[2] < r[3]) and (l[3] is None or r[2] < l[3])

    want = sorted(([*l, sorted(r[1] for r in b if meets(l, r))] for l in a), key=str)
    for grain in (None, 2, 100):
        found = Seq(left, "li", "k").group_join(right, ("ls", "le"), ("rs", "re"), F.col("ri"), ["ri"], grain=grain)
        assert sorted(([*r] for r in found.collect()), key=str) == want


def test_overlap_join_of_one_file_is_dealt_to_many_tasks(spark):
    """Pairs are the work, so neither a broadcast of a small side nor merged small shuffles leave them to one task."""
    rows = spark.range(0, 20_000, 1, 1).select((F.col("id") * 10).alias("s"), (F.col("id") * 10 + 15).alias("e"))
    found = Seq(rows, "s").join_overlapping(rows.withColumnsRenamed({"s": "rs", "e": "re"}), ("s", "e"), ("rs", "re"))
    tasks = found.groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert sum(r["count"] for r in tasks) == 3 * 20_000 - 2 and len(tasks) >= 8 and max(r["count"] for r in tasks) < 15_000
