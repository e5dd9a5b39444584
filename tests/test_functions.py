"""Golden values of scalar functions and row-local operators."""

import math

import pytest
from pyspark.sql import functions as F

from telemill.functions import distributions as d
from telemill.functions import nulls, payload, times


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v)
    return df.select(column.alias("x")).first().x


def shares(**kw):
    return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k[1:]), F.lit(float(v)))]) if kw else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


@pytest.mark.parametrize(
    ("p", "q", "h", "l1"),
    [
        (dict(k00=0.5, k11=0.5), dict(k00=1), 0.541196, 1.0),
        (dict(k00=1), dict(k00=1), 0.0, 0.0),
        (dict(k0=1), dict(k1=1), 1.0, 2.0),
        (dict(), dict(k0=1), 0.707107, 1.0),
    ],
)
def test_distances(spark, p, q, h, l1):
    assert one(spark, d.hellinger(shares(**p), shares(**q))) == pytest.approx(h, abs=1e-6)
    assert one(spark, d.hellinger(shares(**q), shares(**p))) == pytest.approx(h, abs=1e-6)
    assert one(spark, d.l1(shares(**p), shares(**q))) == pytest.approx(l1)
    assert one(spark, d.hellinger(d.reverse_keys(shares(**p)), d.reverse_keys(shares(**q)))) == pytest.approx(h, abs=1e-6)


def test_distance_of_nothing_is_null(spark):
    assert one(spark, d.hellinger(shares(), shares())) is None


@pytest.mark.parametrize(
    ("text", "expected", "error"),
    [
        ('{"0 0":1,"00":2}', {"00": 3}, None),
        ('{"01": "10", "10": 10.7}', {"01": 10, "10": 10}, None),
        ("{'01': 5}", {"01": 5}, None),
        ('["{\\"01\\": 3}"]', {"01": 3}, None),
        ('"\\"{\\\\\\"01\\\\\\": 3}\\""', {"01": 3}, None),
        ('[{"0": 1}, {"1": 1}]', None, "list"),
        ('{"01": "many"}', None, "unparsable"),
        ("nan", None, "empty"),
        ("  ", None, "empty"),
        (None, None, "empty"),
        ("text", None, "unparsable"),
    ],
)
def test_counts(spark, text, expected, error):
    c = F.lit(text).cast("string")
    assert one(spark, d.counts(c)) == expected
    assert one(spark, d.counts_error(c)) == error


def test_bit_order(spark):
    assert one(spark, d.order_verdict(shares(k01=1), shares(k10=1))) == "reversed"
    assert one(spark, d.order_verdict(shares(k00=1), shares(k00=1))) == "uncertain"
    assert one(spark, d.order_verdict(shares(k01=1), shares(k01=1))) == "normal"
    order, fallback = d.resolve_order(F.lit("uncertain"), F.lit("reversed"), F.lit("normal"), F.lit("normal"))
    assert one(spark, order) == "reversed" and one(spark, fallback) is True
    order, fallback = d.resolve_order(F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), assume="reversed")
    assert one(spark, order) == "reversed" and one(spark, fallback) is False


@pytest.mark.parametrize(("h", "c"), [(0.29, 0), (0.3, 1), (0.59, 1), (0.6, 2), (None, None)])
def test_class(spark, h, c):
    assert one(spark, d.distance_class(F.lit(h).cast("double"))) == c


def test_unit_interval(spark):
    assert one(spark, d.unit_interval(F.lit(1 + 1e-12))) == 1.0
    with pytest.raises(Exception, match="outside 0..1"):
        one(spark, d.unit_interval(F.lit(1.1)))


def test_noise_floor(spark):
    assert one(spark, d.noise_floor(F.lit(200))) == pytest.approx(1 / math.sqrt(200))
    assert one(spark, d.noise_floor(F.lit(0))) is None


@pytest.mark.parametrize(("value", "blank"), [(None, True), (" ", True), ("NaN", False), ("nan", True), ("0", False)])
def test_blank(spark, value, blank):
    assert one(spark, nulls.is_blank(F.lit(value).cast("string"), nulls.PAYLOAD_TOKENS)) is blank


def test_numbers(spark):
    assert one(spark, nulls.number(F.lit(" 1.5 "))) == 1.5
    assert one(spark, nulls.number(F.lit("N/A"))) is None
    assert one(spark, nulls.number(F.lit(float("nan")))) is None
    assert one(spark, nulls.unparsable(F.lit("abc"))) is True
    assert one(spark, nulls.ratio(F.lit(3), F.lit(0))) is None


@pytest.mark.parametrize(
    ("text", "utc"),
    [("2025-10-26 02:30:00", "2025-10-26 00:30:00"), ("2025-03-30 02:30:00", "2025-03-30 01:30:00"), ("2025-07-01 12:00:00Z", "2025-07-01 12:00:00"), ("2025-07-01 12:00:00+02:00", "2025-07-01 10:00:00"), ("soon", None)],
)
def test_local_to_utc(spark, text, utc):
    got = one(spark, F.date_format(times.to_utc(F.lit(text)), "yyyy-MM-dd HH:mm:ss"))
    assert got == utc


@pytest.mark.parametrize(("after", "kept"), [(1, True), (2, False)])
def test_schedule_mask(spark, after, kept):
    done = F.lit("2025-01-01 00:00:00").cast("timestamp")
    got = one(spark, times.not_after(done + F.make_interval(secs=F.lit(after)), done))
    assert (got is not None) is kept


def batch(spark, circuit, executed, result, job="P"):
    df = spark.createDataFrame([(job, circuit, executed, result)], "id string, circuit string, executed string, result string")
    parts = {"circuit": payload.items(F.col("circuit")), "executed": payload.items(F.col("executed")), "result": payload.count_items(F.col("result"))}
    return payload.expand_batches(df, "id", parts).orderBy("batch_index").collect()


def test_batches_of_equal_length(spark):
    rows = batch(spark, '["a","b","c"]', "x", '[{"0":1},{"1":2},{"0":3}]')
    assert [r.sub_id for r in rows] == ["P_0", "P_1", "P_2"]
    assert [r.circuit for r in rows] == ["a", "b", "c"] and {r.executed for r in rows} == {"x"}
    assert [r.result for r in rows] == ['{"0":"1"}', '{"1":"2"}', '{"0":"3"}']
    assert {(r.batch_size, r.is_batch_job, r.batch_mismatch) for r in rows} == {(3, True, False)}


def test_batches_of_different_lengths(spark):
    (r,) = batch(spark, '["a","b"]', "x", '[{"0":1},{"1":2},{"0":3}]')
    assert r.batch_mismatch and r.batch_size == 3 and r.circuit == '["a","b"]' and r.sub_id == "P_0"


def test_absent_and_broken_payloads(spark):
    (r,) = batch(spark, None, '["a",[1]]', None, None)
    assert r.parent_id == "unknown_id" and r.circuit is None and r.executed == '["a",[1]]' and r.executed_error and r.batch_size == 1 and not r.is_batch_job


@pytest.mark.parametrize(
    ("text", "name"),
    [("", "empty"), (None, "empty"), ('["a"]', "json_list"), ("['a']", "py_list"), ('{"a":1}', "json_dict"), ("{'a':1}", "py_dict"), ("gASabc", "b64_pickle_like"), ("OPENQASM 3.0; qubit q;", "qasm3_direct"), ("OPENQASM 2.0;", "qasm2_direct"), ("// x\nqubit[2] q;", "qasm3_like"), ("qreg q[2];", "qasm2_like"), ("hello", "other_string")],
)
def test_formats(spark, text, name):
    assert one(spark, payload.detect_format(F.lit(text).cast("string"))) == name


def test_wrapped_program(spark):
    assert one(spark, payload.wrapped_program(F.lit('{"x": 1, "program": "p", "text": "t"}'))) == "p"
    assert one(spark, payload.clean_includes(F.lit('OPENQASM 2.0;\ninclude "qelib1.inc";\nqreg q[1];'))) == "OPENQASM 2.0;\nqreg q[1];"
    assert one(spark, payload.shorten(F.lit("a" * 300))) == "a" * 237 + "..."
