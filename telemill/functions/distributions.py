"""Outcome distributions as maps from outcome to count or probability, and their long form.

The map form is row-local: nothing is shuffled.  The long form (one row for each outcome) is for distributions that
have to be counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import PAYLOAD_TOKENS, is_blank

GOOD_BELOW, FAIR_BELOW = 0.3, 0.6
NORMAL, REVERSED, UNCERTAIN = "normal", "reversed", "uncertain"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def unwrap(text: Column, depth: int = 6) -> Column:
    """Take off JSON string encodings, at most ``depth`` of them."""
    layers = F.array(*[F.lit(k) for k in range(depth)])
    return F.aggregate(layers, F.trim(text), lambda t, _: F.when(t.startswith('"'), F.trim(F.coalesce(F.get_json_object(t, "$"), t))).otherwise(t))


def sum_by_key(entries: Column) -> Column:
    """A map from an array of (key, value) structs; values of equal keys are added."""
    def build(e: Column) -> Column:
        total = lambda k: F.aggregate(F.filter(e, lambda x: x["key"] == k), F.lit(0).cast("bigint"), lambda acc, x: acc + x["value"])
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(e, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), total(k).alias("value"))))

    return let(entries, build)


def counts(text: Column, depth: int = 6) -> Column:
    """Counts of a JSON object {outcome: number}, also string-encoded or as the only item of a list.

    Keys lose their blanks, keys that then are equal are added, numbers are cut to integers.  Null where the text is
    blank, is something else, or has a value that isn't a number.
    """
    entry = lambda e: F.struct(F.replace(e["key"], F.lit(" "), F.lit("")).alias("key"), F.floor(e["value"].try_cast("double")).alias("value"))
    parse = lambda t: F.transform(F.map_entries(F.from_json(F.when(t.startswith("{"), t), "map<string,string>")), entry)
    whole = lambda e: F.when(~F.exists(e, lambda x: x["value"].isNull()), sum_by_key(e))
    only = lambda t: let(F.from_json(F.when(t.startswith("["), t), "array<string>"), lambda a: F.when(F.size(a) == 1, unwrap(a[0], depth)).otherwise(t))
    return F.when(~is_blank(text, PAYLOAD_TOKENS), let(unwrap(text, depth), lambda t: let(only(t), lambda u: let(parse(u), whole))))


def counts_error(text: Column, depth: int = 6) -> Column:
    """Why ``counts`` is null: empty, list or unparsable; null where it isn't."""
    listed = let(unwrap(text, depth), lambda t: t.startswith("[") & (F.coalesce(F.size(F.from_json(t, "array<string>")), F.lit(-1)) != 1))
    return F.when(is_blank(text, PAYLOAD_TOKENS), "empty").when(listed, "list").when(counts(text, depth).isNull(), "unparsable")


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)


def probabilities(m: Column) -> Column:
    """Shares of the total; an empty map where the total isn't positive."""
    t = total(m)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.when(m.isNull(), None).when(t > 0, F.transform_values(m, lambda k, v: v / t)).otherwise(empty)


def _over_union(p: Column, q: Column, term) -> Column:
    at = lambda m, k: F.coalesce(m[k], F.lit(0.0))
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    return F.when(F.size(keys) > 0, F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + term(at(p, k), at(q, k))))


def hellinger(p: Column, q: Column) -> Column:
    """sqrt(1/2 sum (sqrt p - sqrt q)^2) over the union of outcomes; null if both are empty."""
    return F.sqrt(0.5 * _over_union(p, q, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), F.lit(2.0))))


def l1(p: Column, q: Column) -> Column:
    return _over_union(p, q, lambda a, b: F.abs(a - b))


def reverse_keys(m: Column) -> Column:
    """Outcomes read from the other end.  Reversal keeps keys apart."""
    return F.transform_keys(m, lambda k, v: F.reverse(k))


def order_verdict(result: Column, ideal: Column, margin: float = 0.001) -> Column:
    """normal, reversed or uncertain: in which order of bits ``result`` is closer to ``ideal`` (maps of shares)."""
    return verdict(l1(result, ideal), l1(reverse_keys(result), ideal), margin)


def verdict(straight: Column, turned: Column, margin: float = 0.001) -> Column:
    gap = F.abs(straight - turned)
    return F.when(gap.isNull() | (gap < margin), UNCERTAIN).when(straight <= turned, NORMAL).otherwise(REVERSED)


def dominant(df: DataFrame, verdicts: list[str]) -> DataFrame:
    """One row with the more frequent certain verdict of each column (normal wins ties; null if there is none), and of all."""
    one = lambda c, v: F.count_if(F.col(c) == v)
    pick = lambda n, r: F.when(n + r == 0, None).when(n >= r, NORMAL).otherwise(REVERSED)
    sums = [sum((one(c, v) for c in verdicts[1:]), one(verdicts[0], v)) for v in (NORMAL, REVERSED)]
    return df.agg(*[pick(one(c, NORMAL), one(c, REVERSED)).alias(f"dominant_{c}") for c in verdicts], pick(*sums).alias("dominant_all"))


def resolve_order(own: Column, other: Column, dominant_own: Column, dominant_all: Column, default: str = NORMAL, assume: str | None = None) -> tuple[Column, Column]:
    """(order, used_fallback): the assumed one, else the own verdict, the other side's, the dominant one, the default."""
    if assume:
        return F.lit(assume), F.lit(False)
    certain = lambda c: F.when(c.isin(NORMAL, REVERSED), c)
    return F.coalesce(certain(own), certain(other), dominant_own, dominant_all, F.lit(default)), certain(own).isNull()


def aligned(m: Column, order: Column) -> Column:
    return F.when(order == REVERSED, reverse_keys(m)).otherwise(m)


def counts_json(m: Column) -> Column:
    """A JSON object with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def choose_source(aligned_text: Column, result_text: Column, mode: Column, name: str, mode_name: str) -> tuple[Column, Column, Column]:
    """(text, mode, provenance): the aligned column if it isn't blank, else the raw result under its mode column."""
    has = ~is_blank(aligned_text, PAYLOAD_TOKENS)
    m = F.when(is_blank(mode, PAYLOAD_TOKENS), NORMAL).otherwise(F.lower(F.trim(mode)))
    return (
        F.when(has, aligned_text).otherwise(result_text),
        F.when(has, "aligned").when(m.isin(NORMAL, REVERSED), F.concat(F.lit("fallback:"), m)),
        F.when(has, f"aligned:{name}").otherwise(f"fallback:result+{mode_name}"),
    )


def unit_interval(c: Column, slack: float = 1e-9) -> Column:
    """Clipped to 0..1; what lies further out than ``slack`` is an error of the task."""
    bad = (c < -slack) | (c > 1 + slack)
    return F.when(bad, F.raise_error(F.concat(F.lit("outside 0..1: "), c.cast("string"))).cast("double")).otherwise(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def distance_class(h: Column) -> Column:
    """0 good, 1 fair, 2 poor; null for null."""
    return F.when(h.isNull(), None).when(h < GOOD_BELOW, 0).when(h < FAIR_BELOW, 1).otherwise(2)


def class_name(c: Column) -> Column:
    return F.element_at(F.array(F.lit("good"), F.lit("fair"), F.lit("poor")), c + 1)


def noise_floor(shots: Column) -> Column:
    return F.when(shots > 0, 1 / F.sqrt(shots.cast("double")))


def long_shares(df: DataFrame, keys: list[str], outcome: str, weight: Column | None = None) -> DataFrame:
    """(keys, outcome, n, total, share) from rows: counted once with partial sums, totals from the counts."""
    n = df.groupBy(*keys, outcome).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    if not keys:
        t = n.agg(F.sum("n").alias("total"))
        return n.join(F.broadcast(t)).withColumn("share", F.col("n").cast("double") / F.col("total"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    return n.join(t, keys).withColumn("share", F.col("n").cast("double") / F.col("total"))


def long_distance(p: DataFrame, q: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """(keys, n, hellinger, l1) of long-form shares ``p`` by keys against one distribution ``q``.

    Outcomes that a key lacks add q (to both sums); they come from the sum of q over those it has, so no row is made for
    them.
    """
    qs = q.select(F.col(outcome), F.col("share").alias("q"))
    both = p.join(qs, outcome, "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    out = both.groupBy(*keys).agg(
        F.max("total").alias("n"),
        F.sum(F.pow(F.sqrt("share") - F.sqrt("q"), F.lit(2.0))).alias("h2"),
        F.sum(F.abs(F.col("share") - F.col("q"))).alias("d"),
        F.sum("q").alias("met"),
    )
    missing = F.greatest(F.lit(0.0), 1 - F.col("met"))
    return out.select(*keys, "n", F.sqrt(0.5 * (F.col("h2") + missing)).alias("hellinger"), (F.col("d") + missing).alias("l1"))
