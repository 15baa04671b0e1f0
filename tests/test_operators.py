"""Operators on hand-written edge frames."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from scenfold.functions import scalars
from scenfold.operators import (
    aggregates, charts, compare, filters, joins, ordering, projections, reshape,
)
from scenfold.sources.registry import scenario_registry
from tests.frames import frame, symbol, values

AB = "A B"


def by_year(spark, *rows):
    return symbol(spark, "t", *[(t, v, s) for s, t, v in rows])


# --- scalars and filters


def test_bad_years_drop_out(spark):
    df = frame(spark, "t string, v double", ("2020", 1.0), ("x", 2.0), (None, 3.0), ("2101", 4.0))
    assert values(filters.time_range(df, "t", 2020, 2100), "t", value="v") == {2020: 1.0}
    assert values(filters.horizon(df, 2100), "t", value="v") == {"2020": 1.0}


def test_integer_year_filter_reaches_the_scan(spark, tmp_path):
    symbol(spark, "G t", ("X", 2020, 1.0, "a")).write.parquet(str(tmp_path / "s"))
    df = filters.filter_dims(filters.horizon(spark.read.parquet(str(tmp_path / "s")), 2050), G="X")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(t,2050)" in plan and "EqualTo(G,X)" in plan


def test_wildcards_and_lists(spark):
    df = symbol(spark, "G R", ("X", "u", 1.0, "a"), ("X", "v", 2.0, "a"), ("Y", "u", 3.0, "a"))
    assert filters.filter_dims(df, G="all", R="global").count() == 3
    assert filters.filter_dims(df, G="X", R=None).count() == 2
    assert filters.region(df, ["u", "v"]).count() == 3
    assert filters.region(df, "u").count() == 2
    assert filters.years(symbol(spark, "t", (1, 1.0, "a")), []).count() == 1


def test_long_membership_list_is_joined(spark):
    df = symbol(spark, "G", ("k5", 1.0, "a"), ("zz", 2.0, "a"))
    for n in (10, 5000):
        found = filters.isin(df, "G", [f"k{i}" for i in range(n)])
        assert values(found, "G") == {"k5": 1.0} and found.columns == df.columns


def test_division_by_zero_and_nan(spark):
    df = frame(spark, "a double, b double", (1.0, 0.0), (1.0, 2.0), (float("nan"), 1.0))
    got = [r[0] for r in df.select(scalars.safe_div("a", "b")).collect()[:2]]
    assert got == [None, 0.5]
    assert df.select(scalars.null_if_nan("a").alias("a")).filter("a is null").count() == 1


def test_sign_split_and_key(spark):
    df = frame(spark, "v double, s string, y int", (-2.0, "a", 2020), (3.0, "a", 2030), (None, "b", 2020))
    rows = df.select(
        scalars.pos("v"), scalars.neg("v"), scalars.key("s", "y"), scalars.zero_if_null("v"),
        scalars.negate("v"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (0.0, -2.0, "a-2020", -2.0, 2.0), (3.0, 0.0, "a-2030", 3.0, -3.0),
        (0.0, 0.0, "b-2020", 0.0, None),
    ]


# --- projections


def test_relabel_keeps_or_drops_unmatched(spark):
    df = symbol(spark, "R", ("u", 1.0, "a"), ("x", 2.0, "a"))
    assert values(projections.relabel(df, "R", {"u": "Upland"}), "R") == {"Upland": 1.0, "x": 2.0}
    dropped = projections.relabel(df, "R", {"u": "Upland"}, keep_unmatched=False)
    assert values(dropped, "R") == {"Upland": 1.0}


def test_order_adds_absent_series(spark):
    df = frame(spark, "k string, b double, a double", ("x", 1.0, 2.0))
    assert projections.order(df, ["k"], ["a", "missing", "b"]).collect()[0] == ("x", 2.0, None, 1.0)


def test_split_conserves_the_total(spark):
    df = symbol(spark, "fuel", ("T", 10.0, "a"), ("D", 1.0, "a"))
    parts = projections.split(df, "fuel", {"T": {"G": 0.67, "D": 0.24, "K": 0.09}})
    got = values(aggregates.agg_sum(parts, ["fuel"]), "fuel")
    assert got == pytest.approx({"G": 6.7, "D": 3.4, "K": 0.9})


# --- aggregates and reshape


def test_missing_values_in_groups(spark):
    df = symbol(spark, "G", ("X", None, "a"), ("X", None, "a"), ("Y", 1.0, "a"), ("Y", None, "a"))
    assert values(aggregates.agg_sum(df, ["G"]), "G") == {"X": 0.0, "Y": 1.0}
    assert values(aggregates.agg_mean(df, ["G"]), "G") == {"X": None, "Y": 1.0}
    assert values(aggregates.agg_by_type(df, ["G"], "price"), "G") == {"X": None, "Y": 1.0}


def test_pivots_on_duplicates_and_missing(spark):
    df = symbol(
        spark, "G t", ("X", 1, 1.0, "a"), ("X", 1, 3.0, "a"), ("Y", 1, None, "a"), ("X", 2, 5.0, "a")
    )
    summed = reshape.pivot_sum(df, ["t"], "G", ["X", "Y", "Z"]).orderBy("t").collect()
    assert [tuple(r) for r in summed] == [(1, 4.0, 0.0, None), (2, 5.0, None, None)]
    mean = reshape.pivot_mean(df, ["t"], "G", ["X", "Y"]).orderBy("t").collect()
    assert [tuple(r) for r in mean] == [(1, 2.0, None), (2, 5.0, None)]
    assert reshape.pivot_sum(df, ["t"], "G").columns == ["t", "X", "Y"]


def test_auto_pivot_takes_the_first_varying_column(spark):
    df = symbol(spark, "e G R t", ("c", "X", "u", 1, 1.0, "a"), ("c", "Y", "u", 1, 2.0, "a"))
    assert reshape.auto_pivot_column(df) == "G"
    assert reshape.pivot_auto(df, ["t"]).columns == ["t", "X", "Y"]
    one = filters.eq(df, "G", "X")
    assert reshape.auto_pivot_column(one) is None
    assert reshape.pivot_auto(one, ["t"]).columns == one.columns


def test_melt_keeps_null_cells(spark):
    df = frame(spark, "k string, x double, y double", ("a", 1.0, None))
    got = values(reshape.melt(df, ["k"], ["x", "y"], "s"), "s")
    assert got == {"x": 1.0, "y": None}


def test_open_dimensions():
    assert aggregates.open_dims({"R": "u", "G": "all", "e": "all"}) == ["G", "e"]


def test_distinct(spark):
    df = symbol(spark, "G R", ("X", "u", 1.0, "a"), ("X", "v", 2.0, "a"))
    assert aggregates.distinct_values(df, "G").count() == 1
    assert tuple(aggregates.distinct_count(df, "G", "R").first()) == (1, 2)


# --- joins


def test_side_by_side_missing_semantics(spark):
    a = by_year(spark, ("s", 1, 1.0), ("s", 1, 2.0), ("s", 2, None))
    b = by_year(spark, ("s", 3, 5.0), ("s", 3, 7.0))
    rows = joins.side_by_side({"a": a, "b": b}, averaged=["b"]).orderBy("t").collect()
    assert [tuple(r) for r in rows] == [("s", 1, 3.0, None), ("s", 2, 0.0, None), ("s", 3, None, 6.0)]


def test_side_by_side_is_one_shuffle(spark):
    a = by_year(spark, ("s", 1, 1.0))
    df = joins.side_by_side({"a": a, "b": a, "c": a})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_align_by_key_not_position(spark):
    a = by_year(spark, ("s", 1, 10.0), ("s", 2, 20.0))
    b = by_year(spark, ("s", 2, 4.0), ("s", 3, 1.0))
    assert values(joins.align(a, b, "-"), "t") == {1: None, 2: 16.0, 3: None}
    assert values(joins.align(a, b, "/"), "t") == {1: None, 2: 5.0, 3: None}
    assert values(joins.per_total(a, b), "t") == {1: None, 2: 5.0}


def test_conversion_unmatched_and_strict(spark):
    df = symbol(spark, "R", ("u", 1.0, "a"), ("x", 2.0, "a"))
    assert values(joins.convert(df, {"u": 0.5}), "R") == {"u": 2.0, "x": None}
    with pytest.raises(Exception, match="no conversion factor for x"):
        joins.convert(df, {"u": 0.5}, strict=True).collect()


def test_factor_default(spark):
    df = symbol(spark, "R", ("u", 1.0, "a"), ("x", 2.0, "a"))
    factors = symbol(spark, "R", ("u", 3.0, "a"))
    assert values(joins.with_factor(df, factors), "R", value="factor") == {"u": 3.0, "x": None}
    got = joins.with_factor(df, factors, default=1.0)
    assert values(got, "R", value="factor") == {"u": 3.0, "x": 1.0}


def test_first_by_and_union(spark):
    df = by_year(spark, ("s", 2, 20.0), ("s", 1, 10.0), ("r", 5, 50.0))
    assert values(joins.first_by(df, ["Scenario"], "t"), "Scenario") == {"s": 10.0, "r": 50.0}
    extra = df.withColumn("tech", F.lit("x"))
    assert joins.union_all(df, extra).filter("tech is null").count() == 3


# --- comparison


def test_rebase(spark):
    df = by_year(spark, ("a", 1, 2.0), ("a", 2, 3.0), ("b", 2, 5.0), ("c", 1, 0.0), ("c", 2, 1.0))
    got = values(compare.rebase(df), "Scenario", "t")
    assert got == {
        ("a", 1): 100.0, ("a", 2): 150.0, ("b", 2): None, ("c", 1): None, ("c", 2): None
    }
    assert values(compare.rebase(df, base_year=2), "Scenario", "t")[("b", 2)] == 100.0


def test_reldiff(spark):
    df = by_year(
        spark, ("Ref", 1, 2.0), ("a", 1, 3.0), ("Ref", 2, 0.0), ("a", 2, 1.0), ("a", 3, 1.0)
    )
    assert values(compare.reldiff(df), "Scenario", "t") == {
        ("a", 1): 50.0, ("a", 2): None, ("a", 3): None
    }


def test_reldiff_needs_the_reference(spark):
    with pytest.raises(Exception, match="reference scenario 'Ref' not found"):
        compare.reldiff(by_year(spark, ("a", 1, 3.0), ("b", 1, 4.0))).collect()


def test_reldiff_of_a_copy_is_zero(spark):
    df = by_year(spark, ("Ref", 1, 2.0), ("Ref", 2, 7.0), ("copy", 1, 2.0), ("copy", 2, 7.0))
    assert set(values(compare.reldiff(df), "t").values()) == {0.0}


def test_shares_sum_to_one_and_skip_missing(spark):
    df = symbol(spark, "G t", ("X", 1, 1.0, "a"), ("Y", 1, 3.0, "a"), ("Z", 1, None, "a"), ("X", 2, 0.0, "a"))
    got = values(compare.row_share(df, 1.0), "G", "t")
    assert got == {("X", 1): 0.25, ("Y", 1): 0.75, ("Z", 1): None, ("X", 2): None}


def test_scenario_difference(spark):
    df = symbol(
        spark, "Year Region", (1, "u", 5.0, "b"), (1, "u", 3.0, "a"), (1, "v", 1.0, "a")
    )
    assert values(compare.scenario_diff(df), "Year", "Region") == {(1, "u"): -2.0, (1, "v"): None}
    flipped = compare.scenario_diff(df, ["b", "a"])
    assert values(flipped, "Year", "Region")[(1, "u")] == 2.0
    with pytest.raises(ValueError, match="exactly two"):
        compare.scenario_diff(filters.eq(df, "Scenario", "a"))


def test_net_counts_a_missing_side_as_zero(spark):
    a = symbol(spark, "R", ("u", 5.0, "s"), ("v", 1.0, "s"))
    b = symbol(spark, "R", ("u", 2.0, "s"), ("w", 4.0, "s"))
    assert values(compare.net(a, b, ["R"]), "R") == {"u": 3.0, "v": 1.0, "w": -4.0}
    assert values(compare.net(b, a, ["R"]), "R") == {"u": -3.0, "v": -1.0, "w": 4.0}


# --- ordering and charts


def test_orders(spark):
    df = by_year(spark, ("b", 2, 1.0), ("a", 1, 2.0), ("b", 1, 3.0))
    assert [tuple(r)[:1] for r in ordering.sorted_by(df, "Scenario", "t").select("Value").collect()] == [
        (2.0,), (3.0,), (1.0,)
    ]
    registry = scenario_registry(spark, {"b": "p", "a": "q"})
    assert [r["Value"] for r in ordering.by_registry(df, registry).collect()] == [3.0, 1.0, 2.0]
    assert [r["Scenario"] for r in ordering.by_total_desc(df, "Scenario").collect()] == ["b", "a"]
    assert [r["t"] for r in ordering.reverse_order(df, "t", "Scenario").collect()] == [2, 1, 1]


def test_stack_offsets(spark):
    df = symbol(
        spark, "Year G", (1, "X", 1.0, "s"), (1, "Y", 2.0, "s"), (1, "Z", 4.0, "s"), (1, "Y", 1.0, "s")
    )
    got = values(charts.stack_offsets(df, "G", ["Z", "Y"]), "G", value="bottom")
    assert got == {"Z": 0.0, "Y": 4.0, "X": 7.0}


def test_signed_stacks(spark):
    df = symbol(spark, "Year G", (1, "X", -1.0, "s"), (1, "Y", 2.0, "s"), (1, "Z", -4.0, "s"))
    rows = {r["G"]: r for r in charts.stack_offsets(df, "G", ["X", "Y", "Z"], signed=True).collect()}
    assert (rows["Z"]["negative"], rows["Z"]["bottom_negative"], rows["Z"]["bottom_positive"]) == (-4.0, -1.0, 2.0)


def test_axis_midpoints(spark):
    df = symbol(
        spark, "Year", (1, 1.0, "a"), (2, 1.0, "a"), (3, 1.0, "a"), (1, 1.0, "b"), (2, 1.0, "b")
    )
    assert values(charts.axis_midpoints(df), "Scenario", value="position") == {"a": 1.0, "b": 3.5}


def test_legend_and_style(spark):
    df = symbol(spark, "G", ("X", 1.0, "s"), ("Y", 5.0, "s"), ("X", 1.0, "t"))
    assert [r["G"] for r in charts.legend_order(df, "G").collect()] == ["Y", "X"]
    assert [r["G"] for r in charts.legend_order(df, "G", reverse=True).collect()] == ["X", "Y"]
    styled = charts.series_style(df, "G", {"X": ("#111111", "...", "Ex")}, charts.DEFAULT_GDP_COLOR)
    rows = {(r["G"], r["color"], r["hatch"], r["legend"]) for r in styled.collect()}
    assert rows == {("X", "#111111", "...", "Ex"), ("Y", "#CCCCCC", "", "Y")}


def test_numbered_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("position_of"))
    placed = ordering.numbered(df.repartition(7), "k", name="place")
    assert {r["k"] + 1 for r in placed.filter("place = k + 1").collect()} == set(range(1, 5001))
    assert ordering.sorted_by(df.limit(0), "k", position="p").collect() == []
    hot = spark.range(100).select(F.lit(None).cast("int").alias("k"))
    assert sorted(r["p"] for r in ordering.sorted_by(hot, "k", position="p").collect()) == list(range(1, 101))


def test_membership_in_a_frame(spark):
    df = frame(spark, "G string, Value double", ("X", 1.0), ("Y", 2.0), (None, 3.0), ("X", 4.0))
    labels = frame(spark, "name string", ("X",), ("X",), (None,), ("Z",))
    kept = filters.isin(df, "G", labels)
    assert sorted(r["Value"] for r in kept.collect()) == [1.0, 4.0]
    assert kept.columns == df.columns
    assert "LeftSemi" in kept._jdf.queryExecution().optimizedPlan().toString()


def test_unmatched_conversions_are_counted_while_they_run(spark):
    df = frame(spark, "R string, Value double", ("u", 1.0), ("v", 2.0), (None, 3.0), ("v", 4.0), ("w", 5.0))
    seen = Observation()
    done = joins.convert(df, {"u": 2.0}, observed=seen)
    assert sorted((r["Value"] for r in done.collect()), key=repr) == [0.5, None, None, None, None]
    with pytest.raises(ValueError, match=r"4 of 5 rows: \(missing\), v, w"):
        joins.require_matched(seen)
    matched = Observation()
    joins.convert(df.filter("R = 'u'"), {"u": 2.0}, observed=matched).collect()
    assert joins.require_matched(matched)["unmatched"] == 0
    found = joins.unmatched_rows(df, {"u": 2.0}).collect()
    assert {(r["R"], r["unmatched"]) for r in found} == {("v", 2), ("w", 1), (None, 1)}


def test_first_row_of_a_tie(spark):
    df = frame(spark, "k string, o int, v string", ("a", 1, "y"), ("a", 1, "x"), ("a", None, "w"), ("b", None, "q"))
    assert {tuple(r) for r in joins.first_by(df, ["k"], "o").collect()} == {("a", 1, "x"), ("b", None, "q")}
