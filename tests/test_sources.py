"""Loading, gates, metadata and output, on real files."""

import pytest
from pyspark.sql import functions as F

from scenfold import load_scenarios
from scenfold.metadata import CONVERSION, DEFAULT, metadata
from scenfold.model import symbol_schema
from scenfold.operators.filters import time_range
from scenfold.sources import symbols
from scenfold.sources.registry import read_entries, scenario_registry
from scenfold.sources.sinks import read_csv, write_csv
from scenfold.sources.symbols import dataset_name
from tests.frames import frame, values


def write_run(spark, folder, name, schema, *rows, fmt="parquet"):
    path = str(folder / (f"{name}.csv" if fmt == "csv" else name))
    writer = frame(spark, schema, *rows).coalesce(1).write
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def test_registry_shapes(spark):
    entries = {"a": "p/a", "b": {"path": "p/b", "case": "1.5"}, "c": {"gdx": "p/c"}, "d": None}
    assert [(s.name, s.path, s.case, s.ord) for s in read_entries(entries)] == [
        ("a", "p/a", None, 0), ("b", "p/b", "1.5", 1), ("c", "p/c", None, 2), ("d", None, None, 3)
    ]
    assert scenario_registry(spark, entries).columns == ["scenario", "case", "path", "ord"]


def test_load(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    agy = "G string, R string, t string, Value double"
    write_run(spark, one, "agy", agy, ("X", "u", "2020", 1.0), ("X", "u", "2010", 9.0), ("X", "u", "?", 9.0))
    write_run(spark, two, "agy", agy, ("X", "u", "2030", float("nan")), ("X", "u", "2100", 3.0))
    # Positional names, an undeclared dimension, and symbols the gates reject.
    raw = "d1 string, d2 string, d3 string, level double"
    write_run(spark, one, "sco2", raw, ("2020", "X", "u", 5.0))
    write_run(spark, two, "sco2", raw, ("2020", "X", "u", 6.0))
    write_run(spark, one, "nmm_out", "* string, R string, t string, Value double", ("ccs", "u", "2020", 1.0))
    write_run(spark, one, "ee_add", "* string, R string, e string, t string, Value double", ("H", "u", "E", "2020", 1.0))
    write_run(spark, one, "uneven", "G string, Value double", ("X", 1.0))
    write_run(spark, two, "uneven", "G string, R string, Value double", ("X", "u", 1.0))
    write_run(spark, one, "blank", "G string, Value double", (None, None), (None, float("nan")))
    write_run(spark, one, "narrow", "Value double", (1.0,))
    table = "a string, b string, c string, v double"
    write_run(spark, two, "data", table, ("GDP", "2050", "u", 7.0), ("GDP", "2150", "u", 7.0))
    write_run(spark, two, "text", agy, ("Y", "u", "2040", 4.0), fmt="csv")

    catalog = load_scenarios(
        spark,
        {"first": str(one), "second": {"path": str(two), "case": "1.5"}, "gone": str(tmp_path / "no")},
        verbose=True,
    )
    assert set(catalog) == {"agy", "sco2", "nmm_out", "ee_add", "data", "text"}
    rows = {(r["Scenario"], r["Case"], r["t"], r["Value"]) for r in catalog["agy"].collect()}
    assert rows == {("first", None, 2020, 1.0), ("second", "1.5", 2030, None), ("second", "1.5", 2100, 3.0)}
    assert catalog["sco2"].columns == ["t", "G", "R", "Value", "Scenario", "Case"]
    assert catalog["nmm_out"].columns[0] == "tech" and catalog["ee_add"].columns[0] == "G"
    assert values(catalog["text"], "G", "t") == {("Y", 2040): 4.0}
    table = symbols.reporting_table(catalog)
    assert table.columns == ["Attribute", "Year", "Region", "Value", "Scenario", "Case"]
    assert values(table, "Year") == {2050: 7.0}
    assert symbols.reporting_table({}) is None
    # A scenario filter leaves only that scenario's files in the plan.
    plan = catalog["agy"].filter("Scenario = 'second'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_empty_part_does_not_spoil_the_schema_gate(spark, tmp_path):
    write_run(spark, tmp_path / "a", "x", "G string, Value double", ("X", 1.0))
    write_run(spark, tmp_path / "b", "x", "G string, R string, Value double", (None, None, None))
    catalog = load_scenarios(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert values(catalog["x"], "Scenario") == {"a": 1.0}


def test_gates(spark):
    a = frame(spark, "G string, Value double", ("X", 1.0))
    b = frame(spark, "Value double, G string", (1.0, "X"))
    assert symbols.same_schema([a, a]) and not symbols.same_schema([a, b])
    assert symbols.has_measure(a) and not symbols.has_measure(symbols.stamp(a.drop("G"), "s", None))
    blank = frame(spark, "G string, Value double", (None, None))
    assert set(symbols.drop_empty({"a": a, "blank": blank, "none": a.limit(0)})) == {"a"}


def test_symbol_store_round_trip(spark, tmp_path):
    df = frame(spark, "G string, t int, Value double, Scenario string, Case string",
               ("X", 2020, 1.0, "2050", None), ("X", 2020, 2.0, "ref", None))
    symbols.save_symbols({"agy": df}, str(tmp_path / "store"))
    stored = symbols.open_symbols(spark, str(tmp_path / "store"))["agy"]
    assert values(stored, "Scenario") == {"2050": 1.0, "ref": 2.0}
    plan = stored.filter("Scenario = 'ref'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Scenario" in plan


def test_csv_sink(spark, tmp_path):
    df = frame(spark, "Attribute string, Year int, Value double", ("GDP", 2020, 1.5))
    write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("GDP", "2020", "1.5")]


def test_metadata_tables(spark):
    sizes = {
        "parameters": 19, "sectors": 22, "regions": 19, "region_series": 18, "conversion": 36,
        "gwp": 5, "emission_series": 6, "primary_energy_series": 7, "electricity_series": 11,
        "emission_factors": 7, "sector_fuels": 16,
    }
    assert {name: metadata(spark, name).count() for name in sizes} == sizes
    assert DEFAULT.region_series["Rest of Europe"] == ("#91C96E", None, "Rest of Europe")
    assert set(CONVERSION["NMM"]) == set(CONVERSION["I_S"]) == set(DEFAULT.regions) - {"global"}
    plan = metadata(spark, "conversion")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation")


def test_known_schema():
    schema = symbol_schema("sco2")
    assert schema.names == ["t", "G", "R", "Value", "Scenario", "Case"]
    assert not schema["Scenario"].nullable


def test_checkpoint_needs_a_shared_folder(spark):
    from scenfold.sources.storage import checkpoint_dir, cut

    assert checkpoint_dir(spark)
    df = cut(frame(spark, "a string", ("x",)))
    assert df.count() == 1
    with pytest.raises(KeyError):
        symbols.open_symbols(spark, checkpoint_dir(spark))["nothing"]


def test_years_written_as_decimals_are_kept(spark):
    df = spark.createDataFrame([("2020.0",), ("2050",), ("2050.5",), ("n/a",), (None,)], "t string")
    assert sorted(r.t for r in time_range(df, "t", 2020, 2100).collect()) == [2020, 2050]
    df = spark.createDataFrame([(2100.7,), (2100.0,), (float("nan"),)], "t double")
    assert [r.t for r in time_range(df, "t", 2020, 2100).collect()] == [2100]


def test_positional_measures_are_cleaned_after_renaming(spark, tmp_path):
    nan = float("nan")
    rows = [(2020, "A", "EUR", 1.0), (2020, "A", "USA", nan), (2020, "B", "USA", 2.0)]
    spark.createDataFrame(rows, "a int, b string, c string, level double").write.parquet(
        f"{tmp_path}/sco2.parquet"
    )
    spark.createDataFrame(
        [("A", "EUR", "2020.0", "3.5"), ("A", "EUR", "2030", "oops")],
        "a string, b string, c string, level string",
    ).write.option("header", True).csv(f"{tmp_path}/etotco2.csv")
    catalog = load_scenarios(spark, {"Ref": str(tmp_path)})
    total = catalog["sco2"].agg(F.sum("Value")).first()[0]
    assert total == 3.0
    found = sorted((r.t, r.Value) for r in catalog["etotco2"].collect())
    assert found == [(2020, 3.5), (2030, None)]


def test_dataset_names():
    assert dataset_name("agy.v2.parquet") == ("agy.v2", "parquet")
    assert dataset_name("agy.csv.gz") == ("agy", "csv")
    assert dataset_name("agy") == ("agy", "parquet")
    assert dataset_name("notes.txt") is None and dataset_name("_SUCCESS") is None


def test_two_datasets_of_one_symbol_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("A", "EUR", 2020, 1.0)], "G string, R string, t int, Value double")
    df.write.parquet(f"{tmp_path}/agy.parquet")
    df.write.option("header", True).csv(f"{tmp_path}/agy.csv")
    with pytest.raises(ValueError, match="two datasets"):
        load_scenarios(spark, {"Ref": str(tmp_path)})


def test_the_reporting_table_is_exported_at_load(spark, tmp_path):
    rows = [("GDP", "2020", "EUR", 1.5)]
    spark.createDataFrame(rows, "Attribute string, Year string, Region string, level double").write.parquet(
        f"{tmp_path}/run/data"
    )
    load_scenarios(spark, {"Ref": f"{tmp_path}/run"}, csv=f"{tmp_path}/out")
    found = spark.read.option("header", True).csv(f"{tmp_path}/out").collect()
    assert [(r.Attribute, r.Year, r.Value, r.Scenario) for r in found] == [("GDP", "2020", "1.5", "Ref")]


def scans(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_many_scenarios_are_one_scan(spark, tmp_path):
    """300 scenarios plan in seconds; a filter on scenario or case opens only its files."""
    import shutil
    import time

    agy = "G string, R string, t string, Value double"
    write_run(spark, tmp_path / "run 0", "agy", agy, ("X", "u", "2020", 1.0))
    for i in range(1, 300):
        shutil.copytree(tmp_path / "run 0", tmp_path / f"run {i}")
    runs = {f"s{i}": {"path": str(tmp_path / f"run {i}"), "case": f"c{i % 3}"} for i in range(300)}
    began = time.time()
    agy = load_scenarios(spark, runs, check_empty=False)["agy"]
    planned = agy.groupBy("Scenario").count()
    assert scans(planned, "executedPlan").count("FileScan") == 1
    assert time.time() - began < 60
    assert {r["Scenario"]: r["count"] for r in planned.collect()} == {s: 1 for s in runs}
    for predicate, n in (("Scenario = 's17'", 1), ("Case = 'c1'", 100), ("Scenario = 'none'", 0)):
        found = agy.filter(predicate)
        assert len(found.collect()) == n
        assert files_read(found) == n
    assert {(r["Scenario"], r["Case"]) for r in agy.filter("Scenario = 's17'").collect()} == {("s17", "c2")}


def files_read(df):
    """Files that the scan of a plan that has run has opened."""
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    scan = leaves.apply(0)
    return scan.metrics().apply("numFiles").value()


def test_scenarios_may_share_a_dataset_or_store_it_otherwise(spark, tmp_path):
    agy = "G string, Value double"
    write_run(spark, tmp_path / "a", "agy", agy, ("X", 1.0))
    write_run(spark, tmp_path / "b", "agy", agy, ("Y", 2.0))
    frame(spark, "G string, p int, Value double", ("Z", 1, 3.0)).write.partitionBy("p").parquet(str(tmp_path / "c" / "agy"))
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "d").mkdir()
    pq.write_table(pa.table({"G": ["W"], "Value": [4.0]}), tmp_path / "d" / "agy.parquet")
    runs = {"a": str(tmp_path / "a"), "twin": {"path": str(tmp_path / "a"), "case": "k"}, "b": str(tmp_path / "b"),
            "d": str(tmp_path / "d")}
    catalog = load_scenarios(spark, runs)
    assert {(r["Scenario"], r["Case"], r["Value"]) for r in catalog["agy"].collect()} == {
        ("a", None, 1.0), ("twin", "k", 1.0), ("b", None, 2.0), ("d", None, 4.0)
    }
    assert values(load_scenarios(spark, {"c": str(tmp_path / "c")})["agy"], "G") == {"Z": 3.0}


def test_emptiness_is_read_from_footers(spark, tmp_path):
    write_run(spark, tmp_path / "a", "x", "G string, Value double", ("X", None))
    write_run(spark, tmp_path / "b", "x", "G string, Value double", (None, float("nan")))
    write_run(spark, tmp_path / "c", "x", "G string, Value double", (None, 2.0))
    write_run(spark, tmp_path / "d", "x", "G string, Value double", (None, None))
    runs = {n: str(tmp_path / n) for n in "abcd"}
    assert set(values(load_scenarios(spark, runs)["x"], "Scenario")) == {"a", "c"}
    part = symbols.read_part(spark, str(tmp_path / "a" / "x"), "parquet")
    counts = symbols.filled_counts(symbols.footer_session(spark), {"a": (str(tmp_path / "a" / "x"), part.schema)})
    assert "PushedAggregation: [COUNT(G), COUNT(Value)]" in counts._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in counts.collect()] == [("a", [1, 0])]


def test_case_prunes_scenario_folders(spark, tmp_path):
    names = ["s1", "s2", "2050"]
    agy = frame(spark, "G string, Value double, Scenario string", *[("X", float(i), n) for i, n in enumerate(names)])
    registry = scenario_registry(spark, {n: {"path": n, "case": c} for n, c in zip(names, ("high", None, "high"))})
    symbols.save_symbols({"agy": agy}, str(tmp_path), registry=registry)
    opened = symbols.open_symbols(spark, str(tmp_path))
    assert set(opened) == {"agy"}
    high = symbols.of_case(opened["agy"], symbols.open_registry(spark, str(tmp_path)), "high")
    assert "dynamicpruning" in high._jdf.queryExecution().executedPlan().toString()
    assert {(r["Scenario"], r["Case"], r["Value"]) for r in high.collect()} == {("s1", "high", 0.0), ("2050", "high", 2.0)}
    assert symbols.of_case(opened["agy"], symbols.open_registry(spark, str(tmp_path)), "low").collect() == []


def test_a_failed_export_leaves_nothing_and_a_rerun_replaces(spark, tmp_path):
    path = str(tmp_path / "out")
    good = frame(spark, "a string, b int", ("x", 1), (None, 2), ("x", 1))
    broken = good.withColumn("b", F.when(F.col("a").isNull(), F.raise_error(F.lit("lost"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="lost"):
        write_csv(broken, path)
    assert list(tmp_path.iterdir()) == []
    assert write_csv(good, path)["rows"] == 3
    with pytest.raises(FileExistsError):
        write_csv(good, path)
    with pytest.raises(Exception, match="lost"):
        write_csv(broken, path, "overwrite")
    assert read_csv(spark, path, "a string, b int", verify=True).count() == 3
    write_csv(good.limit(1), path, "overwrite")
    assert [tuple(r) for r in read_csv(spark, path, "a string, b int", verify=True).collect()] == [("x", 1)]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    extra = next(p for p in (tmp_path / "out").glob("part-*"))
    extra.write_text("a,b\ny,5\n")
    (tmp_path / "out" / f".{extra.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="manifest"):
        read_csv(spark, path, "a string, b int", verify=True)
    with pytest.raises(ValueError, match="columns"):
        read_csv(spark, path, "b int, a string")


def test_gate_report(spark, tmp_path):
    write_run(spark, tmp_path / "a", "x", "G string, Value double", ("X", 1.0))
    write_run(spark, tmp_path / "b", "x", "G string, R string, Value double", ("X", "u", 1.0))
    write_run(spark, tmp_path / "a", "y", "G string, Value double", ("X", 1.0))
    runs = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "none": None}
    assert [tuple(r) for r in symbols.gate_report(spark, runs).collect()] == [
        ("x", False, "different columns across scenarios"), ("y", True, None)
    ]


def test_a_shared_pass_holds_the_grains_of_its_symbols(spark):
    """Those that no other grain holds; not the cells of all dimensions together."""
    from scenfold.sources import star

    sf_dir = "/root/testdata/sf0.001"
    held = []
    names = ["agy", "ghgky", "ei_t", "etotco2", "ish2t_out"]
    original = star.cut
    star.cut = lambda df: held.append(original(df)) or held[-1]
    try:
        catalog = star.shared_catalog(spark, sf_dir, names)
    finally:
        star.cut = original
    specs = [star.SYMBOLS[n] for n in names]
    grains = {frozenset((star.SCENARIO, *s.dims.values(), *s.where_dims)) for s in specs}
    finest = [g for g in grains if not any(g < other for other in grains)]
    rows = star.facts(spark, sf_dir, sorted({c for g in grains for c in g}))
    assert len(finest) == 3
    assert held[0].count() == sum(rows.select(*g).distinct().count() for g in finest)
    for name in names:
        own = star.star_symbol(spark, sf_dir, name)
        assert sorted(map(tuple, catalog[name].select(own.columns).collect())) == sorted(map(tuple, own.collect()))
