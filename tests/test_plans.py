"""The named analyses with the model's own metadata, on hand-computed frames."""

import pytest

from scenfold.functions.fit import INTENSITIES
from scenfold.metadata import CONVERSION, DEFAULT
from scenfold.plans import (
    balance, energy, inputs, intensity, mixes, parameters, reporting, trade,
)
from tests.frames import catalog, symbol, values

ST = ("Scenario", "t")
SY = ("Scenario", "Year")


# --- parameters


def output(spark):
    return catalog(
        agy=symbol(
            spark, "G R t",
            ("NMM", "USA", 2020, 1.98, "Ref"), ("NMM", "EUR", 2020, 5.529, "Ref"),
            ("NMM", "USA", 2030, 3.96, "Ref"), ("NMM", "USA", 2020, 3.96, "alt"),
            ("SERV", "USA", 2020, 7.0, "Ref"), ("SERV", "EUR", 2020, 8.0, "Ref"),
        ),
        DPD=symbol(
            spark, "G R t", ("SERV", "USA", 2020, 1.0, "Ref"), ("SERV", "EUR", 2020, 2.0, "Ref"),
            ("SERV", "EUR", 2020, 4.0, "Ref"),
        ),
    )


def test_global_output_is_converted_per_region(spark):
    got = values(parameters.grt(output(spark), "agy", "NMM"), *ST)
    assert got == pytest.approx({("Ref", 2020): 20.0, ("Ref", 2030): 20.0, ("alt", 2020): 20.0})


def test_other_sectors_are_not_converted(spark):
    assert values(parameters.grt(output(spark), "agy", "SERV"), "t") == {2020: 15.0}
    assert values(parameters.grt(output(spark), "agy", "SERV", "EUR"), "t") == {2020: 8.0}


def test_prices_and_duplicates_are_averaged(spark):
    assert values(parameters.grt(output(spark), "DPD", "SERV"), "t") == pytest.approx({2020: 7 / 3})
    assert values(parameters.grt(output(spark), "DPD", "SERV", "EUR"), "t") == {2020: 3.0}


def test_regional_sums_equal_the_global_one(spark):
    data = output(spark)
    parts = [values(parameters.grt(data, "agy", "NMM", r), *ST) for r in ("USA", "EUR")]
    whole = values(parameters.grt(data, "agy", "NMM"), *ST)
    for key, value in whole.items():
        assert sum(p.get(key, 0.0) for p in parts) == pytest.approx(value)


def test_comparison_order_and_wide(spark):
    data = output(spark)
    wide = parameters.grt_compare(data, "agy", "NMM", "USA", relative=True, wide=["Ref", "alt"])
    assert wide.columns == ["t", "alt"]
    assert values(wide, "t", value="alt") == pytest.approx({2020: 100.0})
    indexed = parameters.grt_compare(data, "agy", "NMM", "USA", index=True, years=[2030])
    assert values(indexed, *ST) == {("Ref", 2030): 100.0}


def test_axis_labels():
    assert parameters.axis_label("agy") == "Production in B$"
    assert parameters.axis_label("DPD") == "Domestic price"
    assert parameters.axis_label("agy", index=True) == "Production Index=100"


# --- intensity


def emissions(spark):
    cement = CONVERSION["NMM"]["USA"]
    return catalog(
        sco2=symbol(
            spark, "t G R", (2020, "NMM", "USA", 4.0, "Ref"), (2020, "EINT", "USA", 4.0, "Ref"),
            (2020, "ELEC", "USA", 50.0, "Ref"), (2020, "ROIL", "USA", 6.0, "Ref"),
            (2020, "OIL", "USA", 1.0, "Ref"), (2020, "NMM", "USA", 3.0, "alt"),
        ),
        etotco2=symbol(
            spark, "G R t", ("NMM", "USA", 2020, 6.0, "Ref"), ("OIL", "USA", 2020, 0.5, "Ref")
        ),
        agy=symbol(spark, "G R t", ("ELEC", "USA", 2020, 100.0, "Ref")),
        agy_bt=symbol(
            spark, "G R t", ("NMM", "USA", 2020, 5.0 * cement, "Ref"),
            ("NMM", "USA", 2020, 5.0 * cement, "alt"), ("EINT", "USA", 2020, 2.0, "Ref"),
            ("ELEC", "USA", 2020, 9.0, "Ref"), ("ROIL", "USA", 2020, 2.0, "Ref"),
        ),
        ei_t=symbol(
            spark, "e G R t", ("ELEC", "NMM", "USA", 2020, 10.0, "Ref"),
            ("ELEC", "ROIL", "USA", 2020, 4.0, "Ref"), ("GAS", "ROIL", "USA", 2020, 99.0, "Ref"),
        ),
        ghgky=symbol(
            spark, "GHG G R t", ("CH4", "NMM", "USA", 2020, 500.0, "Ref"),
            ("N2O", "NMM", "USA", 2020, 100.0, "Ref"), ("new", "NMM", "USA", 2020, 1.0, "Ref"),
        ),
        ejoe=symbol(
            spark, "G R", ("ROIL", "USA", 0.5, "Ref"), ("ROIL", "EUR", 1.5, "Ref"),
        ),
        liquids=symbol(
            spark, "tech R t", ("fossil", "USA", 2020, 10.0, "Ref"),
            ("1stgen", "USA", 2020, 2.0, "Ref"), ("2ndgen", "USA", 2020, 4.0, "Ref"),
            ("other", "USA", 2020, 9.0, "Ref"),
        ),
        e_aai=symbol(
            spark, "e G R t", ("ROIL", "TRAN", "USA", 2020, 5.0, "Ref"),
            ("ROIL", "DWE", "USA", 2020, 3.0, "Ref"), ("ROIL", "I_S", "USA", 2020, 2.0, "Ref"),
            ("ROIL", "unknown", "USA", 2020, 7.0, "Ref"), ("GAS", "DWE", "USA", 2020, 7.0, "Ref"),
        ),
        data=symbol(
            spark, "Attribute Year Region", ("28a_TOTAL ELEC (TWh)", 2020, "USA", 25.0, "Ref")
        ),
    )


def test_scope1_counts_absent_process_emissions_as_zero(spark):
    got = values(intensity.intensity(emissions(spark), "NMM", "USA"), "Scenario", value="scope1")
    assert got == pytest.approx({"Ref": 2000.0, "alt": 600.0})
    bare = intensity.intensity(emissions(spark), "NMM", "USA", process=False)
    assert values(bare, "Scenario", value="scope1") == pytest.approx({"Ref": 800.0, "alt": 600.0})


def test_other_gases_are_weighted(spark):
    df = intensity.intensity(emissions(spark), "NMM", "USA", ghg=True, process=False)
    expected = (4.0 + (500 * 28 + 100 * 265) / 1000) / 5.0 * 1000
    assert values(df, "Scenario", value="scope1")["Ref"] == pytest.approx(expected)
    globally = intensity.intensity(emissions(spark), "NMM", ghg=True, process=False)
    assert values(globally, "Scenario", value="scope1")["Ref"] == pytest.approx(expected)


def test_factor_falls_back_to_one_in_a_region(spark):
    df = intensity.intensity(emissions(spark), "EINT", "USA")
    assert values(df, "Scenario", value="scope1") == {"Ref": 2.0}


def test_global_factor_is_the_mean_over_regions(spark):
    df = intensity.intensity(emissions(spark), "ROIL")
    assert values(df, "Scenario", value="scope1") == {"Ref": 3.0}


def test_electricity_is_per_generation(spark):
    data = emissions(spark)
    df = intensity.intensity(data, "ELEC", "USA", reporting=data["data"])
    assert values(df, "Scenario", value="scope1") == {"Ref": 2000.0}
    with pytest.raises(ValueError, match="reporting"):
        intensity.intensity(data, "ELEC")


def test_scope2_and_missing_additions(spark):
    data = emissions(spark)
    assert values(intensity.scope2(data, "NMM", "USA"), "Scenario") == {"Ref": 5.0}
    df = intensity.intensity(data, "NMM", "USA", with_scope2=True)
    got = values(df, "Scenario", value="scope12")
    assert got["Ref"] == pytest.approx(3000.0) and got["alt"] is None


def test_all_scopes_of_refining(spark):
    data = emissions(spark)
    df = intensity.intensity(data, "ROIL", "USA", with_scope2=True, with_scope3=True)
    row = df.first()
    assert row["scope1"] == pytest.approx(6.0 / (2 * 0.5))
    assert row["scope12"] == pytest.approx((6.0 + 2.0 + 1.5) / (2 * 0.5))
    fuels = {"Gasoline": (3 + 5 * 0.67) * 0.9, "Ethanol": (3 + 5 * 0.67) * 0.1,
             "Diesel": 5 * 0.24, "Kerosene": 5 * 0.09, "Coke": 2.0, "Biofuels": 6.0}
    factors = DEFAULT.emission_factors
    burning = sum(v * factors[f] for f, v in fuels.items()) / sum(fuels.values())
    assert row["scope123"] == pytest.approx(row["scope12"] + burning)
    bands = intensity.scope_bands(df).collect()
    assert [(b["band"], b["lower"], b["upper"]) for b in bands] == [
        ("scope12", row["scope1"], row["scope12"]), ("scope123", row["scope12"], row["scope123"])
    ]
    with pytest.raises(ValueError, match="any_sector"):
        intensity.intensity(data, "NMM", with_scope3=True)


# --- mixes


def test_liquids(spark):
    data = emissions(spark)
    shares = values(mixes.fuel_shares(data, "USA"), "fuel", value="share")
    assert shares == pytest.approx({"Gasoline": 0.635, "Diesel": 0.12, "Kerosene": 0.045, "Coke": 0.2})
    assert sum(shares.values()) == pytest.approx(1.0)
    got = values(mixes.liquids_mix(data, "USA"), "Technology")
    assert got == pytest.approx(
        {"Gasoline": 5.715, "Ethanol": 0.635, "Diesel": 1.2, "Kerosene": 0.45, "Coke": 2.0, "Biofuels": 6.0}
    )
    averaged = values(mixes.liquids_mix(data, "USA", biofuel_agg="mean"), "Technology")
    assert averaged["Biofuels"] == 3.0 and averaged["Gasoline"] == pytest.approx(5.715)
    world = values(mixes.liquids_mix(data), "Technology")
    assert "Ethanol" not in world and world["Gasoline"] == pytest.approx(6.35)


def test_cement_and_clinker(spark):
    c = CONVERSION["NMM"]
    data = catalog(
        nmm_out=symbol(
            spark, "tech R t", ("noccs", "USA", 2020, 3 * c["USA"], "Ref"),
            ("noccs", "EUR", 2020, 4 * c["EUR"], "Ref"), ("ccs", "USA", 2020, 5 * c["USA"], "Ref"),
            ("Substitutable clinker", "USA", 2020, c["USA"], "Ref"),
            ("Non-substitutable clinker", "USA", 2020, c["USA"], "Ref"),
            ("slag", "USA", 2020, c["USA"], "Ref"), ("fly ash", "EUR", 2020, c["EUR"], "Ref"),
            ("unused", "USA", 2020, 1.0, "Ref"),
        )
    )
    assert values(mixes.cement_mix(data), "Technology") == pytest.approx({"NoCCS": 7.0, "CCS": 5.0})
    assert values(mixes.cement_mix(data, "EUR"), "Technology") == pytest.approx({"NoCCS": 4.0})
    assert values(mixes.clinker_mix(data), "Technology") == pytest.approx(
        {"Clinker": 2.0, "Steel slags": 1.0, "Fly ash": 1.0}
    )


def steel(spark, **extra):
    """Energy of a known mix: shares (0.2, 0.03, 0.77) of 2000 Mt."""
    coal, gas, elec = (float(v) for v in INTENSITIES @ [0.2, 0.03, 0.77])
    factor = CONVERSION["I_S"]["USA"]
    return catalog(
        agy=symbol(spark, "G R t", ("I_S", "USA", 2020, 2000 * factor, "Ref")),
        ee_sect=symbol(
            spark, "G R e t", ("I_S", "USA", "COAL", 2020, 2 * coal - 1, "Ref"),
            ("I_S", "USA", "ROIL", 2020, 1.0, "Ref"), ("I_S", "USA", "GAS", 2020, 2 * gas, "Ref"),
            ("I_S", "USA", "ELEC", 2020, 2 * elec, "Ref"), ("I_S", "USA", "bio", 2020, 9.0, "Ref"),
        ),
        **extra,
    )


def test_steel(spark):
    mix = values(mixes.steel_mix(steel(spark), "USA"), "Technology")
    assert mix == pytest.approx({"BF-BOF": 400.0, "NG DRI-EAF": 60.0, "Scrap EAF": 1540.0})
    assert values(mixes.steel_mix(steel(spark)), "Technology") == pytest.approx(mix)
    h2 = symbol(spark, "R t", ("USA", 2020, CONVERSION["I_S"]["USA"] * 3, "Ref"), ("EUR", 2020, 1.0, "Ref"))
    with_h2 = values(mixes.steel_mix(steel(spark, ish2t_out=h2), "USA"), "Technology")
    assert with_h2["DRI-H2 CCS"] == pytest.approx(3.0) and "DRI-EAF CCS" not in with_h2
    row = mixes.steel_intensity(steel(spark), "USA").first()
    assert [row[c] for c in ("COAL", "GAS", "ELEC")] == pytest.approx(list(INTENSITIES @ [0.2, 0.03, 0.77]))


# --- trade


def flows(spark):
    return catalog(
        trad_t=symbol(
            spark, "G R RR t", ("I_S", "USA", "EUR", 2020, 5.0, "Ref"),
            ("I_S", "EUR", "USA", 2020, 2.0, "Ref"), ("I_S", "USA", "USA", 2020, 7.0, "Ref"),
            ("I_S", "CHN", "USA", 2020, 4.0, "Ref"), ("I_S", "EUR", "CHN", 2020, 9.0, "Ref"),
            ("I_S", "USA", "EUR", 2020, 6.0, "alt"), ("NMM", "USA", "EUR", 2020, 1.0, "Ref"),
        )
    )


def test_gross_and_net_trade(spark):
    data = flows(spark)
    ref = lambda df: {r["Region"]: r["Value"] for r in df.collect() if r["Scenario"] == "Ref"}
    assert ref(trade.trade_by_region(data, "I_S", "USA", "imports")) == {"Europe": 5.0, "USA": 7.0}
    assert ref(trade.trade_by_region(data, "I_S", "USA", "exports")) == {"Europe": 2.0, "USA": 7.0, "China": 4.0}
    net = ref(trade.trade_by_region(data, "I_S", "USA", "imports", net=True))
    assert net == {"Europe": 3.0, "USA": 0.0, "China": -4.0}
    assert ref(trade.trade_by_region(data, "I_S", "USA", "exports", net=True)) == {
        k: -v for k, v in net.items()
    }
    share = ref(trade.trade_by_region(data, "I_S", "USA", "imports", percent=True))
    assert share == pytest.approx({"Europe": 500 / 12, "USA": 700 / 12})
    with pytest.raises(ValueError, match="imports"):
        trade.trade_by_region(data, "I_S", "USA", "both")


def test_trade_by_scenario(spark):
    data = flows(spark)
    run = lambda **kw: values(trade.trade_by_scenario(data, "I_S", "USA", "imports", **kw), "Scenario")
    assert run() == {"Ref": 12.0, "alt": 6.0}
    assert run(world=True) == {"Ref": 27.0, "alt": 6.0}
    assert run(net=True) == {"Ref": -1.0, "alt": 6.0}
    assert run(relative=True) == {"alt": -50.0}
    assert run(index=True) == {"Ref": 100.0, "alt": 100.0}


def test_trade_difference(spark):
    df = trade.trade_by_region(flows(spark), "I_S", "USA", "imports", difference=["alt", "Ref"])
    assert values(df, "Region") == {"Europe": 1.0, "USA": None}


# --- reporting


def test_reporting_profiles(spark):
    table = symbol(
        spark, "Attribute Year Region", ("15_coal (EJ)", 2020, "USA", 3.0, "Ref"),
        ("15_coal (EJ)", 2020, "EUR", 4.0, "Ref"), ("17_gas (EJ)", 2060, "USA", 1.0, "Ref"),
        ("07_CO2_industrial (million ton)", 2020, "USA", 1500.0, "Ref"),
        ("01_GDP (billion US$)", 2020, "USA", 2000.0, "Ref"),
        ("01_GDP (billion US$)", 2020, "EUR", 1000.0, "Ref"),
        ("46_CO2 price (US$ per ton CO2)", 2020, "USA", 10.0, "Ref"),
        ("46_CO2 price (US$ per ton CO2)", 2020, "EUR", 30.0, "Ref"),
    )
    df = reporting.primary_energy(table, horizon=2050)
    assert df.columns == ["Scenario", "Year", *[s[0] for s in DEFAULT.primary_energy_series.values()]]
    assert df.first()["Coal"] == 7.0 and df.first()["Gas"] is None
    assert reporting.primary_energy(table, ["USA"], 2050).first()["Coal"] == 3.0
    assert values(reporting.primary_energy(table, wide=False), "Year", "Series") == {
        (2020, "Coal"): 7.0, (2060, "Gas"): 1.0
    }
    assert reporting.emissions(table).first()["Process CO₂"] == 1.5
    assert reporting.electricity(table).count() == 0
    assert values(reporting.gdp(table), "Year") == {2020: 3.0}
    assert values(reporting.gdp(table, region="EUR"), "Year") == {2020: 1.0}
    assert values(reporting.gdp(table, by="region", region="EUR"), "Region") == {"USA": 2.0, "Europe": 1.0}
    assert values(reporting.emission_price(table, "co2"), "Year") == {2020: 20.0}
    with pytest.raises(ValueError):
        reporting.emission_price(table, "ch4")
    with pytest.raises(ValueError):
        reporting.gdp(table, by="planet")
    assert values(reporting.attribute(table, "15_coal (EJ)"), "Year") == {2020: 7.0}
    assert values(reporting.attribute(table, "15_coal (EJ)", "EUR"), "Year") == {2020: 4.0}


# --- energy, inputs, supply and demand


def balances(spark):
    return catalog(
        ee_sect=symbol(
            spark, "G R e t", ("I_S", "USA", "ELEC", 2020, 3.6, "Ref"), ("I_S", "USA", "OIL", 2020, 9.0, "Ref"),
            ("I_S", "USA", "GAS", 2020, 1.0, "Ref"), ("SERV", "USA", "ELEC", 2020, 7.2, "Ref"),
            ("ELEC", "USA", "ELEC", 2020, 5.0, "Ref"), ("SERV", "EUR", "ELEC", 2020, 3.6, "Ref"),
        ),
        ee_add=symbol(
            spark, "G R e t", ("Internal demand", "USA", "ELEC", 2020, 7.2, "Ref"),
            ("Internal demand", "USA", "ELEC", 2060, 7.2, "Ref"),
        ),
        expo_t=symbol(spark, "G R t", ("ELEC", "USA", 2020, 3.6, "Ref"), ("GAS", "USA", 2020, 3.6, "Ref")),
        ejoe=symbol(spark, "G R", ("ELEC", "USA", 0.5, "Ref"), ("GAS", "USA", 2.0, "Ref")),
    )


def test_energy_use(spark):
    data = balances(spark)
    steel_use = energy.energy_use(data, "I_S", "USA", "all")
    assert values(steel_use, "e") == {"ELEC": 3.6, "GAS": 1.0}
    shares = values(energy.energy_use(data, "I_S", "USA", "all", percent=True), "e")
    assert sum(shares.values()) == pytest.approx(100.0)
    power = energy.energy_use(data, "all", "USA", "ELEC", 2050)
    assert values(power, "G") == pytest.approx({"I_S": 1000.0, "SERV": 2000.0, "Internal demand": 1000.0})
    with_exports = energy.energy_use(data, "all", "USA", "ELEC", 2050, exports=True, primary=True)
    assert values(with_exports, "G") == pytest.approx(
        {"I_S": 1000.0, "SERV": 2000.0, "ELEC": 5000 / 3.6, "Internal demand": 1000.0, "Exports": 500.0}
    )
    sold_gas = dict(exports=True, export_factor="ELEC")
    gas = values(energy.energy_use(data, "all", "USA", "GAS", **sold_gas), "G")
    assert gas == pytest.approx({"I_S": 1.0, "Exports": 1.8})
    assert values(energy.energy_use(data, "SERV", "all", "ELEC"), "R") == pytest.approx({"USA": 2000.0, "EUR": 1000.0})
    wide = energy.energy_use(data, "I_S", "USA", "all", wide=True)
    assert wide.columns == ["Scenario", "Year", "ELEC", "GAS"]
    with pytest.raises(ValueError, match="carrier"):
        energy.energy_use(data, "all", "USA", "all", exports=True)


def test_inputs(spark):
    data = catalog(
        AAI=symbol(
            spark, "ne G R t", ("SERV", "NMM", "USA", 2020, 1.0, "Ref"), ("OTHR", "NMM", "EUR", 2020, 2.0, "Ref"),
            ("SERV", "I_S", "USA", 2020, 4.0, "Ref"), ("SERV", "NMM", "USA", 2060, 8.0, "Ref"),
        )
    )
    assert values(inputs.inputs(data, horizon=2050), "t") == {2020: 70.0}
    assert values(inputs.inputs(data, "NMM", "SERV", "USA"), "t") == {2020: 10.0, 2060: 80.0}
    assert values(inputs.inputs_breakdown(data, "NMM", horizon=2050), "ne") == {"SERV": 10.0, "OTHR": 20.0}
    wide = inputs.inputs_breakdown(data, "NMM", "USA", 2050, wide=["OTHR", "SERV"])
    assert tuple(wide.first()) == ("Ref", 2020, None, 10.0)


def test_supply_and_demand(spark):
    row = lambda comm, flow, v, s="Ref", y=2020: ("I_S", "USA", y, comm, flow, v, s)
    data = catalog(
        sd=symbol(
            spark, "Sector Region Year comm flow", row("supply", "output", 8.0), row("supply", "imports", 2.0),
            row("supply", "exports", 3.0), row("demand", "demand", 7.0), row("supply", "output", 12.0, "alt"),
            row("supply", "output", 16.0, "Ref", 2030), row("supply", "stocks", 99.0),
        )
    )
    run = lambda **kw: values(balance.supply_demand(data, "I_S", "USA", **kw), *SY)
    assert run()[("Ref", 2020)] == 5.0
    assert run(agg="sum")[("Ref", 2020)] == 20.0
    only = dict(flow=["output"])
    assert run(relative=True, **only) == {("alt", 2020): 50.0}
    assert run(index=True, relative=True, **only) == {
        ("Ref", 2020): 100.0, ("Ref", 2030): 200.0, ("alt", 2020): 100.0
    }
    assert run(years=[2030], **only) == {("Ref", 2030): 16.0}
    rows = balance.supply_demand_flows(data, "I_S", "USA", horizon=2020).orderBy("Scenario").collect()
    assert [tuple(r) for r in rows] == [("Ref", 2020, 8.0, 2.0, -3.0, 7.0), ("alt", 2020, 12.0, None, None, None)]
