"""Model metadata: the fixed tables the analyses look things up in.

Everything an analysis depends on sits in one ``ModelMetadata`` value with defaults, so the same
plans run on other labels by passing ``dataclasses.replace(DEFAULT, ...)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scenfold.functions.literals import literal_frame

# ---------------------------------------------------------------------------
# Parameter catalogue.
# symbol -> (axis label, unit in the model, converter, unit shown, type)
PARAMETERS = {
    "agy": ("Production", "10B$", 1.0, "B$", "quantity"),
    "agy_bt": ("Production", "10B$", 1.0, "B$", "quantity"),
    "sco2": ("Emissions", "MtCO2", 1.0, "MtCO2", "emission"),
    "DPD": ("Domestic price", "(relative value)", 1.0, "(relative value)", "price"),
    "APA": ("Price", "", 1.0, "", "price"),
    "imflow": ("Imports", "B$", 1.0, "B$", "monetary"),
    "impo_t": ("Imports", "B$", 1.0, "B$", "monetary"),
    "exflow": ("Exports", "B$", 1.0, "B$", "monetary"),
    "expo_t": ("Exports", "B$", 1.0, "B$", "monetary"),
    "ACCA": ("Consumption", "B$", 1.0, "B$", "monetary"),
    "cons_is": ("Consumption", "B$", 1.0, "B$", "quantity"),
    "prod_is": ("Production", "B$", 1.0, "B$", "quantity"),
    "etotco2": ("Process CO2 emissions", "MtCO2", 1.0, "MtCO2", "emission"),
    "sk_t": ("Capital", "BUS$", 1.0, "BUS$", "monetary"),
    "sl_t": ("Labor", "BUS$", 1.0, "BUS$", "monetary"),
    "b_crop_t": ("Bioenergy consumption", "EJ", 1.0, "EJ", "monetary"),
    "fb": ("fixed factors", "BUS$", 1.0, "BUS", "monetary"),
    "ci_permits": ("tracking list of parameters", "BUS$", 1.0, "BUS", "monetary"),
    "tdn_t": ("endogenous tax", "BUS$", 1.0, "BUS", "monetary"),
}

# Sectors.
# code -> (name, legend, color, energy carrier, energy carrier in steel)
SECTORS = {
    "NMM": ("cement", "Non-metallic minerals", "#0C5DA5", None, None),
    "I_S": ("steel", "Iron and steel", "#FF9500", None, None),
    "CROP": ("crops", "Crops", "#B03AC2", None, None),
    "LIVE": ("livestock", "Livestock", "#52CE02", None, None),
    "FORS": ("forestry", "Forestry", "#FF2400", None, None),
    "FOOD": ("food", "Food", "#38A7A2", None, None),
    "COAL": ("coal extraction", "Coal mining", "#3B3B3B", "coal", "coal"),
    "ROIL": ("refineries", "Refineries", "#7F4F24", "refined oil", "coke"),
    "COKE": ("coke", "coke", "#7F4F24", "coke", None),
    "OIL": ("oil extraction", "Oil extraction", "#7F4F24", "oil", "oil"),
    "GAS": ("gas extration", "Gas extraction", "#C44536", "gas", "gas"),
    "ELEC": ("power generation", "Power generation", "#FFD700", "electricity", "electricity"),
    "EINT": ("energy-intensive industries", "Other energy-intensive industries", "#808080", None, None),
    "OTHR": ("other industries", "Other industries", "#A52A2A", None, None),
    "SERV": ("services", "Services", "#20B2AA", None, None),
    "TRAN": ("transport", "Transports", "#9370DB", None, None),
    "DWE": ("households", "Residential", "#FF6347", None, None),
    "Exports": ("Exports", "Exports", "#999999", None, None),
    "all": ("all sectors", None, "#A52A2A", None, None),
    "Households": ("Households", "Households", "#777777", None, None),
    "Internal demand": ("Internal demand", "Power self-consumption", "#444444", None, None),
    "Others": ("Others", "Others", "#111111", None, None),
}

# Regions. code -> (name, color)
REGIONS = {
    "IDZ": ("Indonesia", "#B03AC2"),
    "KOR": ("Korea", "#52CE02"),
    "REA": ("Rest of Asia", "#CCBE2C"),
    "LAM": ("Latin America", "#38A7A2"),
    "MES": ("Middle-East", "#D6D092"),
    "AFR": ("Africa", "#16824D"),
    "BRA": ("Brazil", "#16824D"),
    "IND": ("India", "#979576"),
    "CHN": ("China", "#725D7A"),
    "ASI": ("South Asia", "#493B82"),
    "RUS": ("Russia", "#2B4739"),
    "ROE": ("Rest of Europe", "#679C82"),
    "EUR": ("Europe", "#679C82"),
    "ANZ": ("Australia and New-Zealand", "#1B344A"),
    "JPN": ("Japan", "#6E36A4"),
    "MEX": ("Mexico", "#80CDDF"),
    "CAN": ("Canada", "#1D4971"),
    "USA": ("USA", "#5492C5"),
    "global": ("World", "#5492C5"),
}

# Region colors in stacked charts that differ from the table above.
REGION_SERIES_COLORS = {"AFR": "#1A5A2D", "ROE": "#91C96E"}

# Output value -> tonnes divisor per sector and region.
CONVERSION = {
    "NMM": {
        "AFR": 0.0751, "ANZ": 0.2041, "ASI": 0.0546, "BRA": 0.0600, "CAN": 0.1208, "CHN": 0.0470,
        "EUR": 0.5529, "IDZ": 0.0483, "IND": 0.0261, "JPN": 0.1139, "KOR": 0.0691, "LAM": 0.0781,
        "MES": 0.0732, "MEX": 0.0611, "REA": 0.0433, "ROE": 0.0572, "RUS": 0.0642, "USA": 0.1980,
    },
    "I_S": {
        "AFR": 0.2188, "ANZ": 0.4140, "ASI": 0.2914, "BRA": 0.2224, "CAN": 0.2067, "CHN": 0.1919,
        "EUR": 0.2976, "IDZ": 0.2160, "IND": 0.1261, "JPN": 0.3833, "KOR": 0.2356, "LAM": 0.4004,
        "MES": 0.1538, "MEX": 0.1928, "REA": 0.0639, "ROE": 0.1258, "RUS": 0.1087, "USA": 0.2932,
    },
}

# 100-year global warming potentials.
GWP_100Y = {"CH4": 28.0, "N2O": 265.0, "PFC": 6630.0, "SF6": 23500.0, "HFC": 1300.0}

# Electricity generation attributes. attribute -> (label, color, hatch)
ELECTRICITY_SERIES = {
    "22a_coal_no CCS (TWh)": ("Coal", "#3B3B3B", None),
    "22b_coal_CCS (TWh)": ("Coal with CCS", "#3B3B3B", "..."),
    "23_oil (TWh)": ("Oil", "#7F4F24", None),
    "24a_gas_no CCS (TWh)": ("Gas", "#C44536", None),
    "24b_gas_CCS (TWh)": ("Gas with CCS", "#C44536", "..."),
    "25_nuclear (TWh)": ("Nuclear", "#F2C849", None),
    "27a_bioelectricity and other (TWh)": ("Bioenergy", "#287D57", None),
    "27a_bioelectricity_CCS (TWh)": ("BECCS", "#287D57", "..."),
    "26_hydro (TWh)": ("Hydro", "#2E86AB", None),
    "27b_renewables_wind (TWh)": ("Wind", "#66E8E5", None),
    "27c_renewables_solar (TWh)": ("Solar", "#F2EA74", None),
}

# Primary energy attributes. attribute -> (label, color, hatch)
PRIMARY_ENERGY_SERIES = {
    "15_coal (EJ)": ("Coal", "#3B3B3B", None),
    "16_oil (EJ)": ("Oil", "#7F4F24", None),
    "17_gas (EJ)": ("Gas", "#C44536", None),
    "18b_bioenergy (EJ)": ("Bioenergy", "#287D57", None),
    "19_nuclear (EJ)": ("Nuclear", "#F2C849", None),
    "19b_hydro (EJ)": ("Hydro", "#2E86AB", None),
    "20_renewables (wind&solar) (EJ)": ("Renewables", "#91C499", None),
}

# Emission attributes. attribute -> (label, color, hatch)
EMISSION_SERIES = {
    "06a_Pos_CO2_fossil (million ton)": ("Fossil CO₂", "#d73027", None),
    "07_CO2_industrial (million ton)": ("Process CO₂", "#f46d43", None),
    "08_CO2_land use change (million ton)": ("AFOLU CO₂", "#fdae61", None),
    "08b_NE_bioccs": ("CDR - BECCS", "#4575b4", None),
    "08c_NE_daccs": ("CDR - DACCS", "#74add1", None),
    "14a_GHGinCO2eq (million ton)": ("Non-CO₂ emissions", "#66c2a5", None),
}

# Fuel emission factors in kgCO2/GJ.
EMISSION_FACTORS = {
    "Coke": 110.0,
    "Diesel": 70.2,
    "Gasoline": 66.9,
    "Kerosene": 68.4,
    "Ethanol": 0.0,
    "Biofuels": 0.0,
    "Other": 67.0,
}

# Main liquid fuel of each sector that burns refined oil.
SECTOR_FUELS = {
    "COAL": "Diesel",
    "CROP": "Diesel",
    "DWE": "Gasoline",
    "EINT": "Diesel",
    "ELEC": "Diesel",
    "FOOD": "Diesel",
    "FORS": "Diesel",
    "GAS": "Diesel",
    "I_S": "Coke",
    "LIVE": "Diesel",
    "NMM": "Diesel",
    "OIL": "Diesel",
    "OTHR": "Gasoline",
    "ROIL": "Other",
    "SERV": "Gasoline",
    "TRAN": "Transport",
}

# How transport fuel splits (US production mix), and US gasoline blending.
TRANSPORT_SPLIT = {"Transport": {"Gasoline": 0.67, "Diesel": 0.24, "Kerosene": 0.09}}
ETHANOL_BLEND = {"Gasoline": {"Gasoline": 0.9, "Ethanol": 0.1}}

# Technology rows of the mixes. source row -> technology
CEMENT_TECHS = {"noccs": "NoCCS", "ccs": "CCS"}
CLINKER_TECHS = {
    "Non-substitutable clinker": "Clinker",
    "Substitutable clinker": "Clinker",
    "fly ash": "Fly ash",
    "slag": "Steel slags",
}
LIQUID_TECHS = {"fossil": "Fossil", "1stgen": "Biofuels", "2ndgen": "Biofuels"}

# Which carriers the steel fit reads, and under which name.
STEEL_CARRIERS = {"COAL": "COAL", "ROIL": "COAL", "GAS": "GAS", "ELEC": "ELEC"}

# Sector classes and single attributes.
MASS_SECTORS = ("NMM", "I_S")
PROCESS_SECTORS = ("EINT", "NMM", "OIL", "GAS")
FINAL_USE_SECTORS = (
    "DWE", "FORS", "CROP", "LIVE", "NMM", "FOOD", "I_S", "TRAN", "EINT", "OTHR", "SERV",
)
SELF_USE_CARRIERS = ("ELEC", "ROIL", "GAS", "OIL", "COAL")
SUPPLY_FLOWS = ("output", "imports", "exports", "demand")
PRICE_ATTRIBUTES = {
    "co2": "46_CO2 price (US$ per ton CO2)",
    "ghg": "46a_CO2eq price (US$ per ton CO2eq)",
}
GDP_ATTRIBUTE = "01_GDP (billion US$)"
TOTAL_ELECTRICITY_ATTRIBUTE = "28a_TOTAL ELEC (TWh)"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ModelMetadata:
    """Every lookup the analyses use. Field defaults are the model's own tables."""

    parameters: Mapping[str, tuple] = field(default_factory=lambda: PARAMETERS)
    sectors: Mapping[str, tuple] = field(default_factory=lambda: SECTORS)
    regions: Mapping[str, tuple] = field(default_factory=lambda: REGIONS)
    conversion: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: CONVERSION)
    gwp: Mapping[str, float] = field(default_factory=lambda: GWP_100Y)
    emission_series: Mapping[str, tuple] = field(default_factory=lambda: EMISSION_SERIES)
    primary_energy_series: Mapping[str, tuple] = field(default_factory=lambda: PRIMARY_ENERGY_SERIES)
    electricity_series: Mapping[str, tuple] = field(default_factory=lambda: ELECTRICITY_SERIES)
    emission_factors: Mapping[str, float] = field(default_factory=lambda: EMISSION_FACTORS)
    sector_fuels: Mapping[str, str] = field(default_factory=lambda: SECTOR_FUELS)
    cement_techs: Mapping[str, str] = field(default_factory=lambda: CEMENT_TECHS)
    clinker_techs: Mapping[str, str] = field(default_factory=lambda: CLINKER_TECHS)
    liquid_techs: Mapping[str, str] = field(default_factory=lambda: LIQUID_TECHS)
    steel_carriers: Mapping[str, str] = field(default_factory=lambda: STEEL_CARRIERS)
    price_attributes: Mapping[str, str] = field(default_factory=lambda: PRICE_ATTRIBUTES)
    gdp_attribute: str = GDP_ATTRIBUTE
    total_electricity_attribute: str = TOTAL_ELECTRICITY_ATTRIBUTE
    electricity: str = "ELEC"
    steel: str = "I_S"
    cement: str = "NMM"
    crude_oil: str = "OIL"
    refined_oil: str = "ROIL"
    ethanol_region: str = "USA"
    mass_sectors: tuple[str, ...] = MASS_SECTORS
    process_sectors: tuple[str, ...] = PROCESS_SECTORS
    final_use_sectors: tuple[str, ...] = FINAL_USE_SECTORS
    self_use_carriers: tuple[str, ...] = SELF_USE_CARRIERS

    def parameter_type(self, symbol: str) -> str:
        return self.parameters[symbol][4]

    def converter(self, symbol: str) -> float:
        return self.parameters[symbol][2]

    @property
    def region_names(self) -> dict[str, str]:
        return {code: name for code, (name, _) in self.regions.items()}

    @property
    def region_series(self) -> dict[str, tuple]:
        """Chart style of region series: name -> (color, hatch, legend)."""
        return {
            name: (REGION_SERIES_COLORS.get(code, color), None, name)
            for code, (name, color) in self.regions.items()
            if code != "global"
        }


DEFAULT = ModelMetadata()

_TABLES = {
    "parameters": (
        "symbol string, axis string, model_unit string, converter double, unit string, type string",
        lambda m: [(k, *v) for k, v in m.parameters.items()],
    ),
    "sectors": (
        "G string, name string, legend string, color string, carrier string, steel_carrier string",
        lambda m: [(k, *v) for k, v in m.sectors.items()],
    ),
    "regions": (
        "R string, name string, color string",
        lambda m: [(k, *v) for k, v in m.regions.items()],
    ),
    "region_series": (
        "name string, color string, hatch string, legend string",
        lambda m: [(k, *v) for k, v in m.region_series.items()],
    ),
    "conversion": (
        "G string, R string, factor double",
        lambda m: [(g, r, f) for g, per_region in m.conversion.items() for r, f in per_region.items()],
    ),
    "gwp": ("GHG string, gwp double", lambda m: list(m.gwp.items())),
    "emission_series": (
        "Attribute string, label string, color string, hatch string",
        lambda m: [(k, *v) for k, v in m.emission_series.items()],
    ),
    "primary_energy_series": (
        "Attribute string, label string, color string, hatch string",
        lambda m: [(k, *v) for k, v in m.primary_energy_series.items()],
    ),
    "electricity_series": (
        "Attribute string, label string, color string, hatch string",
        lambda m: [(k, *v) for k, v in m.electricity_series.items()],
    ),
    "emission_factors": ("fuel string, factor double", lambda m: list(m.emission_factors.items())),
    "sector_fuels": ("G string, fuel string", lambda m: list(m.sector_fuels.items())),
}


def metadata(spark: SparkSession, name: str, meta: ModelMetadata = DEFAULT) -> DataFrame:
    """SRC-10: a metadata table as a literal DataFrame (a local relation, so joins broadcast it)."""
    schema, rows = _TABLES[name]
    return literal_frame(spark, schema, rows(meta))
