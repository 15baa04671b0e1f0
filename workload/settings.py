"""Metadata for the star-schema symbols: which label plays which role (see FIXTURES.md)."""

from __future__ import annotations

from dataclasses import replace

from scenfold.metadata import DEFAULT
from scenfold.sources.star import REFINED_OIL

# Divisors; MIDDLE EAST is left out to exercise an unmatched lookup.
DIVISORS = {"AFRICA": 0.08, "AMERICA": 0.20, "ASIA": 0.05, "EUROPE": 0.55}

GENERATION_LABELS = (
    "Coal", "Coal with CCS", "Oil", "Gas", "Gas with CCS", "Nuclear", "Bioenergy", "BECCS",
    "Hydro", "Wind", "Solar",
)
ENERGY_LABELS = ("Coal", "Oil", "Gas", "Bioenergy", "Nuclear", "Hydro", "Renewables")
EMISSION_LABELS = {
    "ECONOMY": "Fossil CO2", "STANDARD": "Process CO2", "LARGE": "AFOLU CO2",
    "MEDIUM": "BECCS", "PROMO": "DACCS", "SMALL": "Non-CO2",
}

META = replace(
    DEFAULT,
    regions={
        "AFRICA": ("Africa", "#16824D"),
        "AMERICA": ("America", "#5492C5"),
        "ASIA": ("Asia", "#493B82"),
        "EUROPE": ("Europe", "#679C82"),
    },
    conversion={"ECONOMY": DIVISORS, "PROMO": DIVISORS},
    gwp={
        "AUTOMOBILE": 28.0, "BUILDING": 265.0, "FURNITURE": 6630.0, "HOUSEHOLD": 23500.0,
        "MACHINERY": 1300.0,
    },
    emission_series={g: (label, "#000000", None) for g, label in EMISSION_LABELS.items()},
    electricity_series={
        f"Brand#{i}": (label, "#000000", None) for i, label in enumerate(GENERATION_LABELS, start=1)
    },
    primary_energy_series={
        f"Brand#{i}": (label, "#000000", None) for i, label in enumerate(ENERGY_LABELS, start=11)
    },
    sector_fuels={
        "ECONOMY": "Diesel", "STANDARD": "Diesel", "LARGE": "Gasoline", "MEDIUM": "Transport",
        "PROMO": "Coke", "SMALL": "Other",
    },
    cement_techs={"N": "NoCCS", "A": "CCS"},
    clinker_techs={
        "AUTOMOBILE": "Clinker", "BUILDING": "Clinker", "FURNITURE": "Fly ash",
        "HOUSEHOLD": "Steel slags",
    },
    liquid_techs={"A": "Fossil", "N": "Biofuels", "R": "Biofuels"},
    steel_carriers={"A": "COAL", "N": "GAS", "R": "ELEC"},
    price_attributes={"co2": "ECONOMY", "ghg": "LARGE"},
    gdp_attribute="STANDARD",
    total_electricity_attribute="MEDIUM",
    electricity="ECONOMY",
    steel="PROMO",
    cement="ECONOMY",
    crude_oil="SMALL",
    refined_oil=REFINED_OIL,
    ethanol_region="AMERICA",
    mass_sectors=("ECONOMY", "PROMO"),
    process_sectors=("PROMO", "SMALL"),
    final_use_sectors=("ECONOMY", "LARGE", "MEDIUM", "PROMO"),
)

#: The same with carrier labels in the carrier roles, for energy balances.
ENERGY_META = replace(META, electricity="A", crude_oil="R", self_use_carriers=("A", "N"))

#: The electricity label among carriers.
ELECTRICITY_CARRIER = "A"

HORIZON = 2000
YEARS = (1996, 1998, 2000)
