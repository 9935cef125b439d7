"""Settings of a study and the fixed values of the case format."""

from __future__ import annotations

from dataclasses import dataclass

# Codes of the case format and of the plant register.
FOREIGN_AREAS = {18: "Paraguay", 19: "Chile (SING)", 20: "Brasil", 22: "Bolivia", 99: "Uruguay"}
BUS_TYPES = {1: "PQ", 2: "PV", 3: "slack", 4: "isolated"}
CIRCUIT_LETTERS = {"A": "1", "B": "2", "C": "3", "D": "4", "E": "5"}
OWNER_CARRIERS = {
    4: "ocgt",
    5: "steam",
    6: "hydro",
    7: "diesel",
    8: "ccgt",
    9: "nuclear",
    11: "wind",
    12: "solar",
    13: "biogas",
    14: "biomass",
    15: "battery",
}
NAME_CARRIERS = {
    "TG": "ocgt",
    "TV": "steam",
    "HI": "hydro",
    "DI": "diesel",
    "CC": "ccgt",
    "FV": "solar",
    "EO": "wind",
    "BG": "biogas",
    "BM": "biomass",
    "HB": "pumped_hydro",
}
NUCLEAR_CODE = "NUCL"
PLANT_TYPES = {
    "ocgt": ["TG"],
    "steam": ["TV"],
    "hydro": ["HI", "HR"],
    "diesel": ["DI"],
    "ccgt": ["CC"],
    "nuclear": ["NU"],
    "wind": ["EO"],
    "solar": ["FV"],
    "biogas": ["BG"],
    "biomass": ["BM"],
    "battery": ["BESS"],
    "pumped_hydro": ["HB"],
}
VOLTAGE_CARRIERS = ["nuclear", "hydro", "pumped_hydro", "ccgt", "ocgt", "steam", "biomass", "biogas", "diesel"]
VOLTAGE_CLASSES = [500, 345, 330, 220, 132, 110, 66, 35]
SYSTEM_MVA = 100.0
SRID = 4326


@dataclass(frozen=True)
class Study:
    """What a run keeps, forces and treats as fictitious."""

    kv_low: float = 490.0
    kv_high: float = 530.0
    drop_foreign: bool = True
    excluded_buses: tuple[str, ...] = ()
    keep_out_of_service: bool = True
    force_in_service: bool = True
    fictitious_mw: float = 9990.0
    fictitious_total_mw: float = 9000.0
    default_s_nom: float = 100.0
    normalize_2w: bool = False
