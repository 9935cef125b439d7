"""Table schemas; none is ever inferred."""

from __future__ import annotations

BUS = "rec_no long, bus_id long, bus_name string, baskv_kv double, ide int, area int, zone int, owner int, vm_pu double, va_deg double"
BRANCH = (
    "rec_no long, bus_i long, bus_j long, ckt string, r_pu double, x_pu double, b_pu double, name string, "
    "ratea_mva double, st int, len_km double"
)
TRANSFORMER = (
    "rec_no long, i long, j long, k long, ckt string, name string, stat int, r12 double, x12 double, s12 double, "
    "r23 double, x23 double, s23 double, r31 double, x31 double, s31 double"
)
GENERATOR = "rec_no long, bus_id long, unit_id string, pg_mw double, stat int, pt_mw double, owner int"
LOAD = "rec_no long, bus_id long, unit_id string, stat int, pl_mw double, ip double, yp double"
OWNER = "rec_no long, owner int, owner_name string"
AREA = "rec_no long, area int, area_name string"
