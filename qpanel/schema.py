"""Column names, key lists and fixed values shared by all operators."""
from __future__ import annotations

# Series key of the consolidated panel and the composite id built from it.
REP, CP, BASIS = "rep", "cp", "basis"
KEYS = [REP, CP, BASIS]
UID = "unique_id"
DS = "ds"            # DateType, quarter-end date
Y = "y"              # DoubleType value
BANK_TYPE = "bank_type"

# Quarter column names of wide tables, strict form, e.g. 2005-Q1.
QUARTER_COL_RE = r"^\d{4}-Q[1-4]$"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# Aggregate / non-country entity names removed from either country column;
# compared after lower-casing and trimming.
AGGREGATE_ENTITIES = [
    "All reporting countries",
    "All countries (total)",
    "All countries excluding residents",
    "Euro area",
    "Developed countries",
    "Developing countries",
    "Developing Asia and Pacific",
    "Developing Europe",
    "Developing Africa and Middle East",
    "Residual developing Europe",
    "Residual developing Africa and Middle East",
    "Unallocated location",
    "Residual British Overseas Territories",
    "Residual West Indies UK",
    "Emerging market and developing economies",
    "European developed countries",
    "Developing Latin America and Caribbean",
    "International organisations",
    "Residents/Local",
]
# Bank types kept for consolidation (domestic, ... ) and the
# null-keeping exclusions / required values of the cleaning step.
BANK_TYPES = ["4B", "4R", "4C", "4O"]
EXCLUDE_EQUAL = {
    "L_MEASURE": "B",
    "Type of instruments": "Derivatives",
    "Remaining maturity": "Up to and including 1 year",
    "Currency type of booking location": "Local currency",
}
REQUIRE_NORMALISED = {
    "Counterparty sector": "all sectors",
    "Balance sheet position": "total claims",
}
# Mapping of the driver's order priority onto bank types (test mapping).
PRIORITY_TO_BANK_TYPE = {
    "1-URGENT": "4B",
    "2-HIGH": "4R",
    "3-MEDIUM": "4C",
    "4-NOT SPECIFIED": "4O",
}
# Code filter of the consolidated-claims extract and its bank types.
REPORTING_CODES = {
    "FREQ": "Q",
    "CURR_TYPE_BOOK": "TO1",
    "L_MEASURE": "S",
    "CBS_BASIS": "F",
    "L_POSITION": "C",
    "L_INSTR": "A",
    "REM_MATURITY": "A",
    "L_CP_SECTOR": "A",
}
EXTRACT_BANK_TYPES = ["4B", "4C", "4O", "4R", "4D", "4E"]
# Annotated quarters of the total-exposure and of the coverage chart (shown
# when present).
INFLECTIONS = {
    "2000-Q4": "Quarterly\nreporting begins",
    "2011-Q4": "New economies\nadded",
}
COVERAGE_EVENTS = {
    "2000-Q4": "Quarterly\nreporting begins",
    "2014-Q4": "New economies\nadded",
}
# ---------------------------------------------------------------------------
