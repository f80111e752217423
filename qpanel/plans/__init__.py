"""Plan-level helpers: checked broadcasts, test panels from the driver
tables, lineage cuts, and the registry of named queries."""
