"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""
from qpanel.functions.dates import (  # noqa: F401
    quarter_end, quarter_start, quarter_label, label_to_quarter_end,
    quarter_index, seconds_to_hms,
)
from qpanel.functions.numeric import (  # noqa: F401
    finite_or_null, clip, safe_div,
)
