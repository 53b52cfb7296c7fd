"""ravenhunt: threat-hunting analytics as Spark DataFrame plans.

Logs are normalised to one fixed schema, detection rules are compiled into
Column expressions evaluated in a single scan, findings are enriched with
ATT&CK technique details by a size-checked broadcast join, and summaries,
indicator extraction and exports are ordinary aggregations and projections.
"""

from ravenhunt.schemas import (  # noqa: F401
    FINDING_COLUMNS,
    FINDING_SCHEMA,
    IOC_SCHEMA,
    LOG_COLUMNS,
    LOG_SCHEMA,
    RULE_SCHEMA,
    TECHNIQUE_SCHEMA,
)

__version__ = "0.1.0"
