"""All registered queries; importing a module registers its queries."""

from kerbline.checks import expressions, joins, occupancy, permits, posting, settlement, staging, visits  # noqa: F401
from kerbline.checks.registry import ORACLES, QUERIES, runnable  # noqa: F401
