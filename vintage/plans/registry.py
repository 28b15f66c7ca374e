"""All queries of the library, by name, and their oracle statements."""

from vintage.plans import analysis as _analysis  # noqa: F401  registers its queries
from vintage.plans import stores as _stores  # noqa: F401  registers its queries
from vintage.plans.core import BODIES, QUERIES
from vintage.plans.sql import statement

ORACLES = {name: statement(body) for name, body in BODIES.items()}

__all__ = ["ORACLES", "QUERIES"]
