"""All registered queries."""

from logquarry.plans import (  # noqa: F401
    corpus,
    encoding,
    files,
    mining,
    relations,
    sequences,
    profiling,
    rebuild,
    tagging,
)
from logquarry.plans.registry import ORACLES, QUERIES  # noqa: F401
