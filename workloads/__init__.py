"""Every registered query, imported for its side effect of registering."""

from workloads.registry import ORACLES, QUERIES  # noqa: F401

from workloads import core, combine, measure, discover, jobs, landing  # noqa: F401, E402, I001
