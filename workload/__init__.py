"""The reference's operators as queries over the given tables."""

from workload import access, charset, checks, digests, mapping, merging, parity, ranking, reconciling, reports, transforms, written, discovery, runs  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
