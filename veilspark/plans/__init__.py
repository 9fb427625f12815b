"""The query catalogue."""

from veilspark.plans import detection, governance, masking, streams  # noqa: F401
from veilspark.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
