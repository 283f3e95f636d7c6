"""Registered queries: every operator over the driver tables, with equal SQL."""

from . import identity, ingest, journeys, maintenance, metrics, monitoring, search  # noqa: F401
from .registry import REGISTRY  # noqa: F401
