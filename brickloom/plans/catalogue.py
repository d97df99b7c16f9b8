"""Imports every query module so that the registry is complete."""

from brickloom.plans import (  # noqa: F401
    assembly_queries,
    catalog_queries,
    construct_queries,
    sequence_queries,
    source_queries,
    stream_queries,
)
from brickloom.plans.registry import ORACLES, QUERIES  # noqa: F401
