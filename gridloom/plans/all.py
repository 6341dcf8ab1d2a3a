"""Importing this module registers every query."""

from . import closed_form_queries, focal_queries, pixel_queries, spatial_queries, spectral_queries, stats_queries, table_queries, warp_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
