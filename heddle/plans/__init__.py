"""Registered queries over the given tables, and the SQL that checks them."""

from . import counts, details, ledgers, lines, marks, palettes, prints, rasters, recolours, screenings, streams, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
