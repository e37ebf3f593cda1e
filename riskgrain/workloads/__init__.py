"""Registered queries over the provided tables."""

from . import (  # noqa: F401
    binning, distribution, enrichment, evaluation, files, models, projection, response, samples, text,
)
from .registry import ORACLES, QUERIES  # noqa: F401
