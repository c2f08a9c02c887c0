"""Registered queries of the library's own operators, each with its SQL."""

from . import aggregates, files, geometry, layout, markup, notes, pipelines, processors, render, responses, structure, tables, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
