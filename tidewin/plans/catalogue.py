"""Every registered query of the windowed-signal engine, with its oracle SQL."""
from . import arrays, audit, auroc, decisions, details, evaluation, joins, planning, robust, series, signals, simulation, sinks, streams, surface  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
