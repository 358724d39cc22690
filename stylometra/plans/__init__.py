"""The registered queries of the library itself, and their DuckDB SQL."""

from . import calibrations, chunks, dictionaries, edits, ensembles, evaluations, preparations, queries, rules, structure

_PLANS = (queries, rules, evaluations, structure, dictionaries, edits, preparations, ensembles, chunks, calibrations)
CORE_QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
CORE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
