"""Every query of the core by name, with its SQL where SQL can express it."""

from __future__ import annotations

from cairn.plans import extra, measures, more, problems, rest, rows, tables

QUERIES = problems.QUERIES | tables.Q | rows.Q | measures.Q | more.Q | rest.Q | extra.Q
ORACLES = problems.ORACLES | tables.O | rows.O | measures.O | more.O | rest.O | extra.O
