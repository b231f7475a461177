"""Every query of the library but those of the llm subpackage, and its SQL."""

from __future__ import annotations

from vdjloom.plans import composition, files, problems, repertoire

QUERIES = {**repertoire.QUERIES, **composition.QUERIES, **files.QUERIES, **problems.QUERIES}
ORACLE = {**repertoire.ORACLE, **composition.ORACLE, **files.ORACLE, **problems.ORACLE}
