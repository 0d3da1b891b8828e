from gradewell.sources.tables import read_table, TABLES
from gradewell.sources.corpus import responses, case_outcomes

__all__ = ["read_table", "TABLES", "responses", "case_outcomes"]
