from civitext.plans.oracle import oracle_sql
from civitext.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
