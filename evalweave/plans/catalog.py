"""All queries of the core and the SQL that each must agree with."""

from __future__ import annotations

from evalweave.plans import evaluation, problems

QUERIES = {**problems.QUERIES, **evaluation.Q}
ORACLE = {**problems.ORACLE, **evaluation.SQL}

#: Run by the driver as a smoke check.
FLAGSHIP = "score_by_category"
