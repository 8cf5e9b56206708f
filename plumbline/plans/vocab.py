"""Closed vocabulary of the property graph: kinds, edge types, certainty grades.

A grade is kept as its rank, so the weakest link of a path is ``least`` and the
best of several paths is ``max``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"UNRESOLVED": 0, "RUNTIME_ONLY": 1, "HEURISTIC": 2, "SOUND_SET": 3, "EXACT": 4}
GRADES = {r: g for g, r in RANKS.items()}
NODE_KINDS = ("module", "screen", "endpoint", "symbol", "type", "statement", "table", "column", "domain")
EDGE_TYPES = (
    "HANDLES", "CALLS", "MAY_CALL", "OVERRIDES", "INJECTS", "MAY_INJECT", "IMPLEMENTS_STMT", "EXECUTES", "READS",
    "WRITES", "DECLARES", "JOINS", "CALLS_HTTP", "RENDERS", "IN_DOMAIN", "AFFECTS", "RENDERS_PAGE",
)
FLOW_TYPES = ("HANDLES", "CALLS", "MAY_CALL", "OVERRIDES", "INJECTS", "MAY_INJECT", "IMPLEMENTS_STMT", "EXECUTES", "READS", "WRITES", "CALLS_HTTP", "RENDERS")
SQL_TYPES = ("EXECUTES", "READS", "WRITES")
#: The weakest rank that a query mode still walks.
MODES = {"strict": 4, "conservative": 3, "heuristic": 2}
#: The best rank that a build in this way can give.
CEILINGS = {"BUILD_CAPTURED": 4, "RESOLVED_SOURCE": 4, "SOURCE_ONLY": 2, "LEGACY_HEURISTIC": 2}


def floor_of(mode: str) -> int:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, not {mode!r}")
    return MODES[mode]


def grade_of(rank: Column) -> Column:
    """The grade's name of a rank."""
    out = F.lit(None).cast("string")
    for r, g in GRADES.items():
        out = F.when(rank == r, g).otherwise(out)
    return out


def rank_of(grade: Column) -> Column:
    """The rank of a grade's name; an unknown name fails the query."""
    out = F.raise_error(F.concat(F.lit("unknown grade: "), F.coalesce(grade, F.lit("null")))).cast("int")
    for g, r in RANKS.items():
        out = F.when(grade == g, r).otherwise(out)
    return out


def checked_type(edge_type: Column) -> Column:
    """The edge type itself; one outside the vocabulary fails the query."""
    bad = F.raise_error(F.concat(F.lit("unknown edge type: "), F.coalesce(edge_type, F.lit("null"))))
    return F.when(edge_type.isin(*EDGE_TYPES), edge_type).otherwise(bad)


def classified(call: str = "evidence", ceiling: str = "RESOLVED_SOURCE") -> Column:
    """Grade rank of a call from its evidence, by the first rule that holds, no
    better than ``ceiling``; the last rule makes the table total."""
    e = lambda f: F.col(f"{call}.{f}")
    yes = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    rank = (
        F.when(yes(e("parseFailed")), RANKS["UNRESOLVED"])
        .when(yes(e("reflection")), RANKS["HEURISTIC"])
        .when(F.coalesce(e("candidateCount"), F.lit(0)) == 0, RANKS["UNRESOLVED"])
        .when((e("binding") == "static") & (e("candidateCount") == 1) & ~yes(e("conditional")), RANKS["EXACT"])
        .when(e("binding").isin("static", "virtual", "interface") & (e("candidateCount") >= 1), RANKS["SOUND_SET"])
        .otherwise(RANKS["HEURISTIC"])
    )
    return F.least(rank, F.lit(CEILINGS[ceiling]))


def reconciled(a: Column, b: Column, same: Column) -> Column:
    """Rank of an edge that two lanes report: the weaker of both where they agree
    on the target, else no better than a sound set."""
    return F.when(same, F.least(a, b)).otherwise(F.least(F.lit(RANKS["SOUND_SET"]), F.greatest(a, b)))
