"""Vote values, tallies and majorities as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_vote(vote: Column) -> Column:
    """Lower-case and trimmed, with the usual aliases made one; other values stay, null stays null."""
    v = F.lower(F.trim(vote))
    return F.when(v.isin("yes", "aye"), "yes").when(v.isin("no", "nay"), "no").when(v.isin("abstain", "abstained"), "abstain").otherwise(v)


def votes_of(vote: Column, value: str) -> Column:
    """Aggregate: how many votes have the value."""
    return F.count_if(F.coalesce(vote == value, F.lit(False)))


def majority(yes: Column, no: Column) -> Column:
    """yes, no or tie; null where nobody voted either way."""
    return F.when(yes + no == 0, F.lit(None).cast("string")).when(yes > no, "yes").when(no > yes, "no").otherwise("tie")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null where the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)
