"""Sets of candidate ids, as arrays in a column: order of first occurrence, no repeats."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersected(ids: Column, selected: Column) -> Column:
    return F.filter(F.array_distinct(ids), lambda x: F.array_contains(selected, x))


def added(current: Column, ids: Column) -> Column:
    return F.array_union(current, ids)


def removed(current: Column, ids: Column) -> Column:
    return F.array_except(current, ids)


def toggled(current: Column, one: Column) -> Column:
    return F.when(F.array_contains(current, one), F.array_except(current, F.array(one))).otherwise(F.array_union(current, F.array(one)))


def has_repeats(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) != F.size(ids)


def within(ids: Column, selected: Column) -> Column:
    return F.size(F.array_except(ids, selected)) == 0


def aliases(name: Column, *others: Column) -> Column:
    """Distinct names that are not blank, the first ones first."""
    return F.array_distinct(F.filter(F.array(name, *others), lambda x: x.isNotNull() & (F.trim(x) != "")))


def ordered_urls(model: Column, explicit: Column) -> Column:
    """URLs of the model that were explicit, in the model's order, then the other explicit ones."""
    return F.array_distinct(F.concat(F.filter(model, lambda x: F.array_contains(explicit, x)), explicit))
