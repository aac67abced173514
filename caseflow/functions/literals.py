"""Constant lookups built with a handful of JVM calls.

A CASE chain or an ``array(lit, lit, ...)`` over a fixed list costs one
Py4J round trip per element while the plan is being built; splitting one
joined string literal costs three, and Catalyst folds it to a constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"


def _joined(values) -> str:
    text = [str(v) for v in values]
    if any(SEP in v for v in text):
        raise ValueError("separator inside a value")
    return SEP.join(text)


def str_array(values) -> Column:
    return F.split(F.lit(_joined(values)), SEP)


def int_array(values) -> Column:
    return F.split(F.lit(_joined(values)), SEP).cast("array<int>")


def pick(values, index: Column) -> Column:
    """values[index] for a zero-based integer column (null when out of range)."""
    return F.try_element_at(str_array(values), index.cast("int") + 1)


def index_of(col: Column, values) -> Column:
    """Zero-based position of ``col`` in ``values``; null when absent."""
    pos = F.array_position(str_array(values), col)
    return F.when(pos > 0, (pos - 1).cast("int"))


def lookup(col: Column, mapping: dict) -> Column:
    """mapping[col]; null for a missing key."""
    return F.try_element_at(F.map_from_arrays(str_array(mapping.keys()), str_array(mapping.values())), col)
