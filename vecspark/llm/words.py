"""Words as every operator here counts them: maximal runs of anything but the six ASCII white-space characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, as Java's and DuckDB's regular expressions take it.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """Compute ``value`` once per row and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> str:
    """A column's name, whatever it holds, for ``select``."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
