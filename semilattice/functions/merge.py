"""Merging prose line by line, and ranks that leave room between any two."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL, MIDDLE, REMOTE = "<<<<<<< LOCAL", "=======", ">>>>>>> REMOTE"


def merge3(base: Column, local: Column, remote: Column) -> Column:
    """The three-way merge of text columns, in built-in functions.

    A side that changed alone wins. Where both did and all three have as many lines, lines merge one by one, and a
    line that both sides changed differently becomes a conflict block; otherwise the whole text becomes one.
    """

    def block(a: Column, b: Column) -> Column:
        return F.concat_ws("\n", F.lit(LOCAL), a, F.lit(MIDDLE), b, F.lit(REMOTE))

    def pick(b: Column, x: Column, y: Column, clash: Column) -> Column:
        return F.when((x == y) | (b == y), x).when(b == x, y).otherwise(clash)

    lines = [F.split(c, "\n", -1) for c in (base, local, remote)]
    rows = F.arrays_zip(*(c.alias(n) for n, c in zip("bxy", lines, strict=True)))
    by_line = F.array_join(F.transform(rows, lambda r: pick(r["b"], r["x"], r["y"], block(r["x"], r["y"]))), "\n")
    even = (F.size(lines[0]) == F.size(lines[1])) & (F.size(lines[0]) == F.size(lines[2]))
    return pick(base, local, remote, F.when(even, by_line).otherwise(block(local, remote)))


def has_conflict(text: Column) -> Column:
    """Whether text carries both of a conflict block's outer marks."""
    return text.contains(LOCAL) & text.contains(REMOTE)


def merge_texts(base: str, local: str, remote: str) -> str:
    """The same merge for plain strings."""

    def settle(b: str, x: str, y: str) -> str | None:
        return x if x == y or b == y else y if b == x else None

    def block(x: str, y: str) -> str:
        return "\n".join((LOCAL, x, MIDDLE, y, REMOTE))

    if (whole := settle(base, local, remote)) is not None:
        return whole
    sides = [t.split("\n") for t in (base, local, remote)]
    if len({len(s) for s in sides}) > 1:
        return block(local, remote)
    return "\n".join(block(x, y) if (got := settle(b, x, y)) is None else got for b, x, y in zip(*sides, strict=True))


# The letters of rank cores, what parts a core from its device, and bounds for other characters.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SEPARATOR = ":"
LOWEST_CHAR = 0x21


def rank_core(rank: str | None) -> str:
    return (rank or "").split(SEPARATOR)[0]


def _number(core: str) -> int:
    """The letters as the digits of a whole number."""
    n = 0
    for c in core:
        n = n * len(LETTERS) + LETTERS.index(c)
    return n


def _between_cores(low: str, high: str | None) -> str:
    """A core between two, which stand for fractions; without ``high`` for one.

    The fewest digits that leave a whole number strictly between the two bounds give the middle one.
    """
    base = len(LETTERS)
    a, b = (_number(low), len(low)), (_number(high), len(high)) if high is not None else (1, 0)
    if a[0] * base ** b[1] >= b[0] * base ** a[1]:
        raise ValueError(f"no room between {low!r} and {high!r}")
    digits = 0
    while True:
        digits += 1
        # the bounds in units of the last digit, the lower one rounded down and the upper one up
        under = a[0] * base**digits // base ** a[1]
        over = -(-b[0] * base**digits // base ** b[1])
        if over - under > 1:
            break
    middle, out = (under + over) // 2, ""
    for _ in range(digits):
        middle, digit = divmod(middle, base)
        out = LETTERS[digit] + out
    return out.rstrip(LETTERS[0])


def _after_text(low: str, high: str) -> str:
    """Text that begins with ``low`` and sorts between the two."""
    if low >= high:
        raise ValueError(f"ranks out of order: {low!r}, {high!r}")
    rest = high.removeprefix(low) if high.startswith(low) else chr(0x7F)
    lead = len(rest) - len(rest.lstrip(chr(LOWEST_CHAR)))
    if lead == len(rest) or ord(rest[lead]) < LOWEST_CHAR:
        raise ValueError(f"no room between {low!r} and {high!r}")
    return low + rest[:lead] + chr((LOWEST_CHAR + ord(rest[lead])) // 2)


def rank_between(low: str | None, high: str | None, device: str = "device") -> str:
    """A rank that sorts strictly between two; None is an open end. Raises ValueError where no rank would."""
    if low is not None and high is not None:
        if low >= high:
            raise ValueError(f"ranks out of order: {low!r}, {high!r}")
        try:
            return _between_cores(rank_core(low), rank_core(high)) + SEPARATOR + device
        except ValueError:  # equal cores, which devices gave at one time
            return _after_text(low, high)
    return _between_cores(rank_core(low), rank_core(high) if high is not None else None) + SEPARATOR + device


@F.pandas_udf(T.StringType())
def rank_between_udf(low: pd.Series, high: pd.Series, device: pd.Series) -> pd.Series:
    """Ranks between two columns; where a pair leaves no room the lower one stays."""

    def one(a: str | None, b: str | None, d: str) -> str | None:
        try:
            return rank_between(a, b, d)
        except ValueError:
            return a

    text = lambda x: x if isinstance(x, str) else None
    return pd.Series([one(text(a), text(b), d) for a, b, d in zip(low, high, device, strict=True)], dtype=object)


def next_ranks(rows: DataFrame, by: list[str], rank: str, device: str) -> DataFrame:
    """``by, next_rank``: of each group the rank behind its last one. Null ranks don't count; a group of none starts anew."""
    return rows.groupBy(*by).agg(F.max(rank).alias("_last")).select(*by, rank_between_udf("_last", F.lit(None).cast("string"), F.lit(device)).alias("next_rank"))


def neighbour_ranks(rows: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Rows with ``before2, before1, after1, after2``: the ranks around each in its group, null beyond an end."""
    w = W.partitionBy(*by).orderBy(rank)
    return rows.withColumns({"before2": F.lag(rank, 2).over(w), "before1": F.lag(rank).over(w), "after1": F.lead(rank).over(w), "after2": F.lead(rank, 2).over(w)})


def moved_ranks(rows: DataFrame, by: list[str], rank: str, device: str) -> DataFrame:
    """Rows with ``rank_up`` and ``rank_down``: what a row's rank becomes if it moves one place, null at that end.

    One place up lies between the row before and the one before that. Rows of equal rank, which nothing lies between,
    keep their rank. A group is ordered by its rank alone; null ranks stand first and don't move.
    """
    w = W.partitionBy(*by).orderBy(rank)
    at = lambda n: F.lag(rank, n).over(w)
    out = rows.withColumns({"_b2": at(2), "_b1": at(1), "_a1": at(-1), "_a2": at(-2)})
    up = F.when(F.col("_b1").isNotNull(), rank_between_udf("_b2", "_b1", F.lit(device)))
    down = F.when(F.col("_a1").isNotNull() & F.col(rank).isNotNull(), rank_between_udf("_a1", "_a2", F.lit(device)))
    return out.withColumns({"rank_up": up, "rank_down": down}).drop("_b2", "_b1", "_a1", "_a2")
