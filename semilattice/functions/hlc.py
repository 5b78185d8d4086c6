"""Hybrid logical clock stamps: text whose order is the order of (wall time, counter, device).

A stamp is 15 base-36 digits of milliseconds, 6 of a counter and a device id, joined by hyphens. The column
functions stay in the JVM; ``Clock`` emits stamps on a device.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The widths of the two numbers and the largest integer that a double holds exactly.
WALL_WIDTH, COUNTER_WIDTH = 15, 6
MAX_WALL = 2**53 - 1
MAX_COUNTER = 36**COUNTER_WIDTH - 1
PATTERN = r"^[0-9a-z]{15}-[0-9a-z]{6}-(?s:.+)$"
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def encode(wall_ms: Column, counter: Column, device: Column) -> Column:
    """The stamp of three columns; null where a number is out of range or the device is empty."""

    def digits(x: Column, width: int) -> Column:
        return F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), width, "0")

    fits = wall_ms.between(0, MAX_WALL) & counter.between(0, MAX_COUNTER) & (F.length(device) > 0)
    return F.when(fits, F.concat_ws("-", digits(wall_ms, WALL_WIDTH), digits(counter, COUNTER_WIDTH), device))


def is_stamp(stamp: Column) -> Column:
    """Whether text is a canonical stamp; false for null."""
    return F.coalesce(stamp.rlike(PATTERN) & (wall(stamp) <= MAX_WALL), F.lit(False))


def wall(stamp: Column) -> Column:
    return F.conv(F.substring(stamp, 1, WALL_WIDTH), 36, 10).cast("decimal(20,0)").cast("long")


def counter(stamp: Column) -> Column:
    return F.conv(F.substring(stamp, WALL_WIDTH + 2, COUNTER_WIDTH), 36, 10).cast("long")


def device(stamp: Column) -> Column:
    return F.substring(stamp, WALL_WIDTH + COUNTER_WIDTH + 3, 1 << 30)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; null sorts below every stamp."""
    return F.when(left.eqNullSafe(right), 0).when(left.isNull() | (left < right), -1).otherwise(1)


def base36(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = _DIGITS[r] + out
    return out.rjust(width, "0")


@dataclass(frozen=True, order=True)
class Stamp:
    wall_ms: int
    counter: int
    device: str

    @classmethod
    def parse(cls, text: str) -> Stamp:
        if not re.fullmatch(r"[0-9a-z]{15}-[0-9a-z]{6}-(?s:.+)", text) or int(text[:15], 36) > MAX_WALL:
            raise ValueError(f"not a stamp: {text!r}")
        return cls(int(text[:15], 36), int(text[16:22], 36), text[23:])

    def __str__(self) -> str:
        if not 0 <= self.wall_ms <= MAX_WALL or not 0 <= self.counter <= MAX_COUNTER or not self.device:
            raise ValueError(f"out of range: {self!r}")
        return f"{base36(self.wall_ms, WALL_WIDTH)}-{base36(self.counter, COUNTER_WIDTH)}-{self.device}"

    def settled(self) -> Stamp:
        """A counter too large for its digits carries into the wall time."""
        up, rest = divmod(self.counter, MAX_COUNTER + 1)
        return replace(self, wall_ms=self.wall_ms + up, counter=rest)


class Clock:
    """Emits strictly growing stamps that stay above all it was told of."""

    def __init__(self, device_id: str, now: Callable[[], int] | None = None) -> None:
        self.now = now or (lambda: time.time_ns() // 1_000_000)
        self.last = Stamp(0, 0, device_id)
        self.floor: str | None = None

    def next(self, seen: str | None = None) -> str:
        above = max((s for s in (seen, self.floor) if s is not None), default=None)
        marks = [self.last] + ([Stamp.parse(above)] if above else [])
        at = max(self.now(), *(m.wall_ms for m in marks))
        self.last = Stamp(at, max((m.counter + 1 for m in marks if m.wall_ms == at), default=0), self.last.device).settled()
        return str(self.last)

    def acknowledge(self, stamp: str) -> None:
        """Stays above a stamp without emitting one."""
        if self.floor is None or stamp > self.floor:
            self.floor = stamp

    def observe(self, stamp: str) -> None:
        self.acknowledge(stamp)
        self.next(stamp)

    def highest(self) -> str:
        return max(str(self.last), self.floor or "")

    def restamp(self, server_ms: int) -> str:
        """After a refusal for skew: back to the server's time, yet above what was ever accepted."""
        floor = Stamp.parse(self.floor) if self.floor else None
        at = max(server_ms, floor.wall_ms if floor else 0)
        self.last = Stamp(at, floor.counter + 1 if floor and floor.wall_ms == at else 0, self.last.device).settled()
        return str(self.last)
