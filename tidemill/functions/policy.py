"""Retry policies as columns: backoff, jitter and exhaustion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
# Attempts, waits before each further one, and jitter of the default policy (fixed values).
DEFAULT_ATTEMPTS = 5
DEFAULT_SCHEDULE = (5 * SECOND, 30 * SECOND, 120 * SECOND, 600 * SECOND)
DEFAULT_JITTER = 0.1


@dataclass(frozen=True)
class Policy:
    max_attempts: int = DEFAULT_ATTEMPTS
    schedule_ns: tuple[int, ...] = DEFAULT_SCHEDULE
    jitter: float = DEFAULT_JITTER

    def column(self) -> Column:
        waits = F.array(*[F.lit(n).cast("bigint") for n in self.schedule_ns]) if self.schedule_ns else F.expr("cast(array() AS array<bigint>)")
        return F.struct(F.lit(self.max_attempts).alias("max_attempts"), waits.alias("schedule_ns"), F.lit(float(self.jitter)).alias("jitter"))


DEFAULT = Policy()


def retry(max_attempts: int, *waits_ns: int) -> Policy:
    """Attempts at given waits, with the default jitter."""
    return Policy(max_attempts, tuple(waits_ns), DEFAULT_JITTER)


def no_retry() -> Policy:
    return Policy(1, (), 0.0)


def attempts_allowed(max_attempts: Column) -> Column:
    return F.when(max_attempts > 0, max_attempts).otherwise(DEFAULT_ATTEMPTS)


def exhausted(attempt: Column, max_attempts: Column) -> Column:
    return attempt >= attempts_allowed(max_attempts)


def backoff(attempt: Column, schedule_ns: Column) -> Column:
    """The wait after an attempt: attempts beyond the schedule take its last one, an empty schedule is the default."""
    default = F.array(*[F.lit(n).cast("bigint") for n in DEFAULT_SCHEDULE])
    waits = F.when(F.size(schedule_ns) > 0, schedule_ns).otherwise(default)
    return F.element_at(waits, F.greatest(F.lit(1), F.least(attempt, F.size(waits))).cast("int"))


def spread(key: Column, attempt: Column) -> Column:
    """A number in [0, 1] that depends on nothing but the item and the attempt, so recomputed tasks agree."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), attempt.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def jittered(base_ns: Column, jitter: Column, unit: Column) -> Column:
    """base * (1 + jitter * (2 * unit - 1)), not below 0, in whole nanoseconds."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor(base_ns * (1 + jitter * (2 * unit - 1))).cast("bigint"))


def bounds(base_ns: Column, jitter: Column) -> tuple[Column, Column]:
    """The least and the largest wait that jitter can give."""
    return (base_ns - base_ns * jitter).cast("bigint"), (base_ns + base_ns * jitter).cast("bigint")


def later(at: Column, ns: Column) -> Column:
    """``at`` plus nanoseconds, in the microseconds that timestamps keep."""
    return F.timestamp_add("MICROSECOND", F.floor(ns / 1000).cast("bigint"), at)
