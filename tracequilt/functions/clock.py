"""Time.  Canonical time is ``ts_us``: BIGINT microseconds since the epoch, UTC."""

from __future__ import annotations

MICROS = 1_000_000
DAY = 86_400 * MICROS


def floor_div(x: str, unit: int) -> str:
    """Integer floor division, also before the epoch."""
    return f"(({x} - pmod({x}, {unit})) div {unit})"


def second_of(us: str) -> str:
    """The tick second of an instant."""
    return floor_div(us, MICROS)


def micros_of(seconds: str, micros: str) -> str:
    """(seconds, microseconds) pair to an instant; negative microseconds count as zero."""
    return f"({seconds} * {MICROS} + greatest({micros}, 0))"


def ntz_micros(ts: str) -> str:
    """Microseconds of a TIMESTAMP_NTZ read as UTC, whatever the session zone is."""
    return (
        f"(unix_date(CAST({ts} AS DATE)) * {DAY}L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L"
        f" + CAST(extract(SECOND FROM {ts}) * {MICROS} AS BIGINT))"
    )


def epoch_millis(us: str) -> str:
    return floor_div(us, 1000)


def rfc3339_millis(us: str) -> str:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` in UTC, independent of the session time zone."""
    day = f"date_format(date_from_unix_date(CAST({floor_div(us, DAY)} AS INT)), 'yyyy-MM-dd')"
    ms = f"(pmod({us}, {DAY}) div 1000)"

    def two(x: str) -> str:
        return f"lpad(CAST({x} AS STRING), 2, '0')"

    return (
        f"concat({day}, 'T', {two(f'{ms} div 3600000')}, ':', {two(f'({ms} % 3600000) div 60000')}, ':',"
        f" {two(f'({ms} % 60000) div 1000')}, '.', lpad(CAST({ms} % 1000 AS STRING), 3, '0'), 'Z')"
    )
