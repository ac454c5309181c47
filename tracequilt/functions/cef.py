"""CEF bodies and RFC 5424 lines."""

from __future__ import annotations

from .. import constants as C
from . import clock, lit


def escape_header(x: str) -> str:
    """Backslash and pipe escaped; line breaks become spaces."""
    return f"translate(replace(replace({x}, '\\\\', '\\\\\\\\'), '|', '\\\\|'), '\\r\\n', '  ')"


def escape_value(x: str) -> str:
    """Backslash and '=' escaped; LF becomes ``\\n`` and CR is dropped."""
    return (
        f"replace(replace(replace(replace({x}, '\\\\', '\\\\\\\\'), '=', '\\\\='), '\\n', '\\\\n'), '\\r', '')"
    )


def pair(key: str, x: str, only_if: str | None = None) -> str:
    """``key=value``, or null (left out) when the value is empty or the condition false."""
    value = f"coalesce(CAST({x} AS STRING), '')"
    test = f"{value} <> ''" + (f" AND ({only_if})" if only_if else "")
    return f"CASE WHEN {test} THEN concat({lit(key + '=')}, {escape_value(value)}) END"


def label(key: str, text: str, only_if: str | None = None) -> str:
    """A constant ``key=text``."""
    return f"CASE WHEN {only_if} THEN {lit(f'{key}={text}')} END" if only_if else lit(f"{key}={text}")


def _by_label(table: dict[str, int], default: int, severity: str) -> str:
    whens = []
    for number in sorted(set(table.values())):
        names = ", ".join(lit(n) for n, v in table.items() if v == number)
        whens.append(f"WHEN lower(trim({severity})) IN ({names}) THEN {number}")
    return f"CASE {' '.join(whens)} ELSE {default} END"


def severity_0_10(severity: str) -> str:
    return _by_label(C.CEF_SEVERITY, C.CEF_SEVERITY_DEFAULT, severity)


def severity_0_7(severity: str) -> str:
    return _by_label(C.SYSLOG_SEVERITY, C.SYSLOG_SEVERITY_DEFAULT, severity)


def header(device: tuple[str, str, str], signature: str, name: str, severity: str, pairs: list[str]) -> str:
    """``CEF:0|vendor|product|version|signature|name|severity|extension``."""
    fixed = ", ".join(escape_header(lit(part)) for part in device)
    return (
        f"concat_ws('|', 'CEF:0', {fixed}, {escape_header(signature)}, {escape_header(name)},"
        f" CAST(least({severity}, 10) AS STRING), concat_ws(' ', {', '.join(pairs)}))"
    )


def syslog_line(body: str, severity: str, at_us: str, host: str, app: str, facility: int = C.SYSLOG_FACILITY) -> str:
    """``<PRI>1 TIMESTAMP HOST APP - - BODY``."""
    sender = lit(f" {host} {app.strip() or 'traffic-monitor'} - - ")
    return (
        f"concat('<', CAST({facility * 8} + {severity} AS STRING), '>1 ', {clock.rfc3339_millis(at_us)}, {sender}, {body})"
    )
