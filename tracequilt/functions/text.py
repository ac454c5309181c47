"""Text predicates and labels."""

from __future__ import annotations

from collections.abc import Iterable

from . import any_of, lit

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: str) -> str:
    """Lower-case A-Z only, as the server-side filters do."""
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _fold_ascii(value: str) -> str:
    return value.translate(str.maketrans(_UPPER, _LOWER))


def or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def blank_or_contains(wanted: str | None, x: str) -> str:
    """A blank filter passes everything; otherwise case-insensitive 'contains'."""
    token = (wanted or "").strip()
    return f"contains({ascii_lower(or_empty(x))}, {lit(_fold_ascii(token))})" if token else "true"


def folded_contains(x: str, token: str) -> str:
    """Contains, ignoring case over all of Unicode (the client-side rule)."""
    return f"contains(lower({or_empty(x)}), {lit(token.strip().lower())})"


def any_pattern(x: str, patterns: Iterable[str]) -> str:
    """Some non-blank pattern is a case-insensitive substring of ``x``.

    Patterns are driver-side configuration, so the test runs inside the scan: no join.
    """
    tokens = sorted({_fold_ascii(p.strip()) for p in patterns if p.strip()})
    folded = ascii_lower(or_empty(x))
    if len(tokens) > 8:
        return f"exists(array({', '.join(lit(t) for t in tokens)}), t -> contains({folded}, t))"
    return any_of([f"contains({folded}, {lit(t)})" for t in tokens])


def owner_code(label: str) -> str:
    """Short owner code at the head of a label such as ``US · United States``."""
    norm = f"trim({or_empty(label)})"
    cut = f"CASE WHEN instr({norm}, '·') > 0 THEN instr({norm}, '·') ELSE instr({norm}, ' ') END"
    code = f"trim(CASE WHEN {cut} > 1 THEN substring({norm}, 1, {cut} - 1) ELSE {norm} END)"
    return f"CASE WHEN length({code}) BETWEEN 2 AND 6 THEN upper({code}) ELSE '' END"


def display_name(address: str, owner_label: str, hostname: str, sni: str) -> str:
    """SNI, else PTR name, else address; followed by the owner code when there is one."""
    host = f"trim({or_empty(address)})"
    name = f"coalesce(nullif(trim({or_empty(sni)}), ''), trim({or_empty(hostname)}))"
    shown = f"CASE WHEN {name} <> '' AND lower({name}) <> lower({host}) THEN {name} ELSE {host} END"
    return f"concat_ws(' · ', {shown}, nullif({owner_code(owner_label)}, ''))"


def process_label(name: str, pid: str) -> str:
    return (
        f"CASE WHEN trim({or_empty(name)}) = '' THEN '—' WHEN coalesce({pid}, 0) = 0 THEN {name}"
        f" ELSE concat_ws(' · ', {name}, CAST({pid} AS STRING)) END"
    )


def bundle_name(path: str) -> str:
    """Last path component before the first ``.app``, without the suffix."""
    return f"regexp_extract({or_empty(path)}, '([^/]+?)(?:[.]app)+(?:/|$)', 1)"


def endpoint(ip_text: str, port: str) -> str:
    return f"concat({ip_text}, ':', CAST(coalesce({port}, 0) AS STRING))"


def looks_peer_to_peer(service: str) -> str:
    """Service names of peer-to-peer traffic."""
    from ..constants import SERVICE_NEEDLES

    return f"({any_pattern(service, SERVICE_NEEDLES)} OR {ascii_lower(or_empty(service))} = 'dht')"
