"""Integer reads from BINARY and hex-text expressions."""

from __future__ import annotations


def be_int(data: str, offset: int, size: int) -> str:
    """Big-endian unsigned integer at a fixed byte offset of a BINARY."""
    return f"CAST(conv(hex(substring({data}, {offset + 1}, {size})), 16, 10) AS BIGINT)"


def chunk(data: str, at: str, size: int) -> str:
    """Hex text of ``size`` bytes at a byte offset (shorter at the end of the data)."""
    return f"hex(substring({data}, CAST({at} + 1 AS INT), {size}))"


def hex_at(digits: str, offset: int, size: int) -> str:
    """Unsigned integer at a fixed byte offset of hex text known to be long enough."""
    return f"CAST(conv(substring({digits}, {offset * 2 + 1}, {size * 2}), 16, 10) AS BIGINT)"


def hex_at_le(digits: str, offset: int, size: int) -> str:
    """Little-endian variant of :func:`hex_at`."""
    swapped = ", ".join(f"substring({digits}, {(offset + i) * 2 + 1}, 2)" for i in reversed(range(size)))
    return f"CAST(conv(concat({swapped}), 16, 10) AS BIGINT)"


def hex_int(digits: str, offset: str, size: int) -> str:
    """Unsigned integer at a computed byte offset of hex text; null when it runs past the end."""
    return (
        f"CASE WHEN {offset} >= 0 AND ({offset} + {size}) * 2 <= length({digits}) THEN"
        f" CAST(conv(substring({digits}, CAST(({offset}) * 2 + 1 AS INT), {size * 2}), 16, 10) AS BIGINT) END"
    )


def has_flag(flags: str, mask: int) -> str:
    return f"(({flags} & {mask}) <> 0)"
