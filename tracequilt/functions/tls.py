"""Server name of a TLS ClientHello, as one SQL expression.

The payload window is read as hex text.  Two bounded folds walk the extension
list and the name list; they run only for rows whose payload looks like a
ClientHello (the CASE guards them), so ordinary packets never pay for them.
"""

from __future__ import annotations

from .. import constants as C
from . import let
from .octets import hex_int

_NONE = "named_struct('pos', CAST({start} AS BIGINT), 'done', false, 'at', -1L, 'size', 0L)"


def _walk(start: str, stop: str, head: int, kind_size: int, wanted: str, steps: int) -> str:
    """First list entry with ``wanted``: struct whose ``at`` is -1 if there is none.

    An entry is ``head`` bytes (type, then a two-byte length) and a body.  One
    that does not fit ends the walk.  ``wanted`` sees ``k`` (type), ``e.pos``
    and ``n`` (length).
    """
    inner = let(
        f"named_struct('n', {hex_int('t', f'e.pos + {kind_size}', 2)}, 'k', {hex_int('t', 'e.pos', kind_size)})", "v",
        let(
            f"coalesce(e.pos + {head} + v.n <= {stop}, false)", "fits",
            let(
                f"coalesce(fits AND {wanted}, false)", "hit",
                f"named_struct('pos', CASE WHEN fits THEN e.pos + {head} + v.n ELSE e.pos END, 'done', NOT fits OR hit,"
                f" 'at', CASE WHEN hit THEN e.pos + {head} ELSE -1L END, 'size', CASE WHEN hit THEN v.n ELSE 0L END)",
            ),
        ),
    )
    return f"aggregate(sequence(1, {steps}), {_NONE.format(start=start)}, (e, i) -> CASE WHEN e.done THEN e ELSE {inner} END)"


def _name(at: str, size: str) -> str:
    """Trimmed text of a list entry; null when it is not UTF-8."""
    raw = f"CAST(unhex(substring(t, CAST(({at}) * 2 + 1 AS INT), CAST(({size}) * 2 AS INT))) AS STRING)"
    return f"regexp_replace(try_validate_utf8({raw}), '^[ \\\\t\\\\r\\\\n\\\\x0B\\\\f]+|[ \\\\t\\\\r\\\\n\\\\x0B\\\\f]+$', '')"


def server_name(payload: str, window: int = C.SNI_WINDOW_DEFAULT) -> str:
    """SNI host name in the first ``window`` bytes of one TCP payload, else null.

    No reassembly: a truncated hello, or anything that is not one, gives null.
    """
    window = max(0, min(window, C.SNI_WINDOW_MAX))
    if window < 9:
        return "CAST(NULL AS STRING)"

    def after(pos: str, width: int) -> str:
        """Position past a length-prefixed field; null when the field leaves the hello."""
        return f"CASE WHEN {pos} + {width} <= z THEN {pos} + {width} + {hex_int('t', pos, width)} END"

    usable = f"v.k = 0 AND {let(_name('e.pos + 3', 'v.n'), 's', f's IS NULL OR octet_length(s) BETWEEN 1 AND {C.SNI_MAX_NAME}')}"
    names = let(
        _walk("x.at + 2", f"least(x.at + 2 + {hex_int('t', 'x.at', 2)}, x.at + x.size)", 3, 1, usable, window // 3 + 1),
        "y", f"CASE WHEN y.at >= 0 THEN {_name('y.at', 'y.size')} END",
    )
    in_extension = f"CASE WHEN x.at >= 0 AND x.size >= 2 THEN {names} END"
    extensions = let(
        _walk("c + 2", f"least(c + 2 + {hex_int('t', 'c', 2)}, z)", 4, 2, "v.k = 0", window // 4 + 1), "x", in_extension
    )
    in_hello = let(
        after("43", 1), "a",
        let(after("a", 2), "b", let(after("b", 1), "c", f"CASE WHEN c + 2 <= z THEN {extensions} END")),
    )
    # 9 bytes of record and handshake header, then at least version and random
    body = let(
        f"least(9 + {hex_int('t', '6', 3)}, length(t) div 2)", "z", f"CASE WHEN z >= 43 THEN {in_hello} END"
    )
    return (
        f"CASE WHEN length({payload}) >= 9 AND substring({payload}, 1, 1) = X'16' AND substring({payload}, 6, 1) = X'01'"
        f" THEN {let(f'hex(substring({payload}, 1, {window}))', 't', body)} END"
    )
