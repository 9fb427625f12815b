"""Small SQL expressions shared by the operators.

Functions here take SQL expressions as text and return one; operators wrap the
result in ``F.expr``.
"""

from __future__ import annotations

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLACEHOLDER = r"(?U)\[PII_\w+_[A-Z]+\]"

# Two messages of one session never share a number as long as a message holds
# fewer entities than this stride.
SEQ_STRIDE = 1 << 24


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def alpha_id(n: str) -> str:
    """Letters-only id of a positive number: 1 -> A, 26 -> Z, 27 -> AA."""
    abc = lit(LETTERS)
    last = f"substr({abc}, cast(({n} - 1) % 26 + 1 as int), 1)"
    # most texts need the first letters only: looked up in a constant
    return f"""case
        when {n} <= 26 then substr({abc}, cast({n} as int), 1)
        when {n} <= 702 then concat(substr({abc}, cast(({n} - 1) div 26 as int), 1), {last})
        else aggregate(
            sequence(1, 14),
            named_struct('n', cast({n} as bigint), 's', ''),
            (a, i) -> if(a.n > 0,
                named_struct(
                    'n', (a.n - 1) div 26,
                    's', concat(substr({abc}, cast((a.n - 1) % 26 + 1 as int), 1), a.s)),
                a),
            a -> a.s)
        end"""


def placeholder(key: str, seq: str) -> str:
    return f"concat('[PII_', upper({key}), '_', {alpha_id(seq)}, ']')"


def placeholders_in(text: str) -> str:
    """Distinct placeholders that occur in a text, in order of first use."""
    return f"array_distinct(regexp_extract_all({text}, {lit(PLACEHOLDER)}, 0))"


def fingerprint(value: str) -> str:
    """First 16 hex digits of the SHA-256 of a value."""
    return f"substr(sha2({value}, 256), 1, 16)"


def session_key(ts: str, key: str) -> str:
    """Deterministic session id from a time and a key."""
    return (
        f"concat('sess_', unix_millis({ts}), '_', substr(sha2(cast({key} as string), 256), 1, 8))"
    )


def luhn_ok(value: str) -> str:
    """Check-digit test of a number."""
    return f"luhn_check({value})"
