"""SQL text for numbers, coercions and templates."""

from __future__ import annotations

import string

# Characters stripped from both ends of a text.
BLANKS = r"' \t\n\r\u000B\u000C'"


def num(x: float) -> str:
    return f"{float(x)!r}D"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def fixed(e: str, digits: int) -> str:
    """Fixed-point text; exact binary ties go to the even digit."""
    return f"replace(format_number({e}, {digits}), ',', '')"


def grouped(e: str, digits: int) -> str:
    """Fixed-point text with thousands separators."""
    return f"format_number({e}, {digits})"


def exact_round(e: str, digits: int) -> str:
    """Rounded as its exact binary value asks for. Scaled numbers clear of a tie are rounded as
    numbers; only the rest goes through text."""
    scaled = f"({e}) * {num(10 ** digits)}"
    clear = f"abs({scaled}) < 1e12D AND abs(abs({scaled} - floor({scaled})) - 0.5D) > 1e-4D"
    return (f"CASE WHEN {clear} THEN rint({scaled}) / {num(10 ** digits)} "
            f"ELSE try_cast({fixed(e, digits)} AS DOUBLE) END")


def float_or(name: str, default: float = 0.0) -> str:
    return f"coalesce(nullif(try_cast({name} AS DOUBLE), double('NaN')), {num(default)})"


def text_or(name: str, default: str = "N/A") -> str:
    return f"coalesce(nullif(btrim(CAST({name} AS STRING), {BLANKS}), ''), {quoted(default)})"


def filled(template: str, slots: dict[str, str]) -> str:
    """SQL for a text with ``{name}`` slots, each filled by an SQL expression."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(quoted(text))
        if name:
            parts.append(f"({slots[name]})")
    return f"concat({', '.join(parts)})"
