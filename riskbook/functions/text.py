"""SQL text of names and literals."""

from __future__ import annotations


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_literal(value: float) -> str:
    return f"double('{float(value)!r}')"
