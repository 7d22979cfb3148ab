"""Strict JSON in Arrow batches: helpers for the operators that walk nested records."""

from __future__ import annotations

import json


def _no_constant(name: str) -> None:
    raise ValueError(name)


def strict_loads(text: str | None) -> tuple[bool, object]:
    """(valid, value) of a JSON text; NaN and Infinity aren't JSON, neither is nesting beyond Python's stack."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def canonical(value: object) -> str:
    """One text per value: sorted keys, whole numbers without fraction."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def kind(value: object) -> str:
    """string, number, boolean, object, null, or "array of" the kind of the first element."""
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        inner = kind(value[0]) if value else "null"
        return "array of" if inner == "null" else f"array of {inner}"
    return "null"
