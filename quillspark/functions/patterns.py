"""Pieces of regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence


def literal(text: str) -> str:
    """text as a pattern that matches itself, for Java and for RE2."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def one_of(texts: Sequence[str]) -> str:
    return "|".join(map(literal, texts))


def spaced(labels: Sequence[str]) -> str:
    """Labels whose characters may stand apart, longest first."""
    return "|".join(r"\s*".join(map(literal, x)) for x in sorted(labels, key=len, reverse=True))
