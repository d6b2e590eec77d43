"""Small builders for the oracle statements."""

from __future__ import annotations


def half_even(x: str, digits: int = 3) -> str:
    """Round to even on the scaled double."""
    scale = f"{10**digits}.0"
    y = f"(({x}) * {scale})"
    return (
        f"(CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END / {scale} + 0.0)"
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
