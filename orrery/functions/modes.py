"""Specifications of aggregation modes: `name@p1,p2`, comma-separated."""

from __future__ import annotations

import re

Mode = tuple[str, tuple[float, ...]]


def parse_modes(spec: str) -> list[Mode]:
    """Modes in order, each once. A token that starts with a digit is one more parameter of the mode before it."""
    out: list[list] = []
    for token in (t.strip() for t in spec.split(",")):
        if not token:
            continue
        if re.match(r"[\d.+-]", token):
            if not out:
                raise ValueError(f"parameter {token!r} stands before any mode")
            out[-1][1].append(float(token))
            continue
        name, _, first = token.partition("@")
        out.append([name.strip().lower(), [float(first)] if first else []])
    return list(dict.fromkeys((n, tuple(p)) for n, p in out))


def label(mode: Mode) -> str:
    name, parameters = mode
    return name + ("@" + ",".join(f"{p:g}" for p in parameters) if parameters else "")


def clamp(value: float, low: float, high: float = float("inf")) -> float:
    return min(high, max(low, value))


def whole(value: float, low: int) -> int:
    """Rounded half to even, and `low` at least."""
    return max(low, int(round(value)))


def pool_label(pool: str, tau: float, m: int) -> str:
    return {"softmax": f"softmax(tau={float(tau)})", "topm": f"topm(m={m})"}.get(pool, pool)
