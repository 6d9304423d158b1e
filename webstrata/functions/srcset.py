"""The srcset attribute: its candidates, and the one with the most pixels."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

SPACE = " \t\n\f\r"


@dataclass(frozen=True)
class Candidate:
    url: str
    descriptor: str | None


def candidates(srcset: str) -> list[Candidate]:
    """Addresses with their descriptors. Commas within an address belong to it; those that end one end the candidate."""
    found: list[Candidate] = []
    at, n = 0, len(srcset)
    while True:
        while at < n and srcset[at] in SPACE + ",":
            at += 1
        if at >= n:
            return found
        start = at
        while at < n and srcset[at] not in SPACE:
            at += 1
        url = srcset[start:at]
        bare = url.rstrip(",")
        descriptor = None
        if bare == url:
            start, inside = at, False
            while at < n and (inside or srcset[at] != ","):
                inside = srcset[at] == "(" or inside and srcset[at] != ")"
                at += 1
            descriptor = srcset[start:at].strip(SPACE) or None
        if bare:
            found.append(Candidate(bare, descriptor))


def rank(descriptor: str | None) -> tuple[int, float]:
    """Any width beats any density; what can't be read is a density of 1."""
    if descriptor:
        if re.fullmatch(r"\+?[0-9]+w", descriptor) and int(descriptor[:-1]) < 1 << 64:
            return 1, float(int(descriptor[:-1]))
        if descriptor.endswith("x"):
            try:
                density = float(descriptor[:-1])
            except ValueError:
                density = math.nan
            if math.isfinite(density):
                return 0, density
    return 0, 1.0


def widest(srcset: str) -> str | None:
    best: Candidate | None = None
    for c in candidates(srcset):
        if best is None or rank(c.descriptor) > rank(best.descriptor):
            best = c
    return best.url if best else None
