"""Lists of periods as people write them."""

from __future__ import annotations


def parse_periods(text: str, known: list[int] | None = None) -> list[int]:
    """The periods of ``a:b`` (all from a to b), ``a,b`` (each of them) or a mix of both, in
    ascending order, each once; an empty text means all ``known`` ones. Periods that are not known
    are an error, and so is a range that runs backwards."""
    if not text.strip():
        return sorted(set(known or []))
    out: set[int] = set()
    for part in text.split(","):
        ends = [int(x) for x in part.split(":")]
        if len(ends) > 2 or ends[0] > ends[-1]:
            raise ValueError(f"not a range of periods: {part.strip()!r}")
        out.update(range(ends[0], ends[-1] + 1))
    if known is not None and out - set(known):
        raise ValueError(f"unknown periods: {sorted(out - set(known))}")
    return sorted(out)
