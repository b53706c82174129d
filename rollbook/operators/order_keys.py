"""An order that people rearrange, as keys: to move something is to give it, and nothing else, a key between two others.

Keys are texts that sort as they are written. There is a key between any two; each halving of one gap makes keys longer by
a sign in about six, and when one grows beyond LONGEST all are written anew, evenly.
"""

from __future__ import annotations

SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LONGEST = 24


def between(low: str | None, high: str | None) -> str:
    """A key after low and before high; None is before or after all. Keys do not end with the least sign."""
    out, at = "", 0
    while True:
        x = SIGNS.index(low[at]) if low and at < len(low) else 0
        y = SIGNS.index(high[at]) if high and at < len(high) else len(SIGNS)
        if y - x > 1:
            return out + SIGNS[(x + y) // 2]
        out += SIGNS[x]
        if x != y:
            high = None  # what comes now is below it in any case
        at += 1


def even(n: int) -> list[str]:
    """n keys in order, evenly apart and as short as that goes."""
    base, width = len(SIGNS), 1
    while base**width <= 2 * (n + 1):
        width += 1
    out = []
    for i in range(1, n + 1):
        x, key = i * base**width // (n + 1), ""
        for _ in range(width):
            x, r = divmod(x, base)
            key = SIGNS[r] + key
        out.append(key.rstrip(SIGNS[0]))
    return out


def ordered(keys: dict[str, str]) -> list[str]:
    return sorted(keys, key=lambda k: (keys[k], k))


def _kept(keys: dict[str, str]) -> dict[str, str]:
    if max(map(len, keys.values()), default=0) <= LONGEST:
        return keys
    names = ordered(keys)
    return dict(zip(names, even(len(names)), strict=True))


def placed(keys: dict[str, str], name: str) -> dict[str, str]:
    """keys with name at the end; one that is there already stays where it is."""
    return keys if name in keys else _kept(keys | {name: between(max(keys.values(), default=None), None)})


def moved(keys: dict[str, str], name: str, target: str, after: bool) -> dict[str, str]:
    """keys with name right before or after target. Of names that have no place, or the same name, nothing comes."""
    if name == target or name not in keys or target not in keys:
        return keys
    rest = [k for k in ordered(keys) if k != name]
    at = rest.index(target) + after
    low, high = (keys[rest[i]] if 0 <= i < len(rest) else None for i in (at - 1, at))
    return _kept(keys | {name: between(low, high)})


def nudged(keys: dict[str, str], name: str, step: int, seen: set[str] | None = None) -> dict[str, str]:
    """keys with name so many places further down (up if negative) among those that are seen; beyond the ends nothing comes."""
    view = [k for k in ordered(keys) if seen is None or k in seen]
    if name not in view or not 0 <= view.index(name) + step < len(view):
        return keys
    return moved(keys, name, view[view.index(name) + step], step > 0)
