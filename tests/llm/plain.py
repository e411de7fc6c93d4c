"""The contracts in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def sha(raw: bytes | str) -> str:
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def dedup_lines(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str, int, int]]:
    """doc_id to (text, lines, dropped)."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders: dict[str, set[int]] = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out[d] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, list[str]]]:
    """doc_id to (words, hit words, items)."""
    windows: dict[tuple[str, ...], set[str]] = {}
    for i, text in items:
        ws = words(text)
        m = min(13, len(ws))
        for k in range(len(ws) - m + 1 if m else 0):
            windows.setdefault(tuple(ws[k : k + m]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in sizes:
            for k in range(len(ws) - m + 1):
                items_of = windows.get(tuple(ws[k : k + m]))
                if items_of:
                    hit.update(range(k, k + m))
                    found |= items_of
        out[d] = len(ws), len(hit), sorted(found)
    return out


def shingles(text: str | None) -> frozenset:
    ws = words(text)
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """doc_id to (class, copy, links), over all pairs of different shingle sets."""
    copies: dict[frozenset, list[int]] = {}
    for d, text in docs:
        copies.setdefault(shingles(text) or frozenset([("alone", d)]), []).append(d)
    sets = [(min(ids), s) for s, ids in copies.items()]
    near: dict[int, set[int]] = {r: set() for r, _ in sets}
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            common = len(s & t)
            if 10 * common >= 8 * (len(s) + len(t) - common) and common:
                near[a].add(b)
                near[b].add(a)
    group: dict[int, int] = {}
    for r in sorted(near):
        queue = [] if r in group else [r]
        while queue:
            x = queue.pop()
            if x not in group:
                group[x] = r
                queue += near[x]
    return {d: (group[min(ids)], min(ids), len(near[min(ids)])) for ids in copies.values() for d in ids}
