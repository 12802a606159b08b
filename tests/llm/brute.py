"""Plain-Python restatements of what the operators return."""

from __future__ import annotations

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets: dict) -> dict:
    """Smallest id that links reach, by comparing all pairs."""
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {d: root(d) for d in ids}


def kept_rows(rows) -> dict:
    first: dict[str, int] = {}
    for d, t in sorted(rows):
        first.setdefault(SPACE.sub(" ", t or ""), d)
    return {d: first[SPACE.sub(" ", t or "")] for d, t in rows}


def spans_of(text: str) -> list[tuple[str, int, int]]:
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))
