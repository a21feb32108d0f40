"""Plain versions of what the corpus operators compute, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out[kind].append(m.span())
    return out


def remove_repeats(docs: list[tuple[int, str | None]], k: int = 13) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text: str | None, k: int = 3) -> frozenset:
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(docs: list[tuple[int, str | None]], least: int = 90, k: int = 3) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    for a, s in sets.items():
        for b in {b for g in s for b in held[g] if b < a}:
            both = len(s & sets[b])
            if 100 * both >= least * (len(s) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d, _ in docs}


def passage_distance(item: list[str], text: list[str]) -> int:
    """Least word edits between the item and any passage of the text."""
    row = list(range(len(item) + 1))
    least = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != w)))
        row = new
        least = min(least, row[-1])
    return least


def targets(sizes: dict) -> dict:
    """Targets of sources by repeated sharing of what is over."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        if not free:
            break
        left = total - sum(2 * sizes[s] for s in stopped)
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= over
    return {s: 2.0 * sizes[s] for s in order}


def turns_digest(rows: list[tuple]) -> tuple[int, str, int, str]:
    """Rows of (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), sha(told), len(loss), sha(loss)


SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def secrets(text: str | None) -> list[tuple[int, int, str, int, str]]:
    """Base spans as (start, order of the kind, kind, end, secret), by start and kind."""
    out = []
    for no, (kind, (pattern, group, least)) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), no, kind, m.end(), m[group]))
    return sorted(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashed(*values, seed: int = 42) -> int:
    """The engine's 64-bit hash of text, long (int) or int (as a tuple of one) values."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed & ((1 << 64) - 1))
    return _signed(seed)


def order_minhash(text: str | None, k: int = 3, bins: int = 64, bits: int = 24) -> list[int]:
    """Per filled bin: the bin, and 32 bits of the hash of its two least numbered k-mers in text order."""
    own = [_hashed(w) for w in words((text or "").strip(" \t\n\x0b\f\r"))]
    grams = []
    for i in range(len(own) - k + 1):
        joined = own[i]
        for w in own[i + 1 : i + k]:
            joined = _hashed(joined, w)
        grams.append(joined)
    if own and len(own) < k:
        grams = [_hashed(*own)]
    seen: dict[int, int] = defaultdict(int)
    dealt = defaultdict(list)
    for place, gram in enumerate(grams):
        name = gram >> bits
        numbered = _hashed(name, (seen[name],))
        seen[name] += 1
        code = (numbered & ~((1 << bits) - 1)) | place
        dealt[(code & ((1 << 64) - 1)) // ((1 << 64) // bins)].append(code)
    out = []
    for b in sorted(dealt, key=lambda b: min(dealt[b])):
        two = sorted(sorted(dealt[b])[:2], key=lambda c: c & ((1 << bits) - 1))
        out.append(b << 32 | _hashed(*[c >> bits for c in two]) & 0xFFFFFFFF)
    return out


def likeness(a: list[int], b: list[int]) -> float:
    either = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0
