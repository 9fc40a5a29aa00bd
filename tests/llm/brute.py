"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDY = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(ids: list, links: list[tuple]) -> dict:
    """Smallest id reachable by links, for each id."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def op1(docs: list[tuple]) -> dict:
    sets = {}
    for i, text in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    held: dict = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    links, seen = [], set()
    for group in held.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
    root = roots(list(sets), links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def op3(docs: list[tuple]) -> dict:
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    out = {}
    for i, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out[i] = (len((text or "").encode()), n, n > 512)
    return out


def op5(docs: list[tuple], items: list[tuple]) -> dict:
    windows: dict = {}
    for item, text in items:
        w = WORDY.findall((text or "").translate(LOWER))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).update([] if item is None else [str(item)])
    sizes = sorted({len(x) for x in windows})
    out = {}
    for i, text in docs:
        w = WORDY.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def op10(docs: list[tuple], n: int = 50) -> dict:
    words = {i: SPACED.findall(text or "") for i, text in docs}
    first: dict = {}
    for i in sorted(words):
        w = words[i]
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def op6(rows: list[tuple]) -> dict:
    """rows: (vec_id, vector, label), ids distinct."""
    import math

    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((label, len(v)), []).append((i, v))
    links = []
    for group in good.values():
        for k, (a, x) in enumerate(group):
            for b, y in group[k + 1 :]:
                if sum(p * q for p, q in zip(x, y)) / (math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y))) >= 0.98:
                    links.append((a, b))
    root = roots([r[0] for r in rows], links)
    n = dict.fromkeys(root, 0)
    for pair in links:
        for i in pair:
            n[i] += 1
    return {i: (n[i], root[i], root[i] == i) for i in root}


def op8(docs: list[tuple]) -> dict:
    """The base part only: n_assign, n_access, n_hex, base_sha256."""
    patterns = [
        (0, re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
        (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    names = ("assign", "access", "hex")
    out = {}
    for i, text in docs:
        spans = sorted((m.start(), k, m.end()) for k, p, ok in patterns for m in p.finditer(text or "") if ok(m))
        count = [sum(s[1] == k for s in spans) for k in range(3)]
        out[i] = (*count, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)))
    return out
