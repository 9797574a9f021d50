"""Plain-Python versions that several tests share."""

import re
from collections import Counter


def near_groups(rows, percent=85):
    """(id, set size, component, kept) of each row."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and None not in (i, j) and 100 * len(s & t) >= percent * len(s | t):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(s), root(i), i == root(i)) for i, s in sets), key=repr)


def covered(rows, length):
    """(id, bytes, flags of the bytes that repeated strings cover) of each row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        yield i, b, gone


def cut_text(rows, length):
    return [(i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")) for i, b, gone in covered(rows, length)]


def found_secrets(text):
    """(start, order, kind, end) of each secret, sorted."""
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def found_runs(text):
    """``text`` with each run of overlapping secrets masked."""
    out, at = "", 0
    for start, _, _, end in found_secrets(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]
