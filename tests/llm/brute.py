"""Plain versions of the operators for small tables; rows are (id, text) pairs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NAMES = ("email", "ip", "card", "phone")


def passes_luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and passes_luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def span_text(spans) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def token_ids(texts, end_id: int) -> list[bytes]:
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encoded = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    return [np.array([*e.ids, end_id], np.uint32).tobytes() for e in encoded]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def _components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def shingles(text) -> set:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k: k + 5]) for k in range(len(words) - 4)}


def near_documents(rows) -> dict:
    """id -> (set size, smallest id of the component)."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    links = []
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        links += [(j, k) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
        for x in s:
            where[x].append(k)
    roots = _components(len(rows), links)
    low: dict = {}
    for (i, _), r in zip(rows, roots):
        low[r] = min(low.get(r, i), i)
    return {i: (len(s), low[r]) for (i, _), s, r in zip(rows, sets, roots)}


def repeats(rows, span: int = 400) -> list[tuple]:
    """(id, bytes, removed, spans, digest of the rest)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k: k + span] for _, b in texts for k in range(len(b) - span + 1))
    out = []
    for i, b in texts:
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k: k + span]] > 1:
                covered[k: k + span] = True
        starts = int((covered & ~np.append(False, covered[:-1])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((i, len(b), int(covered.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def near_vectors(rows, threshold: float = 0.9) -> dict:
    """id -> (links, smallest id of the component)."""
    ids = [i for i, _ in rows]
    good = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) if ok else None)
    links = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is not None and y is not None and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((a, b))
    counts = Counter(k for pair in links for k in pair)
    roots = _components(len(rows), links)
    low: dict = {}
    for i, r in zip(ids, roots):
        low[r] = min(low.get(r, i), i)
    return {i: (counts[k], low[r]) for k, (i, r) in enumerate(zip(ids, roots))}
