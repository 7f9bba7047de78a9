"""Plain Python forms of the operators, for small inputs. rows: (doc_id, text)."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def substring(rows, width: int = 50) -> list[tuple]:
    first: dict[bytes, int] = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = b" ".join(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[b" ".join(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), sha(kept)))
    return sorted(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(rows) -> list[tuple]:
    out = []
    for d, t in rows:
        spans = []
        for rank, (kind, pattern) in enumerate(BASE.items()):
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {
                    "email": True,
                    "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                    "card": 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": 10 <= len(digits) <= 15,
                }[kind]
                if ok:
                    spans.append((m.start(), rank, m.end(), kind))
        spans.sort()
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        out.append((d, *(sum(s[3] == k for s in spans) for k in BASE), sha(line.encode())))
    return sorted(out)


def shingles(text: str | None, k: int = 5) -> set[bytes]:
    w = [x.lower() for x in words(text)]  # bytes.lower() changes A-Z alone
    if not w:
        return set()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near(rows) -> list[tuple]:
    """Inverted index over whole sets, then exact sizes."""
    sets = [(d, shingles(t)) for d, t in rows]
    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for own in index.values():
        for p in itertools.combinations(own, 2):
            common[p] += 1
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = sorted((root(sets[i][0]), root(sets[j][0])))
            parent[b] = a
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def bpe(rows, path: str) -> list[tuple]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    out = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(tok.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out)


def token_store(rows, path: str) -> list[tuple]:
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def media(rows) -> list[tuple]:
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        out.append((d, len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:])))
    return sorted(out)


def lines(rows, min_sites: int) -> list[tuple]:
    """rows: (doc_id, text, site)."""
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip()].add(s)
    out = []
    for d, t, _ in rows:
        if t is None:
            out.append((d, 0, None, None))
            continue
        parts = t.split("\n")
        kept = [x for x in parts if not x.strip() or len(sites[x.strip()]) < min_sites]
        whole = "\n".join(kept)
        out.append((d, len(parts) - len(kept), len(whole), sha(whole.encode())))
    return sorted(out)
