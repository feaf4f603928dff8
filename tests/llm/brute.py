"""The operators' contracts worked out plainly, one row at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def least_ids(ids, links):
    roots = components(len(ids), links)
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+",
                       re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_rows(docs):
    fps = [simhash(t) for _, t in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i)
             if (fps[i] ^ fps[j]).bit_count() <= 2]
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in
                   zip(docs, fps, least_ids([i for i, _ in docs], links))), key=repr)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(docs, items, width=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(width, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k:k + size])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k:k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def pii_row(doc, text):
    spans = base_spans(text)
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (doc, *(sum(k == x for k, _, _ in spans) for x in PII),
            hashlib.sha256(listed.encode()).hexdigest())


def vector_rows(rows, threshold=0.98):
    """rows of (id, vector, label) -> (id, n_links, component_id, kept)"""
    def fine(v, label):
        return (label is not None and v is not None and len(v) > 0
                and all(x is not None and np.isfinite(x) for x in v) and any(v))
    ok = [fine(v, label) for _, v, label in rows]
    by = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if ok[i]:
            by[label, len(v)].append(i)
    links = []
    for own in by.values():
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        links += [(own[i], own[j]) for i, j in zip(a, b)]
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    least = least_ids([r[0] for r in rows], links)
    return sorted(((r[0], int(n[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows)),
                  key=repr)


def token_ids(path, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
