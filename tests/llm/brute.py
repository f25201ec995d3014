"""Plain versions of the contracts, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter


def shingle_set(text: str | None) -> set:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_duplicates(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest reachable id), for distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posts: dict = {}
    for i in sorted(sets):
        shared = Counter(j for z in sets[i] for j in posts.get(z, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for z in sets[i]:
            posts.setdefault(z, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def judge_url(url: str | None, rules: list[tuple[str, str, str]], default: str = "allow") -> tuple[str, str, str | None, str]:
    """host, path, rule, verdict."""
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def warc_rows(rows: list[tuple[int, str | None]], least: int = 1000) -> list[tuple]:
    """(page_id, payload_bytes, digest, record_type, refers_to) of distinct page ids."""
    import hashlib

    data = [(i, (h or "").encode()) for i, h in rows]
    top: dict[bytes, int] = {}
    for i, p in data:
        if len(p) >= least:
            top[p] = max(i, top.get(p, i))
    out = []
    for i, p in data:
        again = len(p) >= least and top[p] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top[p] if again else None))
    return sorted(out)
