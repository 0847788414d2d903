"""The pipeline's first four stages on (id, host, text) lists."""

from __future__ import annotations

import re
from collections import defaultdict

import brute


def quality(docs):
    def normal(line):
        return " ".join(brute.WORDS.findall(line)).lower()

    holders, hosts = defaultdict(set), defaultdict(set)
    for _, host, text in docs:
        hosts[host].add(text)
        for line in text.split("\n"):
            holders[host, normal(line)].add(text)
    verdict = {r[0]: r[-1] for r in brute.quality(docs)}
    return [(d, h, "\n".join(x for x in t.split("\n") if not normal(x) or len(holders[h, normal(x)]) <= max(20, len(hosts[h]) * 0.005))) for d, h, t in docs if verdict[d]]


def line_dedup(docs):
    removed = brute.similar_lines([(d, t) for d, _, t in docs])
    return [(d, h, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone))) for (d, h, t), gone in zip(docs, removed)]


def near_dedup(docs):
    leader = brute.groups({d: brute.fingerprint(t) for d, _, t in docs})
    return [x for x in docs if leader[x[0]] == x[0]]


def decontaminate(docs, items, window=13):
    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows = set()
    for _, text in items:
        w = pattern.findall(text.encode().lower())
        size = min(window, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1) if size}
    sizes = {len(x) for x in windows}
    out = []
    for d, h, t in docs:
        raw = t.encode()
        places = list(pattern.finditer(raw.lower()))
        w = [m.group() for m in places]
        hit = {p for size in sizes for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for p in range(i, i + size)}
        if hit and 20 * len(hit) >= len(w):
            continue
        gone = bytearray(len(raw))
        for p in hit:
            end = places[p + 1].start() if p + 1 in hit else places[p].end()
            for i in range(places[p].start(), end):
                gone[i] = 1
        out.append((d, h, bytes(b for b, g in zip(raw, gone) if not g).decode()))
    return out


def run(docs, items):
    return {d: t for d, _, t in decontaminate(near_dedup(line_dedup(quality(docs))), items)}
