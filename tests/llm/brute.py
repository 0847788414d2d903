"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def contamination(docs, items, window=13):
    """``docs`` and ``items`` are (id, text) lists; one row per document."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            if size:
                windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        rows.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return rows


def base_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {p for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            doubled += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(repeated)


def quality(docs, min_docs=20, share=0.005):
    """``docs`` are (id, host, text); (id, base counts, common words, common lines, failed, kept)."""
    def normal(line):
        return " ".join(WORDS.findall(line)).lower()

    holders, hosts = defaultdict(set), defaultdict(set)
    for _, host, text in docs:
        hosts[host or ""].add(text or "")
        for line in (text or "").split("\n"):
            if normal(line):
                holders[host or "", normal(line)].add(text or "")
    rows = []
    for doc, host, text in docs:
        n, *others = base_counts(text)
        common = [normal(line) for line in (text or "").split("\n") if normal(line)
                  and len(holders[host or "", normal(line)]) > max(min_docs, len(hosts[host or ""]) * share)]
        lost = sum(len(x.split(" ")) for x in common)
        failed = n < 20 or 100 * others[3] > 30 * n
        rows.append((doc, n, *others, lost, len(common), failed, not failed and not (lost and (n - lost < 20 or lost > n * 0.5))))
    return rows


def similar_lines(docs, up=4, down=5):
    """``docs`` are (id, text) in input order; numbers of the removed lines per document."""
    lines = []
    for row, (doc, text) in enumerate(docs):
        for number, line in enumerate((text or "").split("\n")):
            if words := frozenset(WORDS.findall(line.translate(UPPER))):
                lines.append(((-(1 << 63) if doc is None else doc, number, row), words))
    lines.sort(key=lambda x: x[0])
    removed = defaultdict(list)
    for at, (place, words) in enumerate(lines):
        if any(down * len(words & other) >= up * len(words | other) for _, other in lines[:at]):
            removed[place[2]].append(place[1])
    return [sorted(removed[row]) for row in range(len(docs))]


def fingerprint(text):
    w = WORDS.findall((text or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict, radius=2):
    """Least id reachable from each id by links of ``radius`` bits."""
    ids = list(prints)
    leader = {i: i for i in ids}

    def top(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                leader[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def kept_bytes(docs, length=100):
    """``docs`` are (id, text) in order; (id, bytes, removed, spans, hash of the rest)."""
    seen, rows = set(), []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(piece)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        rows.append((doc, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return rows


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    """Valid (kind, start, end) by kind and start."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def crc(ids) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
