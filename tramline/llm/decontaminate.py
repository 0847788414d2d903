"""Benchmark decontamination: a generalised suffix automaton of the test items meets the corpus.

Items are normalised to words (A-Z lowered, words are runs of letters, digits and
non-ASCII characters) and put into one suffix automaton.  Every document's words stream
through it; the state tells the longest run of words, ending here, that some item
contains.  Runs of ``window`` words or more, and whole items shorter than that, are hit.

Scale: documents are only mapped (no shuffle).  The items travel to the workers as text
in blocks of at most ``block_bytes`` on average; beyond one block the documents pass
block after block, still without a shuffle.

Defined cases: a null or empty text has no words, no hits and is clean; null or empty items
never match; items with equal ``item_id`` are one item and a null id reads as an empty
string; repeated documents are judged row by row; an empty table of items leaves all
documents clean; other columns pass through, and one named like ``out`` is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import utf8, worker_store

WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Lowers A-Z and turns every byte that is in no word into a blank; lengths stay.
NORMAL = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))
PIECE_WORDS = 4096
SPAN = "struct<first:bigint,last:bigint,start:bigint,end:bigint>"
FOUND = f"struct<n_words:bigint,n_hit:bigint,spans:array<{SPAN}>,items:array<string>>"


class SuffixAutomaton:
    """All runs of words of several items; a state is a set of runs with equal ends."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, word, child: int) -> int:
        """The part of ``child`` that is reached from ``parent`` directly, as its own state."""
        twin = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            child = self.next[last].get(word)
            if child is not None:
                last = child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
                continue
            fresh = self._state(self.length[last] + 1, {}, 0)
            parent = last
            while parent >= 0 and word not in self.next[parent]:
                self.next[parent][word] = fresh
                parent = self.link[parent]
            if parent >= 0:
                child = self.next[parent][word]
                self.link[fresh] = child if self.length[child] == self.length[parent] + 1 else self._split(parent, word, child)
            last = fresh

    def seal(self, items: list[tuple[str, list]]) -> SuffixAutomaton:
        """Notes which items each window belongs to.

        ``of_window`` maps a state to the state that holds the run of exactly ``window``
        words ending there; ``short`` lists whole items of fewer words that end there.
        """
        size, window = len(self.next), self.window
        self.of_window = [0] * size
        self.owners: dict[int, set] = {}
        self.short: list[tuple] = [()] * size
        for state in sorted(range(1, size), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.link[state]
                self.of_window[state] = state if self.length[up] < window else self.of_window[up]
        whole: dict[int, list] = {}
        for item, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= window:
                    self.owners.setdefault(self.of_window[state], set()).add(item)
            if 0 < len(words) < window:
                whole.setdefault(state, []).append((len(words), item))
        for state in sorted(range(1, size), key=self.length.__getitem__):
            self.short[state] = tuple(whole.get(state, ())) + self.short[self.link[state]]
        return self

    def scan(self, words: list) -> tuple[list[list[int]], set]:
        """Maximal hit runs as [first, past last] word numbers, and the items found."""
        edges, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        spans: list[list[int]] = []
        found: set = set()
        state = run = 0
        for at, word in enumerate(words):
            step = edges[state].get(word)
            if step is None:
                if not state:
                    continue
                while state and word not in edges[state]:
                    state = link[state]
                step = edges[state].get(word)
                if step is None:
                    run = 0
                    continue
                run = length[state]
            state = step
            run += 1
            longest = 0
            if run >= window:
                longest = run
                found |= self.owners[self.of_window[state]]
            for size, item in short[state]:
                if size <= run:
                    found.add(item)
                    longest = max(longest, size)
            if longest:
                join(spans, at + 1 - longest, at + 1)
        return spans, found


def join(spans: list[list[int]], first: int, last: int) -> None:
    """Adds a run that ends no earlier than the others, joining those it meets."""
    while spans and spans[-1][1] >= first:
        first = min(first, spans.pop()[0])
    spans.append([first, last])


def _pieces(window: int):
    """Items as normalised words, long ones in overlapping pieces that keep every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.translate(NORMAL).split()
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    if words:
                        ids.append(item)
                        texts.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
            yield pa.record_batch({"item": pa.array(ids, pa.string()), "words": pa.array(texts, pa.binary())})

    return run


def _blocks(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list[list[tuple]]:
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), utf8(text).alias("words"))
    pieces = named.mapInArrow(_pieces(window), "item string, words binary").distinct()
    total = pieces.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    count = total // block_bytes + 1
    for block in range(count):
        part = pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == block)
        yield [(r.item, bytes(r.words)) for r in part.collect()]


def _scanner(block, window: int):
    key = uuid.uuid4().hex

    def scan(texts, earlier) -> pa.Array:
        store = worker_store("decontaminate")
        if key not in store:
            store.clear()
            items = [(item, words.split(b" ")) for item, words in block.value]
            automaton = SuffixAutomaton(window)
            for _, words in items:
                automaton.add(words)
            store[key] = automaton.seal(items)
        return _scan_batch(store[key], texts, earlier)

    @F.arrow_udf(FOUND)
    def first_pass(texts: pa.Array) -> pa.Array:
        return scan(texts, None)

    @F.arrow_udf(FOUND)
    def later_pass(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        return scan(texts, earlier)

    # A filter on what a pass found is pushed below it with a second call of the pass, and with a second set of workers.
    return first_pass.asNondeterministic(), later_pass.asNondeterministic()


def _scan_batch(automaton: SuffixAutomaton, texts: pa.Array, earlier) -> pa.Array:
    rows = []
    for at, text in enumerate(texts.to_pylist()):
        normal = text.translate(NORMAL)
        words = normal.split()
        spans, found = automaton.scan(words)
        if earlier is not None and (before := earlier[at].as_py()):
            merged: list[list[int]] = []
            for first, last in sorted(spans + [[s["first"], s["last"]] for s in before["spans"]], key=lambda s: s[1]):
                join(merged, first, last)
            spans, found = merged, found | set(before["items"])
        places = [m.span() for m in re.finditer(rb"[^ ]+", normal)] if spans else []
        rows.append({
            "n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(found),
            "spans": [{"first": a, "last": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in spans],
        })
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]))


def find_contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 13, out: str = "found", block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with ``out``: number of words, hit words, hit spans (words and UTF-8 bytes), items found."""
    found = docs
    for number, block in enumerate(_blocks(items, item_id, item_text, window, block_bytes)):
        first_pass, later_pass = _scanner(docs.sparkSession.sparkContext.broadcast(block), window)
        found = found.withColumn(out, later_pass(utf8(text), F.col(out)) if number else first_pass(utf8(text)))
    return found


def is_contaminated(out: str = "found", parts: int = 20):
    """A hit document of which at least one ``parts``-th of the words is hit."""
    return (F.col(f"{out}.n_hit") > 0) & (F.col(f"{out}.n_hit") * parts >= F.col(f"{out}.n_words"))


def without_spans(text: str = "text", out: str = "found"):
    """The text without its hit spans; untouched (null included) where nothing is hit."""
    raw, spans = utf8(text), F.col(f"{out}.spans")
    starts = F.concat(F.array(F.lit(0).cast("long")), spans["end"])
    ends = F.concat(spans["start"], F.array(F.octet_length(raw).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")),
    )
    joined = F.aggregate(kept, F.lit(b""), lambda done, piece: F.concat(done, piece)).cast("string")
    return F.when(F.size(spans) > 0, joined).otherwise(F.col(text))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", parts: int = 20, **options) -> DataFrame:
    """Documents whose coverage passes the limit go; in the others the hit spans are cut out."""
    found = find_contamination(docs, items, text=text, out="__found", **options).filter(~is_contaminated("__found", parts))
    return found.withColumn(text, without_spans(text, "__found")).drop("__found")
