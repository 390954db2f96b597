"""Passages of held-out evaluation items inside training documents.

The items' own passages (instructions that many items share and answer options
removed) form one generalised suffix automaton over words. Documents are
streamed through it: at every word the automaton's state is the longest suffix
read so far that occurs in any passage, and its class of ``min_match`` words
names every item that holds them, however many there are. Items that are hit
often enough are then measured exactly: pairs of neighbouring words that stand
in both texts are chained in order, and the share of the passage's words inside
the chain is the coverage; most of it must stand in runs of some length, because neighbouring
words alone also meet in stock phrases. Stretches of a document that belong to a leaked item,
or that match longer than ``span_words`` words, can be cut out of the text.

The automaton grows with the items, not with the corpus. Items come in blocks of
at most ``block_words`` words, each with its own automaton, so what a task holds
has a fixed bound however many items there are. Every text is read and split into
words once; where there are several blocks, a task passes the words it has
gathered through one block after the other.

Defined results for odd input
-----------------------------
* null or empty document or item text, null ids: no rows.
* an item without a passage of ``min_words`` words: no rows.
* repeated document ids: a row if any of their texts leaks; repeated items: one.
* documents of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.4
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\r?\n[>|#* \t]*(?=[a-z])")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_GROWS = re.compile("[\u0130]")
_OPTION = re.compile(r"^\s*(?:[-*]\s*)?(?:\(?[A-H1-8][).:]|[A-H]\s*[-–])\s+\S")


def words_of(text: str) -> list[str]:
    """Words without case, markup, punctuation and layout; words broken at line ends are whole again."""
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of :func:`words_of` stands in the text as it was given."""
    at = list(range(len(text)))

    def replace(pattern: re.Pattern, by: Callable[[re.Match], str]) -> None:
        nonlocal text, at
        parts, places, done = [], [], 0
        for m in pattern.finditer(text):
            new = by(m)
            parts += [text[done : m.start()], new]
            places += at[done : m.start()] + [at[m.start()]] * len(new)
            done = m.end()
        text, at = "".join([*parts, text[done:]]), places + at[done:]

    replace(_BROKEN, lambda m: "")
    replace(_TAG, lambda m: " ")
    replace(_ENTITY, lambda m: html.unescape(m[0]))
    if not text.isascii():
        replace(_INVISIBLE, lambda m: "")
        replace(_GROWS, lambda m: m[0].lower())
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer(text.lower())]


def _lines(text: str) -> list[list[str]]:
    """Lines by paragraph, without the answer options at the end of a paragraph."""
    out = []
    for p in re.split(r"\n\s*\n", text):
        lines = p.split("\n")
        while lines and (_OPTION.match(lines[-1]) or not lines[-1].strip()):
            lines.pop()
        out.append(lines)
    return out


def passages(items: list[tuple[int, str]], shared: int = 3) -> dict[int, list[str]]:
    """The own passage of every item, as words.

    A paragraph or line that ``shared`` or more items have is an instruction if, in the middle one
    of those items, it is shorter than the text the items do not have in common; otherwise
    it is a passage with several questions. Lettered lines at the end are the answer options.
    """
    norm = lambda s: " ".join(words_of(s))
    texts = {i: _lines(t) for i, t in sorted(items, key=lambda x: x[0]) if t}
    lines = {i: [norm(line) for p in ps for line in p] for i, ps in texts.items()}
    having: dict[str, set[int]] = defaultdict(set)
    for i, ps in texts.items():
        for p in ps:
            for piece in {norm("\n".join(p)), *(norm(line) for line in p)} - {""}:
                having[piece].add(i)

    def instructs(piece: str) -> bool:
        among = having[piece]
        if len(among) < shared:
            return False
        size, gain = piece.count(" ") + 1, []
        for i in among:
            own = common = 0
            for line in lines[i]:
                n = line.count(" ") + 1 if line else 0
                if 2 * len(having[line] & among) >= len(among):
                    common += n
                else:
                    own += n
            gain.append(own - max(size, common))
        return sorted(gain)[len(gain) // 2] >= 0

    known = {piece: instructs(piece) for piece in having}
    out = {}
    for i, ps in texts.items():
        kept = [line for p in ps if not known.get(norm("\n".join(p))) for line in p if not known.get(norm(line))]
        out[i] = words_of("\n".join(kept))
    return out


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, word_numbers: list[int]) -> None:
        last = 0
        for w in word_numbers:
            last = self._extend(last, w)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the prefix is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def classes(self, words: int) -> list[int]:
        """By state, the state of its last ``words`` words; -1 where it is shorter."""
        out = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[s] >= words:
                above = self.link[s]
                out[s] = out[above] if self.length[above] >= words else s
        return out


class LeakIndex:
    """The automaton of a block of items, and the exact measure."""

    def __init__(self, block: dict[int, list[str]], min_match: int = 3, narrow: int = 16, coverage: float = COVERAGE, bridge: int = 1, run_words: int = 6):
        self.vocabulary: dict[str, int] = {}
        self.passage = {i: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for i, ws in block.items()}
        self.min_match, self.narrow, self.coverage, self.bridge, self.run_words = min_match, narrow, coverage, bridge, run_words
        automaton = SuffixAutomaton()
        for numbers in self.passage.values():
            automaton.add(numbers)
        self.next, self.link, self.length = automaton.next, automaton.link, automaton.length
        self.classes = automaton.classes(min_match)
        #: Items by class of ``min_match`` words: all of them.
        held: dict[int, set[int]] = defaultdict(set)
        self.pairs: dict[int, dict[tuple[int, int], list[int]]] = {}
        for i, ws in self.passage.items():
            at: dict[tuple[int, int], list[int]] = defaultdict(list)
            state = 0
            for n, w in enumerate(ws):
                state = self.next[state][w]
                if n + 1 >= min_match:
                    held[self.classes[state]].add(i)
                if n:
                    at[ws[n - 1], w].append(n - 1)
            self.pairs[i] = dict(at)
        self.items = dict(held)
        #: Words that must stand in unbroken runs, and the hits an item needs for them: a run has ``min_match`` - 1 fewer hits than words.
        self.runs = {i: 2 / 3 * coverage * len(ws) for i, ws in self.passage.items()}
        self.need = {i: max(1, math.ceil(n * (run_words - min_match + 1) / run_words)) for i, n in self.runs.items()}
        self.least = min(self.need.values(), default=0)

    def trace(self, numbers: list[int | None], longest: int) -> tuple[dict[int, list[int]], list[tuple[int, int, int]]]:
        """Ends of the hits by class, and (end, length, state) of the matches of ``longest`` words or more that cannot grow to the right."""
        arcs, link, length, classes, least = self.next, self.link, self.length, self.classes, self.min_match
        hits: dict[int, list[int]] = {}
        runs = []
        state = size = 0
        for n, w in enumerate(numbers):
            to = arcs[state].get(w) if w is not None else None
            if to is None:
                if size >= longest:
                    runs.append((n, size, state))
                if w is None:
                    state = size = 0
                    continue
                while to is None and state:
                    state = link[state]
                    to = arcs[state].get(w)
                size = length[state]
                if to is None:
                    size = 0
                    continue
            state, size = to, size + 1
            if size >= least:
                hits.setdefault(classes[state], []).append(n + 1)
        if size >= longest:
            runs.append((len(numbers), size, state))
        return hits, runs

    def matches(self, numbers: list[int | None]) -> list[tuple[int, int, int]]:
        """Every match of ``min_match`` words or more that cannot grow to the right."""
        return self.trace(numbers, self.min_match)[1]

    def candidates(self, hits: dict[int, list[int]]) -> dict[int, list[int]]:
        """Items hit often enough to be measured, with the ends of their hits.

        Classes that more than ``narrow`` items share are counted for an item only if the others leave it
        in reach; where they alone would be enough for some item, they are counted for all.
        """
        if sum(map(len, hits.values())) < self.least:
            return {}
        count: dict[int, int] = defaultdict(int)
        wide, spare = [], 0
        for c, ends in hits.items():
            if len(self.items[c]) > self.narrow:
                wide.append(c)
                spare += len(ends)
                continue
            for i in self.items[c]:
                count[i] += len(ends)
        if wide:
            reach = [i for i, n in count.items() if n + spare >= self.need[i]]
            if spare >= self.least:
                reach = set(reach).union(*(self.items[c] for c in wide))
            for c in wide:
                held, n = self.items[c], len(hits[c])
                for i in reach if len(reach) < len(held) else held:
                    if i in held:
                        count[i] += n
        chosen = [i for i, n in count.items() if n >= self.need[i]]
        return {i: sorted(e for c, ends in hits.items() if i in self.items[c] for e in ends) for i in chosen}

    def measure(self, numbers: list[int | None], item: int, ends: list[int]) -> tuple[float, list[tuple[int, int]]]:
        """The largest share of the item's words that stand in order in one stretch of the document, and the places of their pairs in both."""
        size = len(self.passage[item])
        best: tuple[float, list[tuple[int, int]]] = (0.0, [])
        done = -1
        for end in ends:
            if end <= done:
                continue
            group_end = ends[bisect_right(ends, end + 2 * size) - 1]
            here = self._chain(numbers, item, max(0, end - size - 8), min(len(numbers), group_end + size + 8))
            if here[0] > best[0]:
                best = here
            done = end + size // 4
        return best

    def _chain(self, numbers: list[int | None], item: int, start: int, stop: int) -> tuple[float, list[tuple[int, int]]]:
        """Word pairs common to the passage and ``numbers[start:stop]``, longest increasing chain: words covered, places."""
        at = self.pairs[item]
        hits = []
        for d in range(start, stop - 1):
            own = at.get((numbers[d], numbers[d + 1]))
            if own:
                hits += [(p, d) for p in reversed(own)]
        # Longest chain of strictly increasing passage places, in document order (patience sorting).
        tails: list[int] = []
        tail_at: list[int] = []
        back = [-1] * len(hits)
        for n, (p, _) in enumerate(hits):
            k = bisect_left(tails, p)
            back[n] = tail_at[k - 1] if k else -1
            if k == len(tails):
                tails.append(p)
                tail_at.append(n)
            else:
                tails[k], tail_at[k] = p, n
        covered: set[int] = set()
        places = []
        n = tail_at[-1] if tail_at else -1
        after = None
        while n >= 0:
            p, d = hits[n]
            covered |= {p, p + 1}
            places.append((p, d))
            if after and after[0] - p <= self.bridge + 2 and after[1] - d <= 2 * self.bridge + 2:
                covered.update(range(p + 2, after[0]))  # a word or two that were changed
            after, n = (p, d), back[n]
        return len(covered) / max(1, len(self.passage[item])), places[::-1]

    def numbers(self, words: list[str]) -> list[int | None]:
        get = self.vocabulary.get
        return [get(w) for w in words]

    def _quoted(self, places: list[tuple[int, int]]) -> int:
        """Words of a chain in unbroken runs of ``run_words`` or more: turns of phrase that many texts share are shorter."""
        words = size = 0
        for n, (p, d) in enumerate(places):
            unbroken = n > 0 and places[n - 1] == (p - 1, d - 1)
            if not unbroken:
                words, size = words + (size if size >= self.run_words else 0), 1
            size += 1
        return words + (size if size >= self.run_words else 0)

    def find(self, words: list[str], span_words: int | None = None) -> tuple[list[tuple[int, float]], list[tuple[int, int, int | None]]]:
        """(item, coverage) of the items of the block that leak into a text, and (first word, past the last, item) of what to cut.

        Spans are looked for only where ``span_words`` is given; a long match that no item covers has no item.
        """
        numbers = self.numbers(words)
        hits, runs = self.trace(numbers, span_words or len(numbers) + 1)
        found, spans = [], []
        for item, ends in self.candidates(hits).items():
            share, places = self.measure(numbers, item, ends)
            if share >= self.coverage and self._quoted(places) >= self.runs[item]:
                found.append((item, share))
                if span_words:
                    spans += [(a, b, item) for a, b in _stretches([d for _, d in places], 2 * self.bridge + 2)]
        return found, spans + [(end - size, end, None) for end, size, _ in runs]


def _stretches(places: list[int], gap: int) -> list[tuple[int, int]]:
    """Neighbouring word pairs joined to stretches of words."""
    out: list[tuple[int, int]] = []
    for d in places:
        if out and d < out[-1][1] + gap - 1:
            out[-1] = (out[-1][0], d + 2)
        else:
            out.append((d, d + 2))
    return out


def _blocks(own: dict[int, list[str]], block_words: int) -> Iterator[dict[int, list[str]]]:
    block: dict[int, list[str]] = {}
    size = 0
    for i, ws in own.items():
        if block and size + len(ws) > block_words:
            yield block
            block, size = {}, 0
        block[i] = ws
        size += len(ws)
    if block:
        yield block


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places, out, done = word_spans(text), [], 0
    for a, b in sorted(spans):
        start, stop = places[a][0], places[b - 1][1]
        if stop > done:
            out.append(text[done : max(done, start)])
            done = stop
    return "".join([*out, text[done:]])


def _scanner(blocks: list[dict[int, list[str]]], coverage: float, span_words: int | None, chunk_chars: int = 32 << 20) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Only the passages' words travel; each task builds the automata from them, one block at a time."""

    def chunks(batches: Iterable[pd.DataFrame]) -> Iterator[list[tuple]]:
        rows, size = [], 0
        for batch in batches:
            rows += zip(batch["doc_id"], batch["text"], strict=True)
            size += int(batch["text"].str.len().sum())
            if len(blocks) == 1 or size >= chunk_chars:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = LeakIndex(blocks[0], coverage=coverage) if len(blocks) == 1 else None
        for rows in chunks(batches):
            texts = [words_of(t) for _, t in rows] if only is None else None
            found: list[list[tuple[int, float]]] = [[] for _ in rows]
            spans: list[list[tuple[int, int, int | None]]] = [[] for _ in rows]
            for block in blocks:
                index = only or LeakIndex(block, coverage=coverage)
                for n, (_, text) in enumerate(rows):
                    items, places = index.find(texts[n] if texts else words_of(text), span_words)
                    found[n] += items
                    spans[n] += places
            if span_words is None:
                out = [(d, i, share) for (d, _), items in zip(rows, found, strict=True) for i, share in items]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage"])
            else:
                kept = []
                for (d, text), items, places in zip(rows, found, spans, strict=True):
                    clean = cut(text, [(a, b) for a, b, _ in places]) if places else text
                    kept.append((d, clean, len(text) - len(clean), sorted({i for i, _ in items})))
                yield pd.DataFrame(kept, columns=["doc_id", "text", "removed_chars", "item_ids"])

    return scan


def _own_passages(eval_items: DataFrame, min_words: int, max_items_bytes: int) -> dict[int, list[str]]:
    """The items' passages on the driver, after a check of the items' size."""
    items = eval_items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_items_bytes:
        raise ValueError(f"evaluation items take {size} bytes, more than {max_items_bytes}; pass them in parts")
    return {i: ws for i, ws in passages([(r["item_id"], r["text"]) for r in items.collect()]).items() if len(ws) >= min_words}


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def leaked_items(
    documents: DataFrame, eval_items: DataFrame, coverage: float = COVERAGE, min_words: int = 8, block_words: int = 500_000, max_items_bytes: int = 256 << 20
) -> DataFrame:
    """(doc_id, item_id, coverage) of every item whose passage leaks into a document.

    The items are read to the driver after a check of their size (``max_items_bytes``).
    """
    blocks = list(_blocks(_own_passages(eval_items, min_words, max_items_bytes), block_words))
    schema = "doc_id bigint, item_id bigint, coverage double"
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    found = _texts(documents).mapInPandas(_scanner(blocks, coverage, None), schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def without_leaks(
    documents: DataFrame,
    eval_items: DataFrame,
    coverage: float = COVERAGE,
    span_words: int = 50,
    min_words: int = 8,
    block_words: int = 500_000,
    max_items_bytes: int = 256 << 20,
) -> DataFrame:
    """(doc_id, text, removed_chars, item_ids): every document without the stretches that leak.

    Cut is what an item with ``coverage`` or more of its passage in the document covers there, and every
    match of ``span_words`` words or more even if its item stays below that. Texts without either are unchanged.
    """
    blocks = list(_blocks(_own_passages(eval_items, min_words, max_items_bytes), block_words))
    if not blocks:
        return _texts(documents).select("doc_id", "text", F.lit(0).cast("bigint").alias("removed_chars"), F.array().cast("array<bigint>").alias("item_ids"))
    return _texts(documents).mapInPandas(_scanner(blocks, coverage, span_words), "doc_id bigint, text string, removed_chars bigint, item_ids array<bigint>")
