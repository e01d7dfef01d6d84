"""Benchmark decontamination: training passages query a BM25 inverted index of test items with block-max WAND."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.shared import small_batches
from hashgrove.llm.words import Words, chunks, distinct, spans_hash

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that retrieves it; n-gram share of question and of answer that confirms it.
RETRIEVE, QUESTION, ANSWER = 0.5, 0.5, 0.5
#: Words of an entry (longer items are retrieved by overlapping pieces of half as many, and confirmed whole), items of one broadcast index, entries of a block.
ENTRY_WORDS, INDEX_ITEMS, BLOCK = 96, 20_000, 4
#: The commonest lists whose best impacts total at most this count with their best in every block.
SLACK = 0.08
#: Pairs of a passage and a block of entries whose maxima are summed at a time.
CELLS = 1 << 20


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; a lone sentence gives its last quarter of words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 4))
    return " ".join(words[:cut]), " ".join(words[cut:])


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_hashes(text: str) -> np.ndarray:
    return Words([folded(text)], letters=True).hash


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(h))
    at = np.arange(len(h) - n + 1) if n else np.zeros(0, dtype=np.int64)
    return np.unique(spans_hash(h, at, at + n))


@dataclass
class Entry:
    item: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    #: Of a piece: its item as a whole. Of that: its terms in order and their impacts as shares of its score.
    whole: Entry | None = None
    terms: np.ndarray | None = None
    impact: np.ndarray | None = None


class Index:
    """Inverted index of entries with impacts as shares of each entry's own score, so one threshold fits all."""

    def __init__(self, items: list[tuple[int, str | None]], df: dict[int, int] | None = None, total: int | None = None, mean: float | None = None, longest: int | None = None):
        self.entries: list[Entry] = []
        for item, text in items:
            h = word_hashes(text or "")
            if not len(h):
                continue
            whole = Entry(item, h, *map(word_hashes, split_item(text)))
            if len(h) <= ENTRY_WORDS:
                self.entries.append(whole)
                continue
            size = ENTRY_WORDS // 2
            for k in [*range(0, len(h) - size, size // 2), len(h) - size]:
                self.entries.append(Entry(item, h[k : k + size], whole.question, whole.answer, whole))
        n = total or len(self.entries)
        if df is None:
            df = Counter(int(t) for e in self.entries for t in np.unique(e.words))
        mean = mean or (np.mean([len(e.words) for e in self.entries]) if self.entries else 1.0)
        self.stride = longest or max([len(e.words) for e in self.entries], default=1)
        postings: dict[int, list[tuple[int, float]]] = {}

        def shares(e: Entry) -> tuple[np.ndarray, np.ndarray]:
            terms, tf = np.unique(e.words, return_counts=True)
            idf = np.array([np.log(1 + (n - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(e.words) / mean))
            return terms, impact / impact.sum()

        for i, e in enumerate(self.entries):
            terms, impact = shares(e)
            for t, x in zip(terms.tolist(), impact.tolist()):
                postings.setdefault(t, []).append((i, x))
            if e.whole is not None and e.whole.terms is None:
                e.whole.terms, e.whole.impact = shares(e.whole)
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        lists = [postings[int(t)] for t in self.terms]
        self.ids = [[i for i, _ in p] for p in lists]
        self.impacts = [[x for _, x in p] for p in lists]
        self.best = np.array([max(x) for x in self.impacts])
        self.blocks: list[list[int]] = []
        self.block_best: list[list[float]] = []
        for ids, impacts in zip(self.ids, self.impacts):
            best: dict[int, float] = {}
            for i, x in zip(ids, impacts):
                best[i // BLOCK] = max(x, best.get(i // BLOCK, 0.0))
            self.blocks.append(list(best))
            self.block_best.append(list(best.values()))
        self.flat = np.zeros(len(lists))
        left = SLACK
        for t in sorted(range(len(lists)), key=lambda t: -len(lists[t])):
            if self.best[t] <= left and len(lists[t]) > 1:
                self.flat[t], left = self.best[t], left - self.best[t]
        kept = [t for t in range(len(lists)) if not self.flat[t]]
        sizes = np.zeros(len(lists), dtype=np.int64)
        sizes[kept] = [len(self.blocks[t]) for t in kept]
        self.block_at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.block_id = np.array([b for t in kept for b in self.blocks[t]], dtype=np.int64)
        self.block_max = np.array([x for t in kept for x in self.block_best[t]])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words that no entry has."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def wand(self, terms: list[int], least: float, start: int = 0, stop: int | None = None) -> list[tuple[int, float]]:
        """Entries of [start, stop) whose summed impacts on the terms reach ``least``, by block-max WAND.

        Lists stand at their next entry; the pivot is the first entry that the lists' best impacts could lift to the
        threshold; their best impacts in its block decide whether it is scored or the lists skip on.
        """
        stop, end, found = stop or len(self.entries), 1 << 60, []
        lists = []
        for t in terms:
            ids = self.ids[t]
            k = bisect_left(ids, start)
            if k < len(ids) and ids[k] < stop:
                lists.append([ids[k], k, t])
        eps = least - 1e-9
        while lists:
            lists.sort()
            reach, pivot = 0.0, -1
            for j, (_, _, t) in enumerate(lists):
                reach += self.best[t]
                if reach >= eps:
                    pivot = j
                    break
            if pivot < 0:
                break
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            reach, block = 0.0, target // BLOCK
            for _, _, t in lists[: pivot + 1]:
                at = bisect_left(self.blocks[t], block)
                if at < len(self.blocks[t]) and self.blocks[t][at] == block:
                    reach += self.block_best[t][at]
            if reach < eps:
                to = min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
            elif lists[0][0] == target:
                score = sum(self.impacts[x[2]][x[1]] for x in lists[: pivot + 1])
                if score >= eps:
                    found.append((target, score))
                to = target + 1
            else:
                to = target
            for x in lists[: pivot + 1]:
                ids, k = self.ids[x[2]], bisect_left(self.ids[x[2]], to, x[1])
                x[0], x[1] = (ids[k], k) if k < len(ids) and ids[k] < stop else (end, k)
            lists = [x for x in lists if x[0] < end]
        return found

    def live(self, pairs: np.ndarray, passages: int) -> Iterator[tuple[int, int]]:
        """(passage, block) of every block of entries whose best impacts on the passage's terms reach RETRIEVE.

        ``pairs`` is sorted: passage times the number of terms plus the term. All passages skip their other blocks at once;
        what stays is walked by ``wand``.
        """
        width, blocks = len(self.terms), -(-len(self.entries) // BLOCK)
        slab = max(1, CELLS // blocks)
        for first in range(0, passages, slab):
            rows = min(slab, passages - first)
            a, b = np.searchsorted(pairs, (first * width, (first + rows) * width))
            at, term = pairs[a:b] // width - first, pairs[a:b] % width
            size = np.diff(self.block_at)[term]
            place = np.repeat(self.block_at[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(at, size) * blocks + self.block_id[place]
            reach = np.bincount(cell, weights=self.block_max[place], minlength=rows * blocks).reshape(rows, blocks)
            flat = np.bincount(at, weights=self.flat[term], minlength=rows)
            for p, block in np.argwhere(reach >= RETRIEVE - flat[:, None] - 1e-9).tolist():
                yield first + p, block

    def search(self, texts: list[bytes | None]) -> list[list[tuple[int, float, float, float]]]:
        """For each text, (item, score, question overlap, answer overlap) of the confirmed items, best passage of each.

        Passages are two strides of words, a stride apart; a stride is the longest entry, so every entry lies whole in
        one passage. Each passage's terms go through the index by block-max WAND, over all passages of a piece together:
        ``live`` skips blocks by their best impacts, ``wand`` walks the rest. Of an item longer than an entry, any piece that a passage retrieves has the
        whole item scored and confirmed over the passages around: one to two lengths of it to either side.
        """
        out: list[list[tuple[int, float, float, float]]] = []
        for a, b in chunks(texts, 1 << 18):
            w = Words(texts[a:b], letters=True)
            out += self._search(w, b - a)
        return out

    def _search(self, w: Words, n: int) -> list[list[tuple[int, float, float, float]]]:
        best: list[dict[int, tuple[int, float, float, float]]] = [{} for _ in range(n)]
        term = self.lookup(w.hash)
        steps = -(-np.diff(w.bound) // self.stride)
        base = np.concatenate(([0], np.cumsum(steps)))
        text = w.text_of()
        passage = base[text] + (np.arange(len(text)) - w.bound[text]) // self.stride
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return [[] for _ in range(n)]
        width, at = len(self.terms), passage[known]
        before = at > base[text[known]]
        pairs = distinct(np.concatenate((at, at[before] - 1)) * width + np.concatenate((term[known], term[known][before])))
        seen: set[tuple[int, int, int]] = set()
        for p, block in self.live(pairs, int(base[-1])):
            i = int(np.searchsorted(base, p, side="right")) - 1
            lo = int(w.bound[i]) + (p - int(base[i])) * self.stride
            hi = min(lo + 2 * self.stride, int(w.bound[i + 1]))
            a, b = np.searchsorted(pairs, (p * width, (p + 1) * width))
            for entry, score in self.wand((pairs[a:b] % width).tolist(), RETRIEVE, block * BLOCK, min((block + 1) * BLOCK, len(self.entries))):
                e, words = self.entries[entry], w.hash[lo:hi]
                if e.whole is not None:
                    e, length = e.whole, len(e.whole.words)
                    near = (lo - int(w.bound[i])) // length
                    if (i, near, id(e)) in seen:
                        continue
                    seen.add((i, near, id(e)))
                    first = int(w.bound[i]) + near * length
                    words = w.hash[max(first - length, int(w.bound[i])) : min(first + 2 * length + 2 * self.stride, int(w.bound[i + 1]))]
                    score = float(e.impact[np.isin(e.terms, words)].sum())
                    if score < RETRIEVE - 1e-9:
                        continue
                shares = []
                for part in (e.question, e.answer):
                    size_ = min(3, len(part))
                    grams = ngrams(part, size_)
                    shares.append(float(np.isin(grams, ngrams(words, size_)).mean()) if len(grams) else 1.0)
                if shares[0] >= QUESTION and shares[1] >= ANSWER:
                    row = (e.item, min(float(score), 1.0), *shares)
                    if row[1:] > best[i].get(e.item, (0, -1.0, 0.0, 0.0))[1:]:
                        best[i][e.item] = row
        return [sorted(x.values()) for x in best]


def blocks_of(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over blocks of at most about INDEX_ITEMS items; scores use counts over all items."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL")
    n = items.count()
    blocks = max(1, -(-n // INDEX_ITEMS))
    if blocks == 1:
        yield Index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])
        return

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for e in Index(list(zip(pdf.item_id, pdf.text))).entries:
                yield pd.DataFrame({"b": int(e.item) % blocks, "t": np.unique(e.words).view(np.int64)})

    found = items.mapInPandas(terms, "b long, t long")
    df = found.groupBy("t").agg(F.count("*").alias("df"))
    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [len(e.words) for e in Index(list(zip(pdf.item_id, pdf.text))).entries]
            yield pd.DataFrame({"n": [len(own)], "words": [sum(own)], "longest": [max(own, default=0)]})

    all_ = items.mapInPandas(lengths, "n long, words long, longest long").agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
    for b in range(blocks):
        own = found.where(F.col("b") == b).select("t").distinct().join(df, "t").collect()
        yield Index([(r.item_id, r.text) for r in items.where(F.pmod("item_id", F.lit(blocks)) == b).orderBy("item_id", "text").collect()], {int(np.int64(r.t).view(np.uint64)): r.df for r in own}, all_[0], (all_[1] / all_[0]) if all_[0] else None, all_[2])


HITS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def hits_column(docs: DataFrame, index: Index, text: Column) -> Column:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = shared.value.search([folded(t) for t in texts])
            yield pd.Series([[dict(zip(("item_id", "score", "question", "answer"), x)) for x in hits] for hits in found], dtype=object)

    return run(text)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question, answer) of every benchmark item that a text of docs holds.

    Every passage of every whole text is a query; all items above RETRIEVE are retrieved and kept if QUESTION and ANSWER
    overlaps confirm them, of long items too over the whole item. Null and empty texts and items hold nothing; items of equal text are all reported; repeated
    rows are reported each; empty tables give no rows. An index of at most INDEX_ITEMS items is broadcast at a time.
    """
    out = None
    for index in blocks_of(benchmark):
        rows = docs.select("doc_id", F.explode(hits_column(docs, index, F.col("text"))).alias("h")).select("doc_id", "h.*")
        out = rows if out is None else out.union(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item; all columns stay."""
    for index in blocks_of(benchmark):
        docs = docs.where(F.size(hits_column(docs, index, F.col("text"))) == 0)
    return docs
