"""Substring dedup: suffix automata of reference shards give matching statistics of streamed segments.

The reference is the corpus itself, which no executor can hold, so it is sharded by content: every run of
windows with the same minimizer forms a segment, and equal windows always meet under the same minimizer. A
shard's automaton is shipped to the one task that streams that shard's segments, instead of to all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.shared import may_hold, staged, unstage
from hashgrove.llm.words import U64, Words, mix, pieces, spans_hash

WINDOW, GRAM, RUN = 50, 15, 64
#: Segments of different content under one minimizer beyond which its windows are compared one by one.
HOT_SEGMENTS = 256
#: Parts that the segments of one window are dealt to, so that a window of very many segments is no single task's.
PARTS = 64
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """Suffix automaton of word sequences, extended one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A state of length[p] + 1 that takes over q's edges and those that lead to q by w."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistics: for each word, the length of the longest suffix ending there that a sequence contains."""
        state = n = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            step = self.next[state].get(w)
            state, n = (step, n + 1) if step is not None else (0, 0)
            yield n


def covered(lengths: Iterator[int], window: int) -> list[tuple[int, int]]:
    """Maximal word spans [start, end) covered by matches of at least ``window`` words."""
    spans: list[list[int]] = []
    for i, n in enumerate(lengths):
        if n >= window:
            if spans and spans[-1][1] >= i + 1 - window:
                spans[-1][1] = i + 1
            else:
                spans.append([i + 1 - window, i + 1])
    return [tuple(s) for s in spans]


def window_runs(w: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimizer, segment hash) of every run of at most RUN windows with one minimizer."""
    n = len(w.hash)
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    gram = np.zeros(n - GRAM + 1, dtype=U64)
    for k in range(GRAM):
        gram = gram * U64(0xD6E8FEB86659FD93) + w.hash[k : k + len(gram)]
    low, size, span = mix(gram), 1, window - GRAM + 1
    while size * 2 <= span:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: n - window + 1], low[span - size : span - size + n - window + 1])
    text = w.text_of()
    valid = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(valid):
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (low[valid[1:]] != low[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
    begin = np.flatnonzero(new)
    place = np.arange(len(valid)) - np.repeat(begin, np.diff(np.append(begin, len(valid))))
    begin = np.flatnonzero(place % RUN == 0)
    count = np.diff(np.append(begin, len(valid)))
    first = valid[begin]
    return text[first], first - w.bound[text[first]], count, low[first], spans_hash(w.hash, first, first + count + window - 1)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, spans): for each document with any, the word spans covered by windows that also start in a
    document of smaller doc_id. ``th`` is the xxhash64 of the text and tells rows of one doc_id apart.

    1. Every run of windows gets its minimizer; minimizers of one document only are dropped.
    2. Segments of equal content collapse to the least doc_id: later copies are covered whole.
    3. Segments that share a minimizer with different content are streamed, by ascending doc_id, through the
       suffix automaton of those before them. A minimizer with more than HOT_SEGMENTS contents compares its windows
       by hash, pre-aggregated, instead, so no task holds an unbounded shard; a window's least id goes to every part
       that its segments are dealt to.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            for a, _, texts in pieces(batch.column("text")):
                text, first, count, key, seg = window_runs(Words(texts), window)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a + text], hashes[a + text], first.astype(np.int32), count.astype(np.int32), key.view(np.int64), seg.view(np.int64))], names=["doc_id", "th", "first", "n", "key", "seg"])

    occurrences = staged(rows.mapInArrow(runs, "doc_id long, th long, first int, n int, key long, seg long"), "runs")
    shared = occurrences.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    hits = staged(occurrences.join(shared, "key"), "shared-runs")
    unstage(occurrences)
    segments = hits.groupBy("key", "seg").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th", "first", "n")).alias("at"))
    segments = staged(segments.select("key", "seg", "least", "at.th", "at.first", "at.n"), "segments")
    contents = segments.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1")
    wanted = segments.join(contents, "key").groupBy(F.col("least").alias("doc_id"), "th").agg(F.collect_list(F.struct("key", "seg", "first", "n", (F.col("contents") > HOT_SEGMENTS).alias("hot"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cold segments with their words; of hot ones a row for each window with its hash."""
        for batch, a, b, texts in ((batch, *piece) for batch in batches for piece in pieces(batch.column("text"))):
            out: dict[str, list] = {c: [] for c in ("key", "seg", "doc_id", "place", "check", "words")}
            for doc, text, wanted in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), texts, batch.column("wanted").slice(a, b - a).to_pylist()):
                words = text.split()
                hashes = None
                for x in wanted:
                    if not x["hot"]:
                        for c, v in zip(out, (x["key"], x["seg"], doc, None, None, b" ".join(words[x["first"] : x["first"] + x["n"] + window - 1]))):
                            out[c].append(v)
                        continue
                    if hashes is None:
                        hashes = Words([text]).hash
                    at = np.arange(x["first"], x["first"] + x["n"])
                    main = spans_hash(hashes, at, at + window).view(np.int64)
                    check = spans_hash(mix(hashes + U64(1)), at, at + window).view(np.int64)
                    for k in range(x["n"]):
                        for c, v in zip(out, (x["key"], x["seg"], doc, (k, int(main[k])), int(check[k]), None)):
                            out[c].append(v)
            places = [p or (None, None) for p in out["place"]]
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["seg"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int64()), pa.array(out["check"], pa.int64()), pa.array(out["words"], pa.binary())], names=["key", "seg", "doc_id", "place", "main", "check", "words"])

    wanted = staged(wanted, "wanted-segments")
    cuts = may_hold(rows, F.col("th"), wanted, F.col("th")).where("__may").join(wanted, ["doc_id", "th"]).select("doc_id", "text", "wanted").mapInArrow(cut, "key long, seg long, doc_id long, place int, main long, check long, words binary")
    cuts = staged(cuts, "segment-words")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key and doc_id: one automaton a key, asked before the document's own words are added."""
        key, automaton, pending, pending_doc = None, None, [], None
        for pdf in batches:
            out = []
            for k, seg, doc, words in zip(pdf.key.tolist(), pdf.seg.tolist(), pdf.doc_id.tolist(), pdf.words):
                if k != key:
                    key, automaton, pending, pending_doc = k, SuffixAutomaton(), [], doc
                if doc != pending_doc:
                    for p in pending:
                        automaton.add(p)
                    pending, pending_doc = [], doc
                w = bytes(words).split()
                spans = covered(automaton.matches(w), window)
                if spans:
                    out.append((k, seg, [{"a": a, "b": b} for a, b in spans]))
                pending.append(w)
            yield pd.DataFrame(out, columns=["key", "seg", "spans"])

    span = "array<struct<a:int,b:int>>"
    cold = cuts.where("words IS NOT NULL").repartition("key").sortWithinPartitions("key", "doc_id").select("key", "seg", "doc_id", "words").mapInPandas(stream, f"key long, seg long, spans {span}")
    hot = cuts.where("words IS NULL").withColumn("part", F.pmod("seg", F.lit(PARTS)))
    ends = hot.groupBy("main", "check", "part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    oldest = ends.groupBy("main", "check").agg(F.min("lo").alias("oldest"), F.max("hi").alias("latest"), F.collect_list("part").alias("parts")).where("oldest < latest")
    hot = hot.join(oldest.select("main", "check", "oldest", F.explode("parts").alias("part")), ["main", "check", "part"]).where("doc_id > oldest").groupBy("key", "seg").agg(F.collect_set(F.struct(F.col("place").alias("a"), (F.col("place") + window).alias("b"))).cast(span).alias("spans"))
    found = cold.union(hot)

    copies = hits.join(segments.select("key", "seg", "least"), ["key", "seg"])
    later = copies.where("doc_id > least").select("doc_id", "th", F.col("first").alias("a"), (F.col("first") + F.col("n") + window - 1).alias("b"))
    oldest_own = copies.where("doc_id = least").join(found, ["key", "seg"]).select("doc_id", "th", "first", F.explode("spans").alias("s")).select("doc_id", "th", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b"))
    return later.union(oldest_own).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a blank) of every row of docs (doc_id, text).

    Null and empty texts have no words; a null doc_id counts as the largest; rows of one doc_id never remove
    each other's words; whole texts are used; an empty table gives no rows.
    """
    spans = staged(repeated_spans(docs, window), "repeated")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__d"), F.xxhash64("text").alias("__t"), "text")
    rows = may_hold(rows, F.col("__t"), spans, F.col("th"))
    joined = rows.where("__may").join(spans.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans"), ["__d", "__t"], "left").select("doc_id", "text", "spans")
    joined = joined.union(rows.where("NOT __may").select("doc_id", "text", F.lit(None).cast("array<struct<a:int,b:int>>")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column("text")):
                n_words, n_removed, kept = [], [], []
                for text, spans in zip(texts, batch.column("spans").slice(a, b - a).to_pylist()):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    for x, y in reversed(merge(spans or [])):
                        del words[x:y]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of op3 by whole windows."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {LAST}) AS o, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT rid, o, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS k FROM (SELECT rid, o, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
m AS (SELECT k, min(o) AS least FROM x GROUP BY k),
h AS (SELECT rid, i FROM x JOIN m USING (k) WHERE o > least),
c AS (SELECT DISTINCT rid, i + j AS p FROM h, range({window}) r(j)),
g AS (SELECT rid, list(p) AS ps FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)"""
