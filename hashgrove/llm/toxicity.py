"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer reads words (whole words of the seed lists and learned stems) and writes symbols;
negation and reported-speech transducers rewrite them; a scoring transducer weighs an insult or threat
with its target. The three are composed into one table, run over each clause; a document's score is a
calibrated function of its clause scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.langid import bucket, logistic
from hashgrove.llm.shared import staged, unstage
from hashgrove.llm.words import Words, chunks, spans_hash

#: At most about so many labelled documents are learned from: the bound of what training gathers.
SAMPLE_DOCS = 20_000
STEM_BYTES = tuple(range(3, 13))

#: Closed-class words of the grammar.
NEGATION = "not no never without isn aren wasn don doesn didn won nicht kein keine nie niemals ne pas jamais sans nunca jamás sin".split()
TARGET = "you your yours yourself u they them their he him his she her du dich dir dein euch ihr sie tu te toi vous votre ton tú tus usted ustedes ellos ellas".split()
REPORTED = "said says saying told claimed claims wrote writes quoted reported alleged sagte sagt behauptete schrieb dit disait écrit dijo dice escribió".split()
THREAT = "kill murder hurt destroy shoot stab beat strangle hang burn töten umbringen schlagen tuer frapper matar golpear".split()

#: Symbols: other, insult, threat, target, negation, report, clause end; lower case after rewriting.
SYMBOLS = "OITYNRE"
CLAUSE_MARKS = b".!?;\n"

#: A transducer: (state, symbol) to (state, output).
Transducer = Callable[[int, str], tuple[int, str]]


def negated(state: int, symbol: str) -> tuple[int, str]:
    """Insults and threats within three words after a negation are written as ``n``."""
    if symbol == "N":
        return 3, "O"
    out = "n" if state and symbol in "IT" else symbol
    return 0 if symbol == "E" else max(0, state - 1), out


def reported(state: int, symbol: str) -> tuple[int, str]:
    """Insults and threats after a verb of saying, in its clause, are written as ``r``."""
    if symbol == "E":
        return 0, "E"
    if symbol == "R":
        return 1, "O"
    return state, "r" if state and symbol in "IT" else symbol


#: Weights of the scoring transducer for its outputs.
WEIGHTS = {"": 0.0, "insult": 1.0, "insult+target": 1.5, "target-after": 0.5, "threat": 0.3, "threat+target": 2.0, "n": 0.1, "r": 0.4}


def scoring(state: int, symbol: str) -> tuple[int, str]:
    """States: bit 0, a target has been named in this clause; bit 1, an insult; bit 2, a bare threat."""
    if symbol == "E":
        return 0, ""
    if symbol == "Y":
        if state & 4:
            return (state | 1) & ~4, "threat+target"
        return state | 1, "target-after" if state & 2 and not state & 1 else ""
    if symbol == "I":
        return state | 2, "insult+target" if state & 1 else "insult"
    if symbol == "T":
        return (state, "threat+target") if state & 1 else (state | 4, "threat")
    return state, symbol if symbol in "nr" else ""


def compose(*parts: Transducer) -> list[dict[str, tuple[int, float]]]:
    """The product of the transducers as one table from its reachable states: table[state][symbol] = (state, weight)."""
    start = (0,) * len(parts)
    number, table, todo = {start: 0}, [], [start]
    for states in todo:
        row = {}
        for symbol in SYMBOLS:
            out, after = symbol, []
            for part, state in zip(parts, states):
                state, out = part(state, out)
                after.append(state)
            after = tuple(after)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row[symbol] = (number[after], WEIGHTS[out])
        table.append(row)
    return table


def hash_of(word: str) -> int:
    return int(Words([word.encode()], lower=True, letters=True).hash[0])


@dataclass(frozen=True)
class Grammar:
    """Closed words keep their symbols; of the stems that a word begins with the strongest counts. Sorted hashes of closed-class words with their symbols, stems by byte length with weights, the composed table, the calibration."""

    closed: tuple[np.ndarray, np.ndarray]
    stems: dict[int, tuple[np.ndarray, np.ndarray]]
    table: list
    fit: np.ndarray | None

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: 1, log of summed clause scores, the largest, log of matched clauses, their share of clauses."""
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        for a, b in chunks(raw):
            self._run(raw[a:b], out[a:b])
        return out

    def _run(self, raw: list[bytes], out: np.ndarray) -> None:
        w = Words(raw, letters=True)
        n = len(w.hash)
        if not n:
            return
        symbol, weight = np.zeros(n, dtype=np.int8), np.ones(n)
        words, codes = self.closed
        at = np.minimum(np.searchsorted(words, w.hash), len(words) - 1)
        symbol = np.where(words[at] == w.hash, codes[at], 0).astype(np.int8)
        bytes_, strongest = w.bytes.astype(np.uint64) + np.uint64(1), np.zeros(n)
        for size, (table, weights) in self.stems.items():
            fits = np.flatnonzero(w.end - w.begin >= size)
            h = spans_hash(bytes_, w.begin[fits], w.begin[fits] + size)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            strongest[fits[hit]] = np.maximum(strongest[fits[hit]], weights[at[hit]])
        insult = (strongest > 0) & (symbol == 0)
        symbol[insult], weight[insult] = 1, strongest[insult]
        marks = np.flatnonzero(np.isin(w.bytes, np.frombuffer(CLAUSE_MARKS, dtype=np.uint8)))
        clause = np.searchsorted(marks, w.begin)
        events = np.flatnonzero(symbol)
        owner = np.searchsorted(w.bound, events, side="right") - 1
        core = np.isin(symbol, (1, 2))
        live = np.unique(owner[core[events]])
        if not len(live):
            return
        first, last = np.searchsorted(owner, live), np.searchsorted(owner, live, side="right")
        for text, lo, hi in zip(live.tolist(), first.tolist(), last.tolist()):
            own = events[lo:hi]
            scores, state, total, before, place = [], 0, 0.0, -1, -1
            for i, s, c, x in zip(own.tolist(), symbol[own].tolist(), clause[own].tolist(), weight[own].tolist()):
                if c != before:
                    if total:
                        scores.append(total)
                    state, total, before, place = 0, 0.0, c, i - 1
                for _ in range(min(i - place - 1, 3)):
                    state = self.table[state]["O"][0]
                state, got = self.table[state][SYMBOLS[s]]
                total, place = total + got * (x if s == 1 else 1.0), i
            if total:
                scores.append(total)
            if scores:
                clauses = len(np.unique(clause[w.bound[text] : w.bound[text + 1]]))
                out[text, 1:] = np.log1p(sum(scores)), max(scores), np.log1p(len(scores)), len(scores) / clauses

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.fit is None:
            return np.where(self.features(texts)[:, 2] >= 1, 0.9, 0.05)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.fit, -30, 30)))


def closed_words() -> tuple[np.ndarray, np.ndarray]:
    table = {hash_of(w): SYMBOLS.index(s) for s, words in (("Y", TARGET), ("R", REPORTED), ("N", NEGATION), ("T", THREAT)) for w in words}
    keys = np.array(sorted(table), dtype=np.uint64)
    return keys, np.array([table[int(k)] for k in keys], dtype=np.int8)


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Grammar:
    """Learn stems and calibration from rows (doc_id, text, toxic).

    At most about ``sample_docs`` rows, picked by a hash of their id, are used; copies of a text count once.
    A stem is a word beginning of 3 to 12 bytes that toxic documents hold far oftener; the shortest of a
    chain is kept unless a longer one is much more telling. Stems come from one half of the sample and the
    calibration from the other, then stems are learned again from all of it.
    """
    empty = Grammar(closed_words(), {}, compose(negated, reported, scoring), None)
    labelled = labelled.where(F.col("text").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = staged(sample.withColumn("half", F.pmod("h", F.lit(2))), "toxicity-sample")

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [t.lower().encode("utf-8", "surrogatepass") for t in pdf.text]
            for a, b in chunks(raw):
                w = Words(raw[a:b], letters=True)
                bytes_, text = w.bytes.astype(np.uint64) + np.uint64(1), w.text_of()
                yes = pdf.toxic.to_numpy()[a:b]
                half = pdf.half.to_numpy()[a:b]
                for size in STEM_BYTES:
                    fits = np.flatnonzero(w.end - w.begin >= size)
                    h = spans_hash(bytes_, w.begin[fits], w.begin[fits] + size)
                    order = np.unique(np.stack((h.view(np.int64), text[fits])), axis=1, return_index=True)
                    (key, doc), at = order[0], fits[order[1]]
                    label = pd.DataFrame({"stem": key, "at": at, "yes0": yes[doc] * (half[doc] == 0), "yes1": yes[doc] * (half[doc] == 1), "no0": (1 - yes[doc]) * (half[doc] == 0), "no1": (1 - yes[doc]) * (half[doc] == 1)})
                    sums = label.groupby("stem", sort=False).agg({"at": "first", "yes0": "sum", "yes1": "sum", "no0": "sum", "no1": "sum"}).reset_index()
                    sums["word"] = [w.data[w.begin[i] : w.begin[i] + size] for i in sums.pop("at")]
                    yield sums.assign(size=size)

    found = sample.mapInPandas(stems, "stem long, yes0 long, yes1 long, no0 long, no1 long, word binary, size int")
    found = found.groupBy("size", "stem").agg(*(F.sum(c).alias(c) for c in ("yes0", "yes1", "no0", "no1")), F.first("word").alias("word"))
    found = found.where((F.col("yes0") + F.col("yes1") >= 4) & (F.col("yes0") + F.col("yes1") > 2 * (F.col("no0") + F.col("no1")))).toPandas()
    size_of = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    if not any(t for _, t in size_of) or not len(found):
        unstage(sample)
        return empty

    def grammar(halves: tuple[int, ...], fit: np.ndarray | None) -> Grammar:
        total = [sum(size_of.get((h, t), 0) for h in halves) for t in (0, 1)]
        yes, no = sum(found[f"yes{h}"] for h in halves), sum(found[f"no{h}"] for h in halves)
        odds = np.log((yes + 0.5) / (total[1] + 1)) - np.log((no + 0.5) / (total[0] + 1))
        least = max(3 * len(halves), 0.006 * total[1])
        keep = found.assign(odds=odds, yes=yes)[(yes >= least) & (odds >= 2.5)].sort_values(["size", "stem"])
        chosen: dict[bytes, tuple[int, int, float, int]] = {}
        for word, size, stem, odds_, hits in zip(keep.word, keep["size"], keep.stem, keep.odds, keep.yes):
            word = bytes(word)
            shorter = next((chosen[word[:k]] for k in range(size - 1, 2, -1) if word[:k] in chosen), None)
            if shorter is None or odds_ > shorter[2] + 1.0 and hits > 0.7 * shorter[3]:
                chosen[word] = (size, stem, odds_, hits)
        top = max((c[2] for c in chosen.values()), default=1.0)
        tables = {}
        for size in {c[0] for c in chosen.values()}:
            own = sorted((np.int64(c[1]).view(np.uint64), c[2] / top) for c in chosen.values() if c[0] == size)
            tables[int(size)] = (np.array([k for k, _ in own], dtype=np.uint64), np.array([x for _, x in own]))
        return Grammar(empty.closed, tables, empty.table, fit)

    shared = labelled.sparkSession.sparkContext.broadcast(grammar((0,), None))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf.toxic, "f": list(shared.value.features(pdf.text.tolist()))})

    fit = sample.where("half = 1").mapInPandas(measure, "toxic int, f array<double>").toPandas()
    unstage(sample)
    if not 0 < fit.toxic.sum() < len(fit):
        return grammar((0, 1), None)
    return grammar((0, 1), logistic(np.stack(fit.f.to_list()), fit.toxic.to_numpy().astype(float), ridge=1e-4))


def learn_from(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Grammar:
    """learn() on the labelled rows of docs, at most about sample_docs of them; only those labels' ids are broadcast."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = sample_docs / max(1, labels.count())
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30) < share)
    return learn(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), sample_docs)


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with ``score`` in 0..1; null and empty texts get the score of a text without matches.

    Whole texts are read; repeated rows score alike; an existing column ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return docs.drop("score").withColumn("score", run(F.col("text")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op4: learned where crc32(doc_id) mod 5 is not 0, scored for all."""
    learned = labels.where(bucket(F.col("doc_id"), 5) != 0)
    scored = score_documents(docs.select("doc_id", "text"), learn_from(docs, learned))
    return scored.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
