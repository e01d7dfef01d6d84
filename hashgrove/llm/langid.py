"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashgrove.llm.shared import small_batches, staged, unstage
from hashgrove.llm.words import U64, chunks

#: Labelled documents learned from, for each language and in all, and the most languages: bounds of what training gathers.
SAMPLE_DOCS, SAMPLE_ALL, MAX_LANGUAGES = 3000, 768_000, 4096
DIMS_BITS, ORDERS, AMBIGUOUS = 15, (1, 2, 3), 0.2


def bucket(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def codewords(n: int) -> np.ndarray:
    """+1/-1 code of each of n languages: exhaustive up to six, else the seeded random code of largest least distance."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        columns = range(2 ** (n - 1) - 1)
        return np.array([[1] * len(columns), *([1 if c >> (i - 1) & 1 else -1 for c in columns] for i in range(1, n))], dtype=np.int8)
    bits, rng, best, at = int(np.ceil(8 * np.log2(n))), np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        least = int((apart + np.eye(n, dtype=np.int64) * bits).min())
        if least > at:
            best, at = code, least
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first feature of each text): hashed byte n-grams of the folded texts, digits and ASCII marks as blanks."""
    raw = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b"".join(raw), dtype=np.uint8)
    b = np.where((b >= 128) | ((b >= 97) & (b <= 122)), b, np.uint8(32)).astype(U64)
    parts, code = [], np.zeros(len(b), dtype=U64)
    for n in range(1, max(ORDERS) + 1):
        code[: len(b) - n + 1] = code[: len(b) - n + 1] | (b[n - 1 :] << U64(8 * (n - 1)))
        if n in ORDERS:
            parts.append((((code + U64(n << 56)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - DIMS_BITS)).astype(np.int32))
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])))[:-1]
    return np.stack(parts, axis=1), starts


@dataclass(frozen=True)
class Model:
    """languages, their codewords, weights (feature, bit) and the calibration and loss weight of every bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.code.shape[1]))
        for a, b in chunks(texts, 1 << 19):
            features, starts = grams(texts[a:b])
            total = np.zeros((len(features), self.code.shape[1]), dtype=np.float32)
            for k in range(features.shape[1]):
                total += self.weights[features[:, k]]
            counts = np.diff(np.append(starts, len(features)))
            out[a:b] = np.add.reduceat(total, starts, axis=0, dtype=np.float64) / counts[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, lead over the next) by loss-weighted decoding."""
        z = margins * self.slope + self.shift
        loss = np.stack([(np.logaddexp(0, -z * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return p.argmax(axis=1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Newton fit of y in {0,1} on the rows of x (a column of ones included)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
    return w


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from (doc_id, text, lang) rows with a language and a letter; None if there are none.

    At most about ``sample_docs`` documents of each language, and SAMPLE_ALL of all, picked by a hash of their id, are learned
    from. Weights are made feature by feature and calibrations bit by bit on the executors; the driver gets the model alone,
    so many numbers as there are features and bits. More than MAX_LANGUAGES languages are a ValueError.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    share = spark.createDataFrame([(k, min(sample_docs, SAMPLE_ALL / len(counts)) / n) for k, n in counts.items()], "lang string, share double")
    picked = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30) < F.col("share")
    sample = labelled.join(F.broadcast(share), "lang").where(picked).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, own in pdf.groupby("lang").text:
                texts = [t for t in own if has_letter(t)]
                for a, b in chunks(texts):
                    features, _ = grams(texts[a:b])
                    sums[lang] = sums.get(lang, 0) + np.bincount(features.ravel(), minlength=1 << DIMS_BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": total[at]})

    table = sample.mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = staged(table, "langid-counts")
    totals = {r["lang"]: r.n for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return None
    code = codewords(len(languages))
    width = 1 << DIMS_BITS
    scale = np.array([1 / (totals[k] + 0.1 * width) for k in languages])
    shared = spark.sparkContext.broadcast((code > 0, scale))

    def odds(shares: np.ndarray) -> np.ndarray:
        """Of shares (rows, languages): for each bit, the log of the mean share of its languages over that of the others."""
        yes, _ = shared.value
        n, m = yes.sum(axis=0), (~yes).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log(shares @ yes / n) - np.log(shares @ ~yes / m)
        return np.where((n > 0) & (m > 0), out, 0).astype(np.float32)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = shared.value[1]
        for pdf in batches:
            seen = np.full((len(pdf), len(scale)), 0.1)
            for row, (who, n) in enumerate(zip(pdf.who, pdf.n)):
                seen[row, np.asarray(who)] += np.asarray(n)
            yield pd.DataFrame({"feature": pdf.feature, "w": list(odds(seen * scale))})

    place = spark.createDataFrame(list(enumerate(languages)), "at int, lang string")
    seen = table.join(F.broadcast(place), "lang").groupBy("feature").agg(F.collect_list(F.struct("at", "n")).alias("s")).select("feature", F.col("s.at").alias("who"), F.col("s.n").alias("n"))
    weights = np.repeat(odds(0.1 * scale[None, :]), width, axis=0)
    for r in seen.mapInPandas(weigh, "feature int, w array<float>").toLocalIterator():
        weights[r.feature] = r.w
    unstage(table)
    ones = np.ones(code.shape[1])
    model = Model(languages, code, weights, ones, 0 * ones, ones)
    known = spark.sparkContext.broadcast(model)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {k: i for i, k in enumerate(known.value.languages)}
        for pdf in batches:
            pdf = pdf[pdf.text.map(has_letter)]
            if len(pdf):
                x = known.value.margins(pdf.text.tolist())
                y = known.value.code[pdf.lang.map(number).to_numpy()] > 0
                yield pd.DataFrame({"bit": np.tile(np.arange(x.shape[1]), len(x)), "x": x.ravel(), "y": y.ravel()})

    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy().astype(float)
        slope, shift, trust = 1.0, 0.0, 1.0
        if 0 < y.sum() < len(y):
            slope, shift = logistic(np.column_stack((x, np.ones(len(y)))), y, ridge=1e-4)
            error = min(max(np.mean((x * slope + shift > 0) != (y > 0.5)), 1e-3), 0.499)
            trust = np.log((1 - error) / error)
        return pd.DataFrame({"bit": [pdf.bit.iloc[0]], "slope": [slope], "shift": [shift], "trust": [trust]})

    slope, shift, trust = ones.copy(), 0 * ones, ones.copy()
    for r in sample.mapInPandas(margins, "bit int, x double, y boolean").groupBy("bit").applyInPandas(calibrate, "bit int, slope double, shift double, trust double").collect():
        slope[r.bit], shift[r.bit], trust[r.bit] = r.slope, r.shift, r.trust
    return Model(languages, code, weights, slope, shift, trust * len(trust) / trust.sum())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and ambiguous (its lead over the next codeword is below AMBIGUOUS).

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text when nothing was
    learned. Whole texts count, repeated rows give equal results; columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = "lang_pred string, score double, ambiguous boolean"
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(False)})
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "ambiguous": False}, index=range(len(texts)))
            at = np.flatnonzero([has_letter(t) for t in texts])
            if len(at):
                best, score, lead = shared.value.decode(shared.value.margins([texts.iloc[i] for i in at]))
                out.loc[at, "lang_pred"] = np.asarray(shared.value.languages, dtype=object)[best]
                out.loc[at, "score"], out.loc[at, "ambiguous"] = np.clip(score, 0, 1), lead < AMBIGUOUS
            yield out

    guess = F.pandas_udf(run, schema)
    return docs.withColumn("__guess", guess(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns), "__guess.*")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op9: learned outside remainder 2, predicted for all, ambiguous ones flagged."""
    held = bucket(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def identified(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told: those without a letter, and ambiguous ones scored below ``accept``, go.

    Null and empty texts have no letter and go; whole texts are read; repeated rows go or stay together; all columns of docs
    stay, whatever their names; an empty table gives no rows; where nothing can be learned, all go.
    """
    held = bucket(F.col("doc_id"), 4) == 2
    rows = docs.select(F.struct("*").alias("__row"), "text")
    named = predict(rows, train(docs.where(~held)))
    return named.where((F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") < accept))).select("__row.*")
