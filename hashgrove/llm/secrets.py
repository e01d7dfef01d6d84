"""Secret scans: pattern candidates, and a random forest that removes the false positives."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words around a candidate, and a small dictionary of words that occur inside names.
CREDENTIAL = "token secret password passwd pwd credential credentials apikey api_key access_key auth bearer private_key".split()
HARMLESS = "example sample dummy placeholder changeme test commit sha sha1 sha256 md5 checksum digest uuid guid id hash revision build version".split()
DICTIONARY = "access account active admin after before build change class client code column commit config content count create data date default delete design device document element error event example field file filter first format function global group handler header image index input instance item label last length level link list local login main manager memory message method model module name network node number object option order output package page parameter parent password path pattern point position process product project property query random record reference report request result return role schema score search secret section select sequence server service session setting source start state status string style system table target template test text time title token type update user value version view window word".split()

#: Linear in the text: a name starts at the start of its run, and only the last credential word of a run can stand before the sign.
CANDIDATE = re.compile(
    r"(?P<k>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]|-(?!----))*-----END (?:[A-Z]+ )*PRIVATE KEY-----)"
    r"|(?i:(?<![a-z_.-])(?>[a-z_.-]*(?:token|secret|passw(?:or)?d|pwd|credentials?|api_?key|access_key|private_key|auth(?:orization)?))[a-z_]*+)[\"']?\s*(?:=>|:=|=|:)\s*[\"']?(?i:(?:bearer|basic|token)\s+)?(?P<a>[^\s\"'<>,;]{6,})"
    r"|(?<![A-Za-z0-9+/_=.-])(?P<b>[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{16,})*={0,2})"
)
MAY_HOLD = r"[A-Za-z0-9+/_-]{16}|(?i:token|secret|passw|pwd|credential|api_?key|access_key|private_key|auth)"
AROUND = 40
FEATURES = ("length", "digits", "upper", "symbols", "changes", "repeats", "vowel_pairs", "coverage", "hex", "credential", "assigned", "quoted", "harmless", "path", "url")


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(low: str) -> float:
    """Share of the letters that dictionary words cover, longest first."""
    letters = sum(c.isalpha() for c in low)
    if not letters:
        return 0.0
    covered = 0
    for word in sorted(DICTIONARY, key=len, reverse=True):
        parts = low.count(word)
        covered += parts * len(word)
        low = low.replace(word, " ") if parts else low
    return min(1.0, covered / letters)


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """The forest's inputs: length, character transitions, dictionary coverage, path and neighbouring words."""
    n, low, near = len(value), value.lower(), re.findall(r"[a-z_0-9]+", before.lower())[-4:]
    pairs = max(1, n - 1)
    return [
        float(n),
        sum(c.isdigit() for c in value) / n,
        sum(c.isupper() for c in value) / n,
        sum(not c.isalnum() for c in value) / n,
        sum(kind(x) != kind(y) for x, y in zip(value, value[1:])) / pairs,
        sum(x == y for x, y in zip(value, value[1:])) / pairs,
        sum(x.isalpha() and y.isalpha() and ((x in "aeiou") != (y in "aeiou")) for x, y in zip(low, low[1:])) / pairs,
        coverage(low),
        float(all(c in "0123456789abcdef" for c in low)),
        float(any(any(k in w for k in CREDENTIAL) for w in near)),
        float(bool(re.search(r"(=>|:=|=|:)\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] in "\"'" and after[:1] != ""),
        float(any(w in HARMLESS for w in near) or any(w in low for w in ("example", "changeme", "placeholder", "dummy", "xxxx"))),
        float("test" in path.lower() or "doc" in path.lower() or "example" in path.lower()),
        float("://" in before[-20:] or "/" in before[-1:]),
    ]


def candidates(text: str | None, path: str | None = None) -> Iterator[tuple[int, int, str, list[float]]]:
    """(start, end, value, features) of each candidate in a whole text, however long; bare ones need a letter and a digit.

    A key block is one candidate, and so are the parts of a token that dots join."""
    for m in CANDIDATE.finditer(text or ""):
        group = m.lastgroup
        value, (a, b) = m[group], m.span(group)
        if group == "b" and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        yield a, b, value, features(value, text[max(0, a - AROUND) : a], text[b : b + AROUND], path or "")


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[list[float], float]]:
    """Seeded findings with labels, made from public formats: keys of hex, base64 and provider styles that are assigned
    to credential names, against digests, identifiers, names, placeholders and links."""
    r, out = random.Random(seed), []
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = lambda k: "_".join(r.choice(DICTIONARY) for _ in range(k))

    def block() -> str:
        kind_ = r.choice(("", "RSA ", "EC ", "OPENSSH "))
        return f"-----BEGIN {kind_}PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(2, 26))) + f"\n-----END {kind_}PRIVATE KEY-----"

    for _ in range(n):
        name = r.choice(CREDENTIAL)
        if r.random() < 0.5:
            value = r.choice((lambda: pick(hexa, r.choice((32, 40, 64))), lambda: pick(alnum, r.randint(20, 64)), lambda: pick(alnum + "+/", r.choice((32, 44, 64))), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 48), lambda: pick(alnum + "!#$%&*", r.randint(10, 20)), lambda: ".".join(pick(alnum + "-_", r.randint(20, 90)) for _ in range(3)), block))()
            quote, scheme = r.choice(("\"", "'", "")), r.choice(("", "", "Bearer "))
            before = r.choice((f"{r.choice(DICTIONARY)} {name} {r.choice(('=', ':'))} {quote}{scheme}", f"{r.choice(DICTIONARY)} ")) if value.startswith("-----") else f"{r.choice(DICTIONARY)} {name} {r.choice(('=', ':'))} {quote}{scheme}"
            text, label = f"{before}{value}{quote} ", 1.0
        else:
            value, before = r.choice((
                lambda: (pick(hexa, 40), f"{r.choice(('commit', 'revision', 'sha1'))} "), lambda: (pick(hexa, 64), f"{r.choice(('sha256', 'checksum', 'digest'))}: "),
                lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), f"{r.choice(('uuid', 'id'))} = "), lambda: (words(3) + str(r.randint(1, 99)), f"{r.choice(DICTIONARY)} "),
                lambda: (r.choice(("changeme", "example-token", "your_password_here", "dummy123", "placeholder", "xxxxxxxxxxxx")), f"{name} = \""), lambda: (words(2), f"{name} = "),
                lambda: (words(3) + "/" + words(2) + str(r.randint(1, 9)), "https://"), lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}_build{r.randint(1, 99)}", f"{r.choice(DICTIONARY)} "),
                lambda: (pick("0123456789", r.randint(16, 24)), f"{name.replace('token', 'id')} {r.choice(('number', 'count'))} "),
            ))()
            text, label = f"{r.choice(DICTIONARY)} {before}{value} ", 0.0
        a = text.rindex(value)
        out.append((features(value, text[max(0, a - AROUND) : a], text[a + len(value) :], r.choice(("", "src", "tests/x", "docs/y"))), label))
    return out


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = 30, depth: int = 7) -> RandomForestClassificationModel:
    """The forest, from findings (f array<double> of FEATURES, label) or the made ones, which are as many whatever the input."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "f array<double>, label double").coalesce(1)
    data = findings.select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt").fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, least: float = 0.5, path: str = "source") -> DataFrame:
    """(doc_id, start, end, secret, probability) of the findings that the forest keeps (probability >= least).

    Offsets are code points in the whole text. Null and empty texts have no findings; the column ``path``, if
    there is one, is the path feature and may be null; repeated rows are reported each; an empty table gives no rows.
    """
    model = model or train(docs.sparkSession)
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("text").rlike(MAY_HOLD)).select(F.col("doc_id"), "text", where.alias("path"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, *c) for d, text, p in zip(pdf.doc_id, pdf.text, pdf.path) for c in candidates(text, p)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "secret", "f"])

    kind_ = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(find, f"doc_id {kind_}, start int, end int, secret string, f array<double>")
    scored = model.transform(found.withColumn("features", array_to_vector("f")))
    return scored.withColumn("probability", vector_to_array("probability")[1]).where(F.col("probability") >= least).select("doc_id", "start", "end", "secret", "probability")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op6: the findings, their secrets as digests."""
    return scan(docs.select("doc_id", "text", "source")).select("doc_id", "start", "end", F.sha2("secret", 256).alias("secret_sha256"), "probability")
