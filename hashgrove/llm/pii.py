"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is a DataFrame expression of one row, so nothing is shuffled and a lost executor
only repeats its own scan tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double,base:boolean>>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``pattern`` is linear-time Java syntax for ``plain``, whose
    meaning it keeps: possessive repeats cannot recurse on long runs, and the look-behind only
    skips starts inside a run whose first start has failed already."""

    name: str
    plain: str
    pattern: str
    needs: str
    score: float
    base: bool
    context: tuple[str, ...]


#: Length of an IBAN in each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, names in IBAN_LENGTHS.items())

#: Patterns, prior scores and context words of each kind.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", 0.9, True, ("mail", "contact", "write", "kontakt", "correo", "courriel")),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         ".", 0.6, True, ("ip", "address", "host", "server", "login", "adresse", "serveur")),
    Kind("card", r"[0-9]([\x20-]?[0-9])+",
         r"[0-9](?:[\x20-]?[0-9])++",
         "", 0.8, True, ("card", "credit", "visa", "payment", "karte", "tarjeta", "carte")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9][\x20().0-9-]+[0-9]",
         "+", 0.6, True, ("phone", "tel", "call", "mobile", "fax", "telefon", "llame")),
    Kind("iban", IBAN, IBAN,
         "", 0.7, False, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("tel", r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
         r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
         "", 0.35, False, ("phone", "tel", "call", "mobile", "fax", "telefon", "llame")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "-", 0.35, False, ("ssn", "social security", "tax id", "taxpayer")),
)
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.3, 0.5
#: Code points of a block of text, and values or spans of a group: a text of many matches is never walked or copied for each.
BLOCK_BITS, GROUP = 9, 64
BLOCK = 1 << BLOCK_BITS
BYTE_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind: Luhn, mod 97, byte ranges or digit counts; others hold as matched."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(BYTE_PARTS)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
        spelled = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
        return F.aggregate(F.split(spelled, ""), F.lit(0), lambda a, c: (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97) == 1
    return F.lit(True)


def blocks_of(text: Column) -> Column:
    """A text as pieces of BLOCK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """Code points of a text in blocks; the time depends on length, not on start."""
    first = F.shiftright(start, BLOCK_BITS)
    count = F.shiftright(start + length - 1, BLOCK_BITS) - first + 1
    return F.substr(F.array_join(F.slice(blocks, first + 1, count), ""), start - F.shiftleft(first, BLOCK_BITS) + 1, length)


def near(blocks: Column, start: Column, end: Column, words: tuple[str, ...]) -> Column:
    """Whether a context word, as a whole word, stands within CONTEXT_CHARS of a span."""
    before = cut(blocks, F.greatest(start - CONTEXT_CHARS, F.lit(0)), F.least(start, F.lit(CONTEXT_CHARS)))
    around = F.lower(F.concat(before, F.lit(" "), cut(blocks, end, F.lit(CONTEXT_CHARS))))
    return around.rlike(whole_word(words))


def whole_word(words: tuple[str, ...]) -> str:
    return rf"(?:^|[^\p{{L}}])(?:{'|'.join(words)})(?:$|[^\p{{L}}])"


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each value and all before it, for an integer array column that is not empty.

    An accumulator is copied at every step, so none holds more than GROUP values or one of each GROUP."""
    step = lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / GROUP).cast("int")), lambda i: F.slice(values, i * GROUP + 1, F.lit(GROUP)))
    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), op))
    before = F.aggregate(F.slice(totals, F.lit(1), F.size(totals) - 1), F.array(F.lit(0)), step)
    return F.flatten(F.zip_with(groups, before, lambda g, o: F.slice(F.aggregate(g, F.array(o), step), 2, GROUP)))


def spans_of(kind: Kind, rank: int, blocks: Column, found: Column, ends: Column) -> Column:
    """The confirmed spans of one kind, from its matches and where they end."""
    parts = F.filter(F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e"))), lambda x: x["m"].isNotNull() & confirmed(kind.name, x["m"]))

    def span(x: Column) -> Column:
        start = x["e"] - F.length(x["m"])
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near(blocks, start, x["e"], kind.context), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind.name).alias("kind"), x["m"].alias("text"), score.alias("score"), F.lit(kind.base).alias("base"))

    spans = F.transform(parts, span)
    return F.when(F.size(found) > 0, spans if kind.base else F.filter(spans, lambda x: x["score"] >= THRESHOLD)).otherwise(F.array()).cast(SPAN)


def in_groups(spans: Column) -> Column:
    """Sorted spans by GROUP, each group with the range that it covers."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / GROUP).cast("int")), lambda i: F.slice(spans, i * GROUP + 1, F.lit(GROUP)))
    return F.transform(groups, lambda g: F.struct(g[0]["start"].alias("start"), F.array_max(F.transform(g, lambda y: y["end"])).alias("end"), g.alias("spans")))


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with an array column of spans (start, end in code points, kind, text, score, base).

    Null and empty texts have no spans; long texts are searched whole; repeated rows are
    independent; other columns are kept, and one named as ``out`` is replaced. Spans of base kinds
    always stay; an added kind needs its validator and a score of THRESHOLD, and gives way to a base
    span that it overlaps.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digits = body.rlike("[0-9][0-9 .-]")
    tmp = {}
    for k in KINDS:
        may = F.contains(body, F.lit(k.needs)) if k.needs in ("@", "+") else digits
        tmp[f"__found_{k.name}"] = F.when(may, F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = docs.withColumns(tmp)
    some = F.greatest(*(F.size(f"__found_{k.name}") for k in KINDS)) > 0
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    lengths = {f"__lengths_{k.name}": F.when(F.size(f"__found_{k.name}") > 0, F.zip_with(f"__found_{k.name}", F.split(body, k.pattern, -1), lambda m, g: size(g) + size(m))) for k in KINDS}
    df = df.withColumns(lengths | {"__blocks": F.when(some, blocks_of(body))})
    df = df.withColumns({f"__spans_{k.name}": spans_of(k, i, F.col("__blocks"), F.col(f"__found_{k.name}"), running(F.col(f"__lengths_{k.name}"), lambda a, x: a + x)) for i, k in enumerate(KINDS)})
    df = df.withColumns({"__base": F.sort_array(F.concat(*(F.col(f"__spans_{k.name}") for k in KINDS if k.base))), "__more": F.concat(*(F.col(f"__spans_{k.name}") for k in KINDS if not k.base))})
    df = df.withColumn("__groups", F.when((F.size("__base") > 0) & (F.size("__more") > 0), in_groups(F.col("__base"))))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    covered = lambda x: F.exists("__groups", lambda g: meets(x, g) & F.exists(g["spans"], lambda y: meets(x, y)))
    clear = F.when(F.col("__groups").isNull(), F.col("__more")).otherwise(F.filter("__more", lambda x: ~covered(x)))
    df = df.withColumn(out, F.when(F.size("__more") > 0, F.sort_array(F.concat(F.col("__base"), clear))).otherwise(F.col("__base")))
    return df.drop("__base", "__more", "__groups", "__blocks", *(f"__{p}_{k.name}" for p in ("found", "lengths", "spans") for k in KINDS))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by ``[KIND]``; overlapping spans are covered by the first.

    Null texts stay null, empty ones empty; whole texts are read; all other columns stay as they are; repeated rows are
    redacted alike.
    """
    df = find_personal_data(docs, text, "__pii")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.withColumns({"__blocks": F.when(F.size("__pii") > 0, blocks_of(body)), "__ends": F.transform("__pii", lambda x: x["end"])})
    df = df.withColumn("__tops", F.when(F.size("__pii") > 0, running(F.col("__ends"), lambda a, x: F.greatest(a, x))))
    before = F.concat(F.array(F.lit(0)), F.slice("__tops", F.lit(1), F.size("__tops") - 1))
    parts = F.filter(F.zip_with("__pii", before, lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    marked = F.transform(parts, lambda x: F.concat(cut(F.col("__blocks"), x["at"], x["start"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    clean = F.concat(F.array_join(marked, ""), F.substr(body, F.element_at("__tops", -1) + 1))
    clean = F.when(F.col(f"`{text}`").isNull(), F.lit(None)).when(F.size("__pii") > 0, clean).otherwise(body)
    return df.withColumn(text, clean).drop("__pii", "__blocks", "__ends", "__tops")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op1 from the spans of the operator."""
    df = find_personal_data(docs.select("doc_id", "text"))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(join(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"),
        join(F.col("pii")).alias("spans"),
    )


def _duckdb_confirm(kind: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    if kind == "ip":
        return "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))"
    if kind == "card":
        luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[length({digits}) - i]::INT WHEN {digits}[length({digits}) - i]::INT > 4 THEN {digits}[length({digits}) - i]::INT * 2 - 9 ELSE {digits}[length({digits}) - i]::INT * 2 END)) % 10 = 0"
        return f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    if kind == "iban":
        moved = "replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4]"
        spelled = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), '')"
        return f"list_reduce(list_prepend(0, list_transform(string_split({spelled}, ''), lambda c: c::INT)), lambda a, c: (a * 10 + c) % 97) = 1"
    return "true"


def oracle() -> str:
    """DuckDB SQL of the same spans, by window sums over matches and gaps."""
    ctes = ["d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"]
    for i, k in enumerate(KINDS):
        keep = _duckdb_confirm(k.name) + ("" if k.base else f" AND score >= {THRESHOLD}")
        ctes += [
            f"p{i} AS (SELECT rid, t, unnest(range(1, len(ms) + 1)) AS j, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM (SELECT rid, t, regexp_extract_all(t, '{k.plain}') AS ms, string_split_regex(t, '{k.plain}') AS gs FROM d))",
            f"q{i} AS (SELECT rid, t, m, (sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY j))::INT AS e FROM p{i})",
            f"r{i} AS (SELECT rid, m, e - length(m) AS s, e, least(1.0, {k.score} + CASE WHEN regexp_matches(lower(substr(t, greatest(e - length(m) - {CONTEXT_CHARS}, 0) + 1, least(e - length(m), {CONTEXT_CHARS})) || ' ' || substr(t, e + 1, {CONTEXT_CHARS})), '{whole_word(k.context)}') THEN {CONTEXT_BONUS} ELSE 0 END) AS score FROM q{i})",
            f"s{i} AS (SELECT rid, s, {i} AS rank, e, '{k.name}' AS kind FROM r{i} WHERE {keep})",
        ]
    base = " UNION ALL ".join(f"SELECT * FROM s{i}" for i, k in enumerate(KINDS) if k.base)
    more = " UNION ALL ".join(f"SELECT * FROM s{i}" for i, k in enumerate(KINDS) if not k.base)
    ctes += [
        f"base AS ({base})", f"more AS ({more})",
        "spans AS (SELECT *, true AS b FROM base UNION ALL SELECT m.*, false AS b FROM more m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = m.rid AND m.s < x.e AND x.s < m.e))",
        "g AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (b), '') AS base, "
        + ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base) + " FROM spans GROUP BY rid)",
    ]
    counts = ", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in KINDS if k.base)
    return f"WITH {', '.join(ctes)} SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"
