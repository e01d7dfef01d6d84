"""Small rules over request texts as native expressions: trimming, HEAD files, credentials, sources, hosts, media types, JSON."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as space at the ends of a text.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BRANCHES = "refs/heads/"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def optional_text(c: Column, longest: int) -> Column:
    """(value, fault): null, absent and blank are null; one of more than ``longest`` characters after trimming is too-long. Length is in UTF-16 units."""
    t = trimmed(c)
    units = F.expr("0") + F.octet_length(F.encode(t, "UTF-16BE")) / 2
    bad = F.coalesce(units > longest, F.lit(False))
    return F.struct(F.when(~bad & (t != ""), t).alias("value"), F.when(bad, "too-long").alias("fault"))


def head_file(kind: Column, target: Column) -> Column:
    return F.when(kind == "symbolic", F.concat(F.lit("ref: "), target, F.lit("\n"))).otherwise(F.concat(target, F.lit("\n")))


def parsed_head(contents: Column) -> Column:
    """(kind, target, branch) of a HEAD file; null if it is none. branch is null where HEAD is detached or names no branch."""
    line = trimmed(contents)
    ref = F.regexp_replace(line, r"^ref:\s*", "")
    symbolic = line.rlike("^ref:")
    good = F.when(symbolic, ref != "").otherwise(line.rlike("^[0-9a-f]{40}$"))
    branch = F.when(symbolic & F.startswith(ref, F.lit(BRANCHES)), F.nullif(F.substr(ref, F.lit(len(BRANCHES) + 1)), F.lit("")))
    return F.when(good, F.struct(F.when(symbolic, "symbolic").otherwise("detached").alias("kind"), F.when(symbolic, ref).otherwise(line).alias("target"), branch.alias("branch")))


def credential(header: Column) -> Column:
    """The token of an Authorization header, of either spelling: Bearer, or Basic's part behind the colon; null if there is none."""
    bearer = F.nullif(F.regexp_extract(header, r"(?i)^Bearer\s+(.+)$", 1), F.lit(""))
    packed = F.nullif(F.regexp_extract(header, r"(?i)^Basic\s+(.+)$", 1), F.lit(""))
    plain = F.try_to_binary(F.regexp_replace(packed, r"\s", ""), F.lit("base64")).cast("string")
    at = F.instr(plain, ":")
    return F.coalesce(bearer, F.when(at > 1, F.substr(plain, at + 1)))


def import_source(url: Column) -> Column:
    """``git:`` and the URL with exactly one .git, without query, fragment and default port; null for what is no URL with a host."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/]+)(/.*)?$"
    scheme, host = F.lower(F.regexp_extract(plain, form, 1)), F.lower(F.regexp_extract(plain, form, 2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, form, 3), "/$", ""), r"\.git$", "")
    return F.when(plain.rlike(form), F.concat(F.lit("git:"), scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.lit(".git")))


def remote_url(request_url: Column, namespace: Column, name: Column) -> Column:
    return F.concat(F.regexp_extract(request_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit("/git/"), namespace, F.lit("/"), name, F.lit(".git"))


def decoded_path(raw: Column) -> Column:
    """(path, fault): each component percent-decoded once, ``+`` kept; one with a bad escape, or that is no UTF-8, is ``malformed``."""
    bad = raw.rlike("%(?![0-9A-Fa-f]{2})")
    plain = F.try_url_decode(F.replace(F.when(bad, F.lit("")).otherwise(raw), F.lit("+"), F.lit("%2B")))
    bad = bad | plain.isNull() | ~F.is_valid_utf8(plain) | F.contains(plain, F.lit("�")) & ~F.contains(F.lower(raw), F.lit("%ef%bf%bd")) & ~F.contains(raw, F.lit("�"))
    return F.struct(F.when(~bad, plain).alias("path"), F.when(bad, "malformed").alias("fault"))


def media_type(path: Column) -> Column:
    """By the suffix of the last component, from the platform-independent table of the standard library; else application/octet-stream."""
    known = mimetypes.MimeTypes(filenames=()).types_map[True]
    table = F.create_map(*[F.lit(x) for k in sorted(known) for x in (k, known[k])])
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream"))


def sensitive_host(host: Column) -> Column:
    """Whether a host is loopback, private, link-local or unspecified, as a name, an IPv4 or IPv6 address, or an IPv4 one mapped to IPv6."""
    name = F.lower(F.regexp_replace(host, r"^\[(.*)\]$", "$1"))
    private4 = lambda a, b: a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    quad = F.transform(F.split(name, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.try_cast("int")))
    is4 = name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(quad, lambda p: p <= 255)
    halves = F.split(name, "::")
    words = lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    left, right = words(F.get(halves, F.lit(0))), words(F.get(halves, F.lit(1)))
    gap = 8 - F.size(left) - F.size(right)
    six = F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right), lambda p: F.conv(p, 16, 10).try_cast("int"))
    is6 = F.contains(name, F.lit(":")) & (F.size(halves) <= 2) & F.forall(F.concat(left, right), lambda p: p.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(halves) == 2, gap >= 1).otherwise(gap == 0)
    at = lambda k: F.get(six, F.lit(k))
    zeros = lambda n: F.forall(F.slice(six, 1, n), lambda x: x == 0)
    mapped = zeros(5) & (at(5) == 65_535) & private4(F.shiftright(at(6), 8), at(6).bitwiseAND(255))
    private6 = (zeros(7) & at(7).isin(0, 1)) | (at(0).bitwiseAND(0xFE00) == 0xFC00) | (at(0).bitwiseAND(0xFFC0) == 0xFE80) | mapped
    return (name == "localhost") | F.endswith(name, F.lit(".localhost")) | F.when(is4, private4(F.get(quad, F.lit(0)), F.get(quad, F.lit(1)))).when(is6, private6).otherwise(False)


def repository_id(uuid: Column) -> Column:
    """``repo_`` and the hexadecimal digits of a UUID, which the caller draws, so that reruns can agree."""
    return F.concat(F.lit("repo_"), F.replace(uuid, F.lit("-"), F.lit("")))


def iso_time(at: Column) -> Column:
    """ISO-8601 with milliseconds, in UTC sessions."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def unix_floor(milliseconds: Column) -> Column:
    return F.floor(milliseconds / 1000)


def two_decimals(c: Column) -> Column:
    return F.round(c, 2)


def strict_json(body: Column, fields: dict[str, str]) -> Column:
    """(value, fault) of a JSON object with these fields of kind string, number or boolean, all optional; a value of another kind
    is ``type``, a text that is no JSON object ``malformed``. Nothing is coerced; other fields are passed over."""
    raw = F.from_json(body, "map<string,string>")
    good = F.try_parse_json(body)
    bad, out = F.lit(False), []
    sql = {"string": "string", "number": "double", "boolean": "boolean"}
    for name, kind in fields.items():
        at = F.try_variant_get(good, f"$.{name}", "variant")
        found = F.schema_of_variant(at)
        right = {"string": found == "STRING", "boolean": found == "BOOLEAN", "number": found.rlike("^(BIGINT|DOUBLE|DECIMAL)")}[kind]
        bad = bad | F.coalesce(~(right | (found == "VOID")), F.lit(False))
        out.append(F.try_variant_get(good, f"$.{name}", sql[kind]).alias(name))
    whole = good.isNotNull() & raw.isNotNull() & F.startswith(F.schema_of_variant(good), F.lit("OBJECT"))
    fault = F.when(~F.coalesce(whole, F.lit(False)), "malformed").when(bad, "type")
    return F.struct(F.when(fault.isNull(), F.struct(*out)).alias("value"), fault.alias("fault"))


def envelope(result: Column | None = None, error: Column | None = None, result_info: Column | None = None) -> Column:
    """The JSON that every answer is wrapped in: errors, messages, result, success, and the paging state of lists."""
    none = F.lit(None).cast("string")
    parts = [(F.array(error) if error is not None else F.array()).alias("errors"), F.array().alias("messages"), (result if result is not None else none).alias("result"), F.lit(error is None).alias("success")]
    if result_info is not None:
        parts.append(result_info.alias("result_info"))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
