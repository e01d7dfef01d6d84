import re

from hashgrove.llm import pii, secrets

PAIR = "doc_id long, text string"


def test_many_matches_in_one_text(spark):
    """Offsets, context and overlaps where matches outnumber a group and blocks are crossed."""
    lines = [f"é𝄞 login {'x' * (i % 37)} 10.{i % 300}.2.3 tel 555-123-{1000 + i} a{i}@b.com +1 555-123-{1000 + i}\n" for i in range(3000)]
    text = "".join(lines)
    want = {"email": [m.span() for m in re.finditer(r"a\d+@b\.com", text)], "phone": [m.span() for m in re.finditer(r"\+1 555-123-\d{4}", text)],
            "ip": [m.span() for m in re.finditer(r"\d+\.(\d+)\.2\.3", text) if int(m[1]) <= 255], "tel": [m.span(1) for m in re.finditer(r"tel (555-123-\d{4})", text)]}
    row = spark.createDataFrame([(1, text)], PAIR)
    found = pii.find_personal_data(row).first().pii
    assert {k: [(s.start, s.end) for s in found if s.kind == k] for k in want} == want
    assert all(text[s.start : s.end] == s.text for s in found) and {s.kind for s in found} == set(want)
    at, out = 0, []
    for s in sorted(found, key=lambda s: (s.start, s.rank)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    assert pii.redact(row).first().text == "".join(out) + text[at:]


def test_secrets_in_runs_without_an_end():
    """Each text takes time in proportion to its length."""
    for text in ("a@b" + ".c" * 300_000, "token" * 300_000, "a." * 300_000, "token " + " " * 300_000, "-----BEGIN PRIVATE KEY-----" * 15_000):
        assert not list(secrets.candidates(text))
    names = {"token = 'abcdef1'": "abcdef1", "my.key2_token=abcdef1": "abcdef1", "tokens.token_x: abcdef1": "abcdef1", "token-count= abcdef1": None}
    assert {t: next((v for _, _, v, _ in secrets.candidates(t)), None) for t in names} == names
