import hashlib
import random
import re

from triplewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base spans by the stated patterns."""
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_equals_patterns_on_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", "B", "1", "25", "4", ".", "@", "+", " ", "-", "(", ")", "%", "é", "x.y", "4111 1111 1111 1111", "١"]) for _ in range(rng.randint(0, 25)))
        assert pii.joined(pii.base_spans(t)) == plain(t), t


def test_digests_equal_patterns(odd, documents):
    for df in (odd, documents):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        rows = pii.digests(df).collect()
        assert len(rows) == len(texts)
        for r in rows:
            base = plain(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert r.n_email == base.count("email:") and r.n_phone == base.count("phone:")
            assert set(base.split(",")) <= set(r.spans.split(",")) or not base
    assert pii.digests(odd.limit(0)).count() == 0


def test_method_adds_kinds():
    text = "Bank account IBAN GB82 WEST 1234 5698 7654 32 and SSN 078-05-1120, not 078-05-1121 standing far away from any such word at all, never."
    kinds = [s[0] for s in pii.all_spans(text)]
    assert "iban" in kinds and kinds.count("national_id") >= 1
    assert not pii.all_spans("GB82 WEST 1234 5698 7654 33")
    assert pii.redact("a b@c.de f", pii.all_spans("a b@c.de f")) == "a [EMAIL] f"


def test_ibans_end_at_a_blank():
    iban, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for text, found in (
        (f"IBAN {iban} BIC COBADEFF", [iban]),
        ("DE89370400440532013000 2024", ["DE89370400440532013000"]),
        (f"{iban} {other} EUR", [iban, other]),
        (f"AB12 REF0 {iban} X", [iban]),
        ("IBAN GB82 WEST 1234 5698 7654 33 BIC", []),
    ):
        assert [text[a:b] for a, b in pii._ibans(text)] == found, text


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "1 " * 150_000, "A" * 300_000, "@a" * 100_000):
        pii.all_spans(t)


def test_redacted_keeps_columns(odd):
    out = pii.redacted(odd)
    assert out.schema == odd.schema and out.count() == odd.count() and out.where("text is null").count() == 1
    assert pii.find(odd).where("size(pii) > 0").count() == 0
