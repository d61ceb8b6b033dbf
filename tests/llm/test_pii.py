import hashlib
import random
import re

import pytest

from dayloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and total % 10 == 0,
                    "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return pii.in_order(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("ab1.9@ -+()%0255é") for _ in range(rng.randint(1, 45)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com"),
    ("ask john at example dot com", "email", "john at example dot com"),
    ("to jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
    ("a​b@exam​ple.com", "email", "a​b@exam​ple.com"),
    ("no ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("call plus one two one two five five five zero one nine nine ok", "phone",
     "plus one two one two five five five zero one nine nine"),
    ("host one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguises_map_back(text, kind, span):
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(k, text[s:e]) for k, s, e in found] == [(kind, span)]


@pytest.mark.parametrize("text", ["meet me at noon. Then go", "look at that dot", "one two three four", "é à la carte 3·5"])
def test_plain_prose_is_left_alone(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == [] and pii.masked(text) == text


def test_identifiers_side_by_side_are_found_as_well():
    text = "call +1 (269) 555-3296 4524132264652876 and 4111-1111-1111-1111 4111111111111111 12 34"
    plain = pii.plain_spans(text)
    assert plain == [] and [(k, text[s:e]) for k, s, e in pii.in_order(pii.added_spans(text, plain))] == [
        ("phone", "+1 (269) 555-3296")] + [("card", c) for c in ("4524132264652876", "4111-1111-1111-1111", "4111111111111111")
                                           if pii._luhn(c.replace("-", ""))]
    assert pii.masked(text).startswith("call <phone> ") and pii.masked(text).endswith("<card> <card> 12 34")


def test_digest_and_mask(edge_docs, no_docs):
    rows = {(r["doc_id"], r["spans"]): r for r in pii.digest(edge_docs).collect()}
    text = next(r["text"] for r in edge_docs.collect() if (r["text"] or "").startswith("mail"))
    spans = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
    row = rows[8, spans]
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert rows[3, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = pii.mask(edge_docs)
    assert masked.columns == edge_docs.columns and masked.count() == edge_docs.count()
    out = [r for r in masked.collect() if (r["text"] or "").startswith("mail")][0]
    assert out["text"] == "mail <email> <ip> or <phone> or <card> é𝒳" and out["n_chars"] == len(out["text"])
    assert pii.digest(no_docs).count() == pii.mask(no_docs).count() == 0


@pytest.mark.parametrize("text, kind", [
    ("192 point 168 point 0 point 1", "ip"), ("10 point zero point oh point one", "ip"),
    ("plus one one one oh one one one oh one one", "phone"), ("call plus four one 5 5 5 5 1 2 3 4 now", "phone"),
    ("me [" + " " * 20 + "at ] b.example", "email"),
])
def test_the_gate_lets_all_disguises_through(text, kind):
    spans = pii.added_spans(text, pii.plain_spans(text))
    assert [k for k, _, _ in spans] == [kind]
    assert f"<{kind}>" in pii.masked(text)


def test_white_space_is_scanned_once():
    import time
    text = "a point" + " " * 200_000 + "b"
    began = time.perf_counter()
    assert pii.masked(text) == text
    assert time.perf_counter() - began < 20
