"""Sanitised texts: clashing columns, long texts with many spans, digests of the query."""

import hashlib
import random
import re

from wayline.llm import pii, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CASES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in CASES.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def plain_sanitised(text, spans):
    at, out = 0, []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], list(CASES).index(s[0]))):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def texts(seed=2):
    rng = random.Random(seed)
    parts = ["a@b.co", "x.y@z-1.example.org", "10.0.0.255", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (617) 555-0100", "word", "Größe", "\U0001f600", "\n", "1.2.3.4@x.de"]
    out = ["".join(rng.choice([" ", "", ", "]) + rng.choice(parts) for _ in range(n)) for n in (0, 1, 5, 40, 63, 64, 65, 400, 3000)]
    return [*out, None, "", "x" * pii.CHUNK, "a@b.co" + "y" * pii.CHUNK * 2 + " a@b.co", ("a@b.co " * 600 + "z" * 700 + " ") * 4]


def test_spans_and_texts_against_a_plain_reading(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_disclosure_sanitising"](spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        spans = plain_spans(text or "")
        assert [got[i][f"n_{k}"] for k in CASES] == [sum(s[0] == k for s in spans) for k in CASES]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and got[i]["spans"].startswith(line)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, min_support=10**6).collect()}
    for i, text, *_ in rows:
        assert clean[i] == (text if not text else plain_sanitised(text, plain_spans(text)))


def test_columns_of_any_name_survive(spark):
    names = ["_base", "base", "terms", "_row", "row", "number", "strong", "a.b", "text_number", "_strong"]
    rows = spark.createDataFrame([(1, "mail a@b.co now", *names), (2, None, *names), (2, "plain", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.sanitise(rows)
    assert out.columns == rows.columns
    assert {tuple(r) for r in out.collect()} == {(1, "mail <email> now", *names), (2, None, *names), (2, "plain", *names)}
    assert pii.sanitise(rows.limit(0)).count() == 0


def test_terms_of_long_texts_are_found_in_all_pieces(spark):
    secret, filler = "zorbleck", "plain words go on and on "
    rows = [(i, f"note {i} {secret} boss@corp.example") for i in range(6)] + [(100 + i, f"{filler}{i}") for i in range(60)]
    long = (filler * 2000 + secret + " ") * 5
    rows += [(500, long)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert secret not in out[500] and len(out[500]) < len(long) and out[500].count("plain words") == 10_000
    assert all(secret not in out[i] for i in range(6)) and all(out[100 + i] == f"{filler}{i}" for i in range(60))
