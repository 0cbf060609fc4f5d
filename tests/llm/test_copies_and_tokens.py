"""Near copies, repeats, packing, token files, personal data and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import components, decontaminate, jaccard, packing, pii, queries, rans, repeats
from wayline.llm.tokens import BYTE_BPE, WORD_BPE, WordEncoder, tokenizer_path

ROWS = "doc_id long, text string"


def near_texts(n=60, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, None), (5000, ""), (5001, " \t\n "), (5002, "one two"), (5003, "One\ttwo"), (5004, "one two three")]
    for g in range(n):
        base = list(rng.choice(words, int(rng.integers(4, 120))))
        for c in range(int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                copy[int(rng.integers(len(copy)))] = rng.choice(words)
            rows.append((10 * g + c, " ".join(copy)))
    return rows + [(3, rows[-1][1]), (None, rows[-1][1]), rows[-1]]


def brute_components(rows, words=4, threshold=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= threshold * (len(a) + len(sets[j]) - k):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return sorted(((k, len(s), smallest.get(find(i)) if s else k, links[i]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_components_match_all_pairs(spark):
    rows = near_texts()
    got = jaccard.components(spark.createDataFrame(rows, ROWS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize(("light", "block"), [(0, 50), (10**6, 10**6), (30, 200)])
def test_every_boundary_and_block_size_links_alike(spark, light, block):
    from wayline.llm.shingles import shingle_sets

    rows = [r for r in near_texts(30, 4) if r[1] and r[1].strip()]
    sets = {jaccard.set_number(s): s for s in shingle_sets([t for _, t in rows])}
    frame = spark.createDataFrame([(k, i % 3 + 1, s.view(np.int64).tolist()) for i, (k, s) in enumerate(sets.items())], "node long, copies long, tokens array<long>")
    found = jaccard.links(frame, 85, block, light)
    got = {r["node"]: r["root"] for r in components.component_roots(found.filter("b IS NOT NULL").select("a", "b")).collect()}
    counts = {r["a"]: r["n"] for r in found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("n")).collect()}
    keys, parts = list(sets), {k: k for k in sets}

    def find(x):
        while parts[x] != x:
            x = parts[x]
        return x

    want = {}
    for i, a in enumerate(keys):
        for j, b in enumerate(keys[:i]):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                parts[find(a)] = find(b)
                want[a], want[b] = want.get(a, 0) + j % 3 + 1, want.get(b, 0) + i % 3 + 1
    assert counts == want
    assert len({(find(a), got.get(a, a)) for a in keys}) == len({find(a) for a in keys}) == len({got.get(a, a) for a in keys})


def test_one_of_each(spark):
    rows = [(i, *r, "n") for i, r in enumerate(near_texts(20, 2))]
    docs = spark.createDataFrame([(r[1], r[2], r[3]) for r in rows], "doc_id long, text string, row string")
    kept = [tuple(r) for r in jaccard.one_of_each(docs).select("doc_id", "text").collect()]
    want = {(c, k) for k, n, c, _ in brute_components([(r[1], r[2]) for r in rows]) if n}
    assert sorted(k for k, t in kept if t and t.strip()) == sorted({c for c, _ in want})
    assert sum(1 for _, t in kept if not t or not t.strip()) == 3
    assert jaccard.one_of_each(docs.limit(0)).count() == 0 == jaccard.components(docs.limit(0)).count()


def test_component_roots_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    got = dict(tuple(r) for r in components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, *range(200, 260))}


def repeat_rows():
    rng = np.random.default_rng(5)
    say = lambda n, a=4: "".join(chr(97 + x) for x in rng.integers(0, a, n))
    core, wide = say(60), "äöü" * 12
    rows = [(i, say(int(rng.integers(0, 80))) + (core[: int(rng.integers(0, 60))] if i % 2 else "") + say(int(rng.integers(0, 40)))) for i in range(40)]
    return rows + [(100, core), (101, core), (102, "x" + core + "y"), (103, "ab" * 40), (104, "a" * 90), (105, wide), (106, "b" + wide), (107, None), (108, ""), (None, core), (100, core)]


def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(rows, raws, strict=True):
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], hit.astype(int)))) == 1))
        out.append((key, len(r), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~hit])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_places", [20_000, 1])
def test_repeated_bytes(spark, most_places):
    rows = repeat_rows()
    got = repeats.repeated_bytes(spark.createDataFrame(rows, ROWS), 20, 8, most_places).drop("spans")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows, 20)


def brute_passage_words(rows, words):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i : i + words]) for w in texts for i in range(len(w) - words + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        out.append((key, len({j for i in range(len(w) - words + 1) if count[tuple(w[i : i + words])] > 1 for j in range(i, i + words)})))
    return sorted(out, key=str)


def passage_rows(words):
    """Texts of their own, some with a passage of up to 60 short words; other white space, a repeat in one text, near copies."""
    rng = np.random.default_rng(8)
    say = lambda n, k=5000: [f"{x:x}" for x in rng.integers(0, k, n)]
    core = say(60)
    rows = [(i, " ".join(say(int(rng.integers(0, 90))) + (core[: int(rng.integers(words - 5, 61))] if i % 2 else []) + say(int(rng.integers(0, 40))))) for i in range(30)]
    own = say(words)
    rows += [(100, "\t\n".join(core) + "  "), (101, " ".join([*own, "x", *own])), (102, "a " * 150), (103, "  "), (104, None), (105, ""), (None, " ".join(core)), (100, " ".join(core))]
    return rows + [(106, " ".join(say(200))), (107, " ".join(say(words - 1))), *((200 + i, " ".join([*say(i), *core, *say(90 - i)])) for i in range(4))]


@pytest.mark.parametrize(("words", "gram", "most_places"), [(51, 26, 20_000), (51, 26, 1), (8, 3, 20_000)])
def test_repeated_words(spark, words, gram, most_places):
    rows = passage_rows(words)
    numbered = spark.createDataFrame(rows, ROWS).withColumn("text_number", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = repeats.repeated_words(spark.createDataFrame(rows, ROWS), words, gram, most_places)
    got = numbered.join(found, "text_number", "left").select("doc_id", F.coalesce("n_passage_words", F.lit(0))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_passage_words(rows, words)


def test_op3_query_tells_passages_under_400_bytes(spark, tmp_path):
    long = " ".join(f"longer{i}" for i in range(70))
    rows = [*passage_rows(51), (300, "a " + long), (301, long + " b"), (302, long)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op3_run_length_index_dedup(spark, str(tmp_path)).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute_repeats(rows, 400)
    assert sorted(((r[0], r[5]) for r in got), key=str) == brute_passage_words(rows, 51)
    assert any(r[2] == 0 and r[5] > 50 for r in got) and any(r[2] > 0 for r in got)


def test_repeats_of_nothing(spark):
    assert repeats.repeated_bytes(spark.createDataFrame([], ROWS)).count() == 0


def test_run_length_index_finds_all_long_matches():
    rng = np.random.default_rng(0)
    for t in range(60):
        regions = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 70)).astype(np.uint8)) for _ in range(int(rng.integers(1, 5)))]
        regions[0] += regions[-1][:40]
        length = int(rng.integers(2, 18))
        count = Counter(r[i : i + length] for r in regions for i in range(len(r) - length + 1))
        want = {(j, i) for j, r in enumerate(regions) for i in range(len(r) - length + 1) if count[r[i : i + length]] > 1}
        assert {(o, i) for o, s, e in repeats.long_matches(regions, length) for i in range(s, e)} == want


ODD = ["", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "x\t y", "\n", "a　 b", "\x1c a", " <|endoftext|> b", "b<|endoftext|>  c", "it's 's ' s", "é ́a", "a\x1c b c", "Σ ΣΑΣ", " \n", "a  b", "12 3.4, five.", "Naïve, Straße."]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_word_by_word_ids_are_the_librarys(name):
    own = WordEncoder(tokenizer_path(name), 7)
    for text, ids in zip(ODD, own.library.encode_batch(ODD, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == [*ids.ids, 7], text


def token_rows():
    rng = np.random.default_rng(1)
    return [(int(i), " ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "öl", "x1"], int(rng.integers(1, 400))))) for i in rng.permutation(80)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "again"), (3, "again"), (900, "long word " * 9000)]


def library_ids(name, text, end):
    return [*WordEncoder(tokenizer_path(name), None).library.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files_round_trip(spark):
    rows = token_rows()
    files = rans.write_tokens(spark.createDataFrame(rows, ROWS), tokenizer_path(BYTE_BPE))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], list(r["ids"])) for r in rans.read_tokens(files).collect())
    at = 0
    for start, _, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    keys = [g[1] for g in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert sorted((str(k), ids) for _, k, _, ids in got) == sorted((str(k), library_ids(BYTE_BPE, t, 0)) for k, t in rows)
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rans.read_tokens(files, digest=True).collect()}
    assert digest == {(k, s): zlib.crc32(np.array(ids, "<u4").tobytes()) for s, k, _, ids in got}
    assert rans.read_tokens(rans.write_tokens(spark.createDataFrame([], ROWS), tokenizer_path(BYTE_BPE))).count() == 0


def test_blocks_decode_from_checkpoints_and_reject_damage():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 300_000).clip(max=50_000).astype("<u4")
    segment = rans._segment([(1, ids[:200_000].tobytes()), (2, ids[200_000:].tobytes())], 0, 0, 0).to_pylist()[0]
    assert np.array_equal(np.concatenate([x for _, x in rans.documents_of(segment)]), ids) and len(segment["blocks"][0]["checkpoints"]) > 1
    damaged = bytearray(segment["blocks"][0]["words"])
    damaged[100] ^= 1
    segment["blocks"][0]["words"] = bytes(damaged)
    with pytest.raises(rans.CorruptBlock):
        list(rans.documents_of(segment))


def test_packing_places_every_id_once(spark):
    rows = token_rows()
    pieces = packing.pack(spark.createDataFrame(rows, ROWS), tokenizer_path(WORD_BPE)).toPandas()
    by_sequence = pieces.sort_values("offset").groupby("sequence_id")
    for _, g in by_sequence:
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
    sizes = by_sequence["length"].sum()
    assert (sizes < 4096).sum() <= 8  # one open sequence per partition at most
    want = Counter()
    for key, text in rows:
        ids = library_ids(WORD_BPE, text, 2)
        want[str(key)] += len(ids)
    assert Counter({str(k): n for k, n in pieces.assign(k=pieces["doc_id"].astype("Int64").astype(str).replace("<NA>", "None")).groupby("k")["length"].sum().items()}) == want
    ids = np.array(library_ids(WORD_BPE, dict(rows)[900], 2), "<u4")
    for r in pieces[pieces["doc_id"] == 900].itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes()) and r.doc_tokens == len(ids)
    assert packing.pack(spark.createDataFrame([], ROWS), tokenizer_path(WORD_BPE)).count() == 0


def test_neighbours_in_a_shard_are_lexically_near():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 8], [1, 2, 3], [5, 6, 9], [7, 8, 5, 6], [1, 9])]
    assert packing.Index(docs).neighbours(0, np.array([False, True, True, True, True])).tolist() == [3, 2]


PII = [
    (1, "mail a.b@c.de and x@y or q@r.s.t, then z.@a-b.co.uk"), (2, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.4 1.2.3"), (3, "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34"),
    (4, "+1 (017) 555-7713. +49 30 123456 +1 2 +123456789012345678"), (5, None), (6, ""), (None, "é x@y.zz ü"), (8, "a" * 3000 + "@b.c " + "1 " * 4000), (9, "a@b.c%d@e.f+1 555 123 4567@x.y"), (8, "same id k@l.mn"),
]


def brute_base(text):
    spans = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}.get(kind, True):
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(spans)


def test_base_spans(spark):
    got = pii.personal_data(spark.createDataFrame(PII, ROWS)).select("doc_id", pii.written(F.col("base")).alias("s"))
    assert sorted((str(r["doc_id"]), r["s"]) for r in got.collect()) == sorted((str(k), brute_base(t)) for k, t in PII)
    assert pii.personal_data(spark.createDataFrame([], ROWS)).count() == 0


def test_revealing_words_are_hidden_and_others_stay(spark):
    rows = [(i, f"report {i}: Zebulon wrote from zeb@mail.org about number {i} today") for i in range(5)]
    rows += [(10 + i, f"someone wrote from u{i}@mail.org about things") for i in range(30)] + [(50 + i, f"a clean text about things and number {i}") for i in range(40)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, base string")
    found = {r["doc_id"]: r["s"] for r in pii.personal_data(docs.drop("base")).select("doc_id", pii.written(F.concat("base", "terms")).alias("s")).collect()}
    start = rows[0][1].index("Zebulon")
    assert f"term:{start}:{start + 7}" in found[0] and "term" not in found[10]
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and "Python" not in clean._jdf.queryExecution().toString() and "Arrow" not in clean._jdf.queryExecution().toString()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "Zebulon" not in texts[0] and "<email>" in texts[0] and "wrote" in texts[10] and texts[50] == rows[-40][1] and len(texts) == len(rows)


def disclosure_rows():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(rng.choice([f"{a}{b}lo" for a in "bcdfghklmnpr" for b in "aeiou"], n))
    rows = [(i, f"Zebulon {say(30)} {'x@y' if i == 2 else ''} mail zeb@mail.org, {say(300)} Zebulon-{i} {say(3)} über") for i in range(5)]
    rows += [(10 + i, f"{say(20)} call +1 555 123 45{i % 3}7 or u{i % 4}.ab@q.rs; {say(12)} Kvasir{'' if i % 5 else ' qq zebulon'}.") for i in range(20)]
    return rows + [(40, "here Zebulon stands alone: ZEBULON"), *((50 + i, say(15)) for i in range(60)), (3, rows[3][1]), (None, "Zebulon"), (200, None), (201, "")]


def brute_terms(rows, support=3, generalise=0.6, remove=0.9):
    word = re.compile(r"(?<![^\W_])(?<![_@.-])[^\W\d_]{3,}(?![^\W_])(?![_@])")
    found = [(key, t or "", [s.split(":") for s in brute_base(t).split(",") if s]) for key, t in rows]
    held = [({f"{k}:{t[int(a):int(b)].lower()}" for k, a, b in base}, {m[0].lower() for m in word.finditer(t)}) for _, t, base in found]
    best, n = {}, len(rows)
    for e in {e for es, _ in held for e in es}:
        n_e = sum(e in es for es, _ in held)
        for t in {t for es, ts in held if e in es for t in ts}:
            both = sum(e in es and t in ts for es, ts in held)
            texts = {x[1] for x, (es, ts) in zip(found, held, strict=True) if e in es and t in ts}
            d = np.log2(both * n / (n_e * sum(t in ts for _, ts in held))) / np.log2(n / n_e)
            if len(texts) >= support and d >= generalise:
                best[t] = max(d, best.get(t, 0))
    out = []
    for key, t, base in found:
        spans = [(m.start(), m.end(), "remove" if best[m[0].lower()] >= remove else "generalise") for m in word.finditer(t) if m[0].lower() in best]
        out.append((str(key), [s for s in spans if not any(int(a) < s[1] and s[0] < int(b) for _, a, b in base)]))
    return sorted(out)


def test_disclosing_words_are_measured_and_hidden_in_whole_documents(spark):
    rows = disclosure_rows()
    docs = spark.createDataFrame(rows, ROWS)
    got = sorted((str(r["doc_id"]), [(s["start"], s["end"], s["value"]) for s in r["terms"]]) for r in pii.personal_data(docs).collect())
    assert got == brute_terms(rows)
    texts = [r["text"] for r in pii.sanitise(docs).collect()]
    assert len(texts) == len(rows) and not any("zebulon" in (t or "").lower() for t in texts) and texts.count(None) == 1


def test_sanitising_overlaps(spark):
    got = pii.sanitise(spark.createDataFrame([(1, "see 1.2.3.4@x.org now"), (2, None)], ROWS)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["see <email> now", None]


def brute_hits(text, items, window):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = word(text)
    hit, ids = set(), set()
    for key, t in items:
        v = word(t)
        for i in range(max(1, len(v) - window + 1)) if v else ():
            part = v[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    ids |= {str(key)} if key is not None else set()
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_chars", [1 << 24, 8])
def test_contamination(spark, block_chars):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice(["a", "b", "Ça", "d!"], n))
    items = [(i, say(int(rng.integers(1, 8)))) for i in range(6)] + [(3, "zz top"), (9, None), (10, "--"), (None, "b b b b"), (3, "zz top"), (11, "solo")]
    rows = [(i, say(int(rng.integers(0, 40)))) for i in range(40)] + [(100, None), (101, ""), (102, "x ZZ-Top solo! zz top"), (None, "zz top"), (100, "solo")]
    docs, benchmark = spark.createDataFrame(rows, ROWS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, 4, block_chars=block_chars)
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got.collect()) == sorted((str(k), *brute_hits(t, items, 4)) for k, t in rows)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got.filter("doc_id = 102").collect()}
    assert spans[102] == [(2, 13), (15, 21)] or [rows[42][1][a:b] for a, b in spans[102]] == ["ZZ-Top solo! zz top"]
    assert decontaminate.without_contaminated(docs, benchmark.limit(0), 4).count() == len(rows) and decontaminate.contamination(docs.limit(0), benchmark).count() == 0
