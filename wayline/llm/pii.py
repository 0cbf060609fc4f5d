"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans (email, ip, card, phone) are the protected entities. Corpus co-occurrence then says how strongly a word reveals an
entity: with P over whole documents, disclosure(t, e) = PMI(t, e) / IC(e), which is 1 where the word occurs only with the
entity and at most 0 where both are independent. A word with enough support is removed from ``remove`` on and generalised from
``generalise`` on, at every place of every document, by its strongest entity: it reveals that entity also where the entity itself
is not written. Base spans are always generalised to their kind.

Spans are code points, end exclusive. They follow from the text alone, so equal texts share them and count once per text as
support (a group of copies is no evidence). Null texts count as empty; null or repeated doc_ids are rows of their own. Kinds may
overlap each other; in the sanitised text overlapping spans become one placeholder. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import staged

#: Patterns of the base kinds, in order. Possessive, and starting only where a run starts or the last match ended,
#: which finds the same leftmost matches in time that is linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
WORD = r"(?<![\p{L}\p{N}_@.-])\p{L}{3,}+(?![\p{L}\p{N}_@])"
#: A stretch of text that ends where neither a word nor what decides whether it is one can go on.
PIECE = r"(?s).{1,500}+[\p{L}\p{N}_@.-]*+"
FILTER_BITS = 1 << 20
MIN_SUPPORT, GENERALISE, REMOVE = 3, 0.6, 0.9


BLOCK = 64  # items that one inner loop walks through; lists grow by blocks, so that long texts take time linear in their length
CHUNK = 4_096  # code points of a text between two places that are found without counting


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def walk(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Array of structs ``kind`` from one pass over a list that is not empty: ``step`` maps (struct<at int, out array>, item) to the next such struct."""
    none = F.array().cast(f"array<struct<{kind}>>")

    def block_step(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<{kind}>>>").alias("outs"))
    return let(items, lambda x: F.aggregate(_blocks(x), start, block_step, lambda acc: F.flatten(acc["outs"])))


def matches(text: Column, pattern: str) -> Column:
    """Matches of ``text`` with their places: array<struct<start, end, value>>. The stretches between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("value")), lambda p: p["value"].isNotNull())
    return F.when(text.rlike(pattern), walk(pairs, "start:int,end:int,value:string", step))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == KINDS.index(kind)


def _tagged(kind: int, m: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))


def _holds(kind: str, m: Column) -> Column:
    value = m["value"]
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", _digits(value))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind as listed, then start; ``kind`` is the place in KINDS."""
    parts = []
    for kind, pattern in PATTERNS.items():
        kept = F.filter(matches(text, pattern), partial(_holds, kind))
        tagged = F.transform(kept, partial(_tagged, KINDS.index(kind)))
        parts.append(F.coalesce(tagged, F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")))
    return F.concat(*parts)


def terms_of(text: Column) -> Column:
    """Distinct lower-case words of the whole text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def protected(docs: DataFrame) -> DataFrame:
    """(text_number, entities, terms): distinct entities and words of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).withColumn("base", base_spans(F.col("text")))
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    return rows.select(F.xxhash64("text").alias("text_number"), entities.alias("entities"), terms_of(F.col("text")).alias("terms"))


def _maybe(words: DataFrame, strong: DataFrame) -> DataFrame:
    """``words`` without most that are not in ``strong``, by one row of FILTER_BITS bits; the join that follows is exact."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    at, mask = F.floor(bit / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {FILTER_BITS}) % 64 AS int))")
    set_bits = strong.select(at.alias("at"), mask.alias("mask"))
    blank = strong.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("mask"))
    longs = set_bits.unionByName(blank).groupBy("at").agg(F.bit_or("mask").alias("mask"))
    row = longs.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mask"))), lambda x: x["mask"]).alias("bits"))
    near = words.crossJoin(F.broadcast(staged(row)))  # of fixed size
    return near.filter(F.get("bits", at).bitwiseAND(mask) != 0).drop("bits")


def disclosures(docs: DataFrame, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(text_number, strong): the disclosing words of each text that has any, with the strongest disclosure of each, as a map.

    An entity and a term are counted together only where the counts of both allow ``generalise``: with both <= n_entity,
    disclosure >= g needs n_term <= n^(1-g) n_entity^g. Nothing that could be strong is left out.
    """
    known = staged(protected(docs))
    n = float(known.count())
    texts = known.filter(F.size("entities") > 0).groupBy("text_number").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    held = staged(texts)
    entities = held.select("text_number", "copies", F.explode("entities").alias("entity"))
    of_entity = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).filter((F.col("texts") >= min_support) & (F.col("n_entity") < n)).drop("texts")
    placed = staged(entities.join(of_entity.hint("merge"), "entity").withColumn("most", F.pow(F.lit(n), F.lit(1 - generalise)) * F.pow("n_entity", F.lit(generalise)) * (1 + 1e-9)))
    of_text = placed.groupBy("text_number").agg(F.max("most").alias("reach"))
    words = staged(held.join(of_text.hint("merge"), "text_number").select("text_number", "reach", F.explode("terms").alias("term")))
    of_term = known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") >= min_support)
    rare = staged(words.join(of_term.hint("merge"), "term").filter(F.col("n_term") <= F.col("reach")).select("text_number", "term", "n_term"))
    pairs = placed.join(rare.hint("merge"), "text_number").filter(F.col("n_term") <= F.col("most"))
    together = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("support"), F.sum("copies").alias("both")).filter(F.col("support") >= min_support)
    pmi = F.log2(F.col("both") * n / (F.col("n_entity") * F.col("n_term")))
    strength = together.select("term", (pmi / F.log2(n / F.col("n_entity"))).alias("disclosure")).filter(F.col("disclosure") >= generalise)
    strong = staged(strength.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    hits = _maybe(known.select("text_number", F.explode("terms").alias("term")), strong).join(strong.hint("merge"), "term")
    listed = F.collect_set(F.struct("term", "disclosure"))  # of one text
    return staged(hits.groupBy("text_number").agg(F.map_from_entries(listed).alias("strong")))


def term_spans(text: Column, strong: Column, base: Column, remove: float = REMOVE) -> Column:
    """array<struct<kind, start, end, value>>: every place of the words of ``strong`` in the whole text, outside base spans.

    The text is read in pieces that end where no word can go on, so that long texts take time linear in their length.
    """
    span = "array<struct<kind:int,start:int,end:int,value:string>>"
    none, blank = F.array().cast("array<struct<start:int,end:int,value:string>>"), F.array().cast(span)

    def step(near: Column, acc: Column, piece: Column) -> Column:
        known = F.filter(F.coalesce(matches(piece, WORD), none), lambda w: F.map_contains_key(strong, F.lower(w["value"])))
        spans = F.transform(known, lambda w: F.struct(
            F.lit(len(PATTERNS)).alias("kind"), (w["start"] + acc["at"]).alias("start"), (w["end"] + acc["at"]).alias("end"),
            F.when(F.try_element_at(strong, F.lower(w["value"])) >= remove, "remove").otherwise("generalise").alias("value"),
        ))
        clear = F.filter(spans, lambda w: ~F.exists(near, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["out"], clear).alias("out"))

    def block_step(acc: Column, block: Column) -> Column:
        """A block of pieces against the base spans that reach into it."""
        to = F.aggregate(block, acc["at"], lambda n, p: n + F.length(p))
        inner = lambda near: F.aggregate(block, F.struct(acc["at"].alias("at"), blank.alias("out")), partial(step, near))
        return let(to, lambda end: let(F.filter(base, lambda b: (b["end"] > acc["at"]) & (b["start"] < end)), lambda near: let(
            inner(near), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("outs"))
    found = let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.aggregate(_blocks(x), start, block_step, lambda acc: F.flatten(acc["outs"])))
    return F.when(strong.isNotNull() & (F.length(text) > 0), found).otherwise(blank)


def _marked(docs: DataFrame, remove: float = REMOVE, **thresholds) -> DataFrame:
    """(row, text, number, base, terms): every row of ``docs`` as one struct, whatever its columns are called."""
    hidden = disclosures(docs, **thresholds).withColumnsRenamed({"text_number": "number"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.xxhash64(text).alias("number"))
    rows = rows.join(hidden.hint("merge"), "number", "left").withColumn("base", base_spans(F.col("text")))
    return rows.select("row", "text", "number", "base", term_spans(F.col("text"), F.col("strong"), F.col("base"), remove).alias("terms"))


def personal_data(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, text_number, base, terms) for every row of ``docs``."""
    rows = _marked(docs.select("doc_id", "text"), **thresholds)
    return rows.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("number").alias("text_number"), "base", "terms")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _stretch(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text that is cut into chunks."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    inner = F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    apart = F.concat(F.substring(chunk(a), start % CHUNK + 1, F.lit(CHUNK)), inner, F.substring(chunk(b), F.lit(1), end % CHUNK))
    return F.when(a == b, F.substring(chunk(a), start % CHUNK + 1, end - start)).otherwise(apart)


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each of its ``spans`` (one at least) replaced by its kind in angle brackets, or left out where its value is ``remove``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("before"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def step(acc: Column, s: Column) -> Column:
        """The stretch before a span and what stands for it; a span that begins inside another one goes with it."""
        mark = F.when((s["kind"] == len(PATTERNS)) & (s["value"] == "remove"), F.lit("")).otherwise(F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">")))
        one = F.array(F.struct(acc["at"].alias("gap"), s["start"].alias("start"), mark.alias("mark")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    marks = walk(ordered, "gap:int,start:int,mark:string", step)
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(chunks, lambda c: F.concat(F.array_join(F.transform(marks, lambda m: F.concat(_stretch(c, m["gap"], m["start"]), m["mark"])), ""), _stretch(c, last, F.length(text))))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with hidden personal data; columns and rows stay, texts without any keep their value (null included)."""
    rows = _marked(docs, **thresholds)
    spans = F.concat("base", "terms")
    changed = F.when(F.size(spans) > 0, sanitised(F.col("text"), spans)).otherwise(F.col("row.text"))
    return rows.select(*[changed.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
