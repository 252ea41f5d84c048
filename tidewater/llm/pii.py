"""Personal data: patterns for the entities themselves, information theory for what reveals them.

E-mail addresses, IP addresses, card numbers and phone numbers are found by pattern and
check. Each distinct value is a protected entity. A term (a word or number
outside the entities, without regard to case) reveals an entity to the degree that seeing
the term informs about it: with n(t) and n(e) the documents that hold term and entity,
n(t, e) those that hold both, at whatever distance, and N all documents, the pointwise
mutual information log(n(t, e) N / (n(t) n(e))) is compared with the entity's information
content log(N / n(e)). For n(t, e) / n(t) stands its lower confidence bound (Wilson's, ``z``
standard deviations below), so that few documents weigh less than many; a pair seen in one
document only (under ``min_support``) is no co-occurrence, and a term that the entity does
not go with more often than not (the bound is under ``least``) hints but does not disclose. A share of
``generalise_from`` or more makes the term a span to generalise and one of ``remove_from``
or more a span to remove, wherever it stands in any document, with the entity or without.
All documents are counted. Entities are values, not kinds: what always stands beside
some address ("mail to") reveals nobody.

Only DataFrame functions are used. Patterns have possessive quantifiers, so that no text
makes the matcher backtrack or recurse deeply; they match what the plain patterns match.

Defined results: a null text is an empty one without spans; repeated rows and copies count once in
n(e) and n(t, e), repeated rows each in n(t) and N, and each gives a row; null ids are kept; an empty table gives no
rows; other columns pass through ``sanitise`` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text

KINDS = ("email", "ip", "card", "phone")
#: A set of terms is broadcast up to so many rows; beyond, it is joined by a shuffle.
BROADCAST_TERMS = 200_000

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The contract's patterns. ``\G`` and the look-behinds only skip places where a match can't begin.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_SPAN = "struct<kind:int,start:int,end:int,value:string>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"
#: Items that a pass over an array gathers before it begins a new block.
AT_ONCE = 512


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(items: str, kind: str, step: str, finish: str = "flatten(a.out)", text: str | None = None) -> str:
    """SQL of one pass over the array ``items`` that carries a position and gathers values of type ``kind``.

    ``step`` turns the state s (pos, out) and the item x into the next state, ``finish`` the last
    state a (pos, and out as blocks) into the result. Adding to an array copies it and cutting a
    string walks it from its start, so the pass gathers blocks of ``AT_ONCE`` items: a text with
    very many matches costs little more for each. With ``text``, items are spans (s, e), and
    ``step`` cuts them from q.t, the block's part of the text, which begins at a.pos.
    """
    part = f"slice(i, 1 + b * {AT_ONCE}, {AT_ONCE})"
    cut = "''" if text is None else f"substring({text}, a.pos + 1, array_max(transform({part}, x -> x.e)) - a.pos)"
    gather = f"aggregate(q.i, named_struct('pos', a.pos, 'out', cast(array() as array<{kind}>)), (s, x) -> {step})"
    block = f"element_at(transform(array(named_struct('i', {part}, 't', {cut})), q -> {gather}), 1)"
    after = f"element_at(transform(array({block}), r -> named_struct('pos', r.pos, 'out', array_append(a.out, r.out))), 1)"
    blocks = f"CASE WHEN size(i) = 0 THEN cast(array() as array<int>) ELSE sequence(0, (size(i) - 1) div {AT_ONCE}) END"
    # the items are bound to a name first, else every block would work them out anew
    return f"element_at(transform(array({items}), i -> aggregate({blocks}, named_struct('pos', 0, 'out', cast(array() as array<array<{kind}>>)), (a, b) -> {after}, a -> {finish})), 1)"


def _with_gaps(matches: str, text: str, pattern: str) -> str:
    """SQL: each match m with the text g before it."""
    return f"zip_with({matches}, slice(split({text}, {_sql(pattern)}, -1), 1, size({matches})), (m, g) -> named_struct('m', m, 'g', g))"


def _positions(kind: int, matches: str, text: str, pattern: str) -> str:
    """SQL for the spans of ``matches``: the text between them gives their places."""
    span = f"named_struct('kind', {kind}, 'start', s.pos + length(x.g), 'end', s.pos + length(x.g) + length(x.m), 'value', x.m)"
    step = f"named_struct('pos', s.pos + length(x.g) + length(x.m), 'out', array_append(s.out, {span}))"
    return f"CASE WHEN size({matches}) = 0 THEN {_NO_SPANS} ELSE {_running(_with_gaps(matches, text, pattern), _SPAN, step)} END"


def _luhn(digits: str) -> str:
    doubled = f"cast(substring({digits}, i, 1) as int) * 2"
    return f"""(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 1
        THEN {doubled} - CASE WHEN {doubled} > 9 THEN 9 ELSE 0 END ELSE cast(substring({digits}, i, 1) as int) END) % 10 = 0)"""


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": f"forall(split(x.value, '[.]'), p -> p RLIKE {_sql(_OCTET)})",
    "card": f"(length({_DIGITS}) BETWEEN 13 AND 19 AND CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_luhn(_DIGITS)} ELSE false END)",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def with_base_spans(df: DataFrame, text_col: str = "__text", out: str = "__base") -> DataFrame:
    """Adds array<struct<kind, start, end, value>>: the valid spans by kind, then start; ends are exclusive code points."""
    found = df
    for kind in KINDS:
        pattern = PATTERNS[kind]
        matches = f"regexp_extract_all({text_col}, {_sql(pattern)}, 0)"
        if kind in _NEEDS:
            matches = f"CASE WHEN instr({text_col}, '{_NEEDS[kind]}') > 0 THEN {matches} ELSE cast(array() as array<string>) END"
        found = found.withColumn(f"__m_{kind}", F.expr(matches))
    for i, kind in enumerate(KINDS):
        found = found.withColumn(f"__s_{kind}", F.expr(_positions(i, f"__m_{kind}", text_col, PATTERNS[kind])))
    valid = [F.expr(f"filter(__s_{kind}, x -> {_VALID[kind]})") for kind in KINDS]
    return found.withColumn(out, F.concat(*valid)).drop(*[f"__{a}_{kind}" for a in "ms" for kind in KINDS])


def _entity() -> Column:
    """One value written in several ways is one entity."""
    return F.expr("concat(kind, ':', CASE WHEN kind >= 2 THEN regexp_replace(value, '[^0-9]', '') ELSE lower(value) END)")


#: A term is a run of letters and digits, whatever its length; digits joined by a point or hyphen are one number
#: and one term (3.14, 2024-05-01). What hangs on an entity without a space and has digits is a piece of it, not a term.
_TERM = r"(?<![\p{L}\p{N}])(?:\p{L}++(?!\p{N})|(?<!\x{FFFF}[\p{L}\p{N}._%+@-]{0,100})(?<!\p{N}[.-])[\p{L}\p{N}]++(?:(?<=\p{N})[.-](?=\p{N})[\p{L}\p{N}]++)*+(?!\x{FFFF})(?!(?<=\p{N})[.-]\x{FFFF}))"
#: ``__text`` with U+FFFF, no character, in the place of the base spans: what the terms are read from, at their places in the text.
_BARE = f"""CASE WHEN size(__base) = 0 THEN __text ELSE {_running(
    "array_sort(transform(__base, x -> named_struct('s', x.start, 'e', x.end)))", "string",
    "CASE WHEN x.e <= s.pos THEN s ELSE named_struct('pos', x.e, 'out', array_append(array_append(s.out, substring(q.t, s.pos - a.pos + 1, x.s - s.pos)), repeat('\\uffff', x.e - greatest(x.s, s.pos)))) END",
    "concat(array_join(flatten(a.out), ''), substring(__text, a.pos + 1))", "__text")} END"""


def _terms(bare: str = "__bare") -> Column:
    """The distinct terms of a text without its base spans; each is lowered by itself, as where it is marked."""
    return F.expr(f"array_distinct(transform(regexp_extract_all({bare}, {_sql(_TERM)}, 0), x -> lower(x)))")


def _marked(bare: str = "__bare", marks: str = "__marks") -> str:
    """SQL: where the terms of the map ``marks`` (term to remove) stand in ``bare``, as (start, end, remove)."""
    kind = "struct<start:int,end:int,remove:boolean>"
    end = "s.pos + length(x.g) + length(x.m)"
    mark = f"array_append(s.out, named_struct('start', s.pos + length(x.g), 'end', {end}, 'remove', x.r))"
    step = f"named_struct('pos', {end}, 'out', CASE WHEN x.r IS NULL THEN s.out ELSE {mark} END)"
    items = _with_gaps(f"regexp_extract_all({bare}, {_sql(_TERM)}, 0)", bare, _TERM)
    items = items.replace("'g', g)", f"'g', g, 'r', element_at({marks}, lower(m)))")
    return f"CASE WHEN {marks} IS NULL THEN cast(array() as array<{kind}>) ELSE {_running(items, kind, step)} END"


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


#: Texts that share so much of their terms are one source; bins of their sketches, bins that have to agree to compare two texts.
NEAR, BINS, BAND = 0.4, 96, 3


def sources(texts: DataFrame) -> DataFrame:
    """(__key, source) of the texts (__key, terms) that are near copies of others; the source is the least key found.

    Terms are dealt by hash into BINS, of which each keeps its least hash; texts that agree in BAND neighbouring bins meet
    in a bucket. There each is compared with the bucket's least key on its whole set of terms, so a bucket costs a
    comparison a text, however large it is. Two texts that share 0.5 of their terms miss all buckets with a
    probability of 0.014, at 0.4 of 0.12.
    """
    hashed = texts.select("__key", F.expr("transform(terms, t -> xxhash64(t))").alias("h"))
    hashed = materialise(hashed)
    in_bins = f"array_sort(transform(h, v -> named_struct('b', pmod(v, {BINS}), 'v', v)))"
    least = f"element_at(transform(array({in_bins}), s -> filter(s, (x, i) -> i = 0 OR s[i - 1].b <> x.b)), 1)"
    band = f"named_struct('band', b, 'bucket', xxhash64(filter(m, x -> x.b div {BAND} = b)))"
    bands = f"element_at(transform(array({least}), m -> transform(array_distinct(transform(m, x -> x.b div {BAND})), b -> {band})), 1)"
    placed = hashed.select("__key", F.inline(F.expr(bands)))
    buckets = placed.groupBy("band", "bucket").agg(F.min("__key").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    meet = placed.join(buckets, ["band", "bucket"]).where("__key <> lead").select("__key", "lead").distinct()
    pairs = meet.join(hashed, "__key").join(hashed.select(F.col("__key").alias("lead"), F.col("h").alias("g")), "lead")
    both = "size(array_intersect(h, g))"
    links = materialise(pairs.where(F.expr(f"{both} >= {NEAR}D * (size(h) + size(g) - {both})")).groupBy("__key").agg(F.min("lead").alias("source")))
    for _ in range(3):  # a lead may be near a lesser one itself
        up = links.select(F.col("__key").alias("source"), F.col("source").alias("up"))
        # written each time, else the last plan reads the table eight times
        links = materialise(links.join(up, "source", "left").select("__key", F.coalesce("up", "source").alias("source")))
    return links


def revealing_terms(docs: DataFrame, min_support: int = 2, generalise_from: float = 0.8, remove_from: float = 0.95, least: float = 0.5, z: float = 1.64) -> DataFrame:
    """(term, remove): the terms that reveal an entity, and whether one of their shares asks for removal.

    ``docs`` has __doc, __bare, __key (a hash of the text) and __base.
    """
    some = docs.where("size(__base) > 0").select("__doc", "__key", "__base", "__bare").dropDuplicates(["__doc", "__key"])
    # equal texts hold the same entities and terms: each text is looked at once
    texts = some.groupBy("__key").agg(F.count("*").alias("copies"), F.first("__base").alias("__base"), F.first("__bare").alias("__bare"))
    texts = materialise(texts.select("__key", "copies", "__base", _terms().alias("terms")))
    mentions = texts.select("__key", F.inline("__base")).select("__key", _entity().alias("entity")).distinct()
    # a pair needs min_support sources, so its entity needs as many texts, and then as many sources
    shared = materialise(mentions.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_support).select("entity"))
    mentions = materialise(mentions.join(_small(shared), "entity"))
    texts = materialise(texts.join(mentions.select("__key").distinct(), "__key", "left_semi").select("__key", "copies", "terms"))
    mentions = materialise(mentions.join(_small(sources(texts)), "__key", "left").select("__key", "entity", F.coalesce("source", "__key").alias("source")))
    entities = materialise(mentions.select("entity", "source").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support))
    mentions = mentions.join(_small(entities), "entity")
    held = texts.join(mentions.select("__key").distinct(), "__key", "left_semi").select("__key", "copies", F.explode("terms").alias("term"))
    wanted = materialise(held.groupBy("term").agg(F.sum("copies").alias("own"), F.count("*").alias("texts")).where(F.col("texts") >= min_support).select("term", "own"))
    total = docs.count()
    # the tasks count all terms of their documents first; the join then sees one row a term
    in_docs = docs.select(F.explode(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    # n_te is n_e at most, so a term in more documents than this has a share under generalise_from with any entity
    most = F.expr(f"n_e * pow({total}D / n_e, 1 - {generalise_from}D) * (1 + 1e-9D)")
    widest = entities.agg(F.max(most).alias("most")).first()["most"] or 0.0
    counts = materialise(in_docs.join(_small(wanted), "term").where(F.col("n_t") - F.col("own") <= widest).drop("own"))
    each = held.join(_small(counts), "term").join(mentions, "__key").groupBy("entity", "term", "source").agg(F.sum("copies").alias("own"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pairs = each.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.sum("own").alias("own"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pairs = pairs.withColumn("n_t", F.col("n_t") - F.col("own") + F.col("n_te")).where((F.col("n_te") >= min_support) & (F.col("n_t") <= most))
    half = f"{z * z / 2}D"
    bound = f"((n_te + {half}) / n_t - {float(z)}D * sqrt(n_te * (n_t - n_te) / n_t + {half} / 2) / n_t) / (1 + 2 * {half} / n_t)"
    share = F.expr(f"ln({bound} * {total}D / n_e) / nullif(ln({total}D / n_e), 0)")
    scored = pairs.withColumn("share", share).where((F.col("share") >= generalise_from) & F.expr(f"{bound} >= {least}D"))
    return scored.groupBy("term").agg(F.max(F.col("share") >= remove_from).alias("remove"))


def with_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """Adds __base and __terms (sorted spans of revealing terms outside the base spans) to ``df``."""
    docs = with_base_spans(df.withColumn("__text", whole_text(text_col))).withColumn("__key", F.xxhash64("__text")).withColumn("__doc", F.col(id_col)).withColumn("__bare", F.expr(_BARE))
    revealing = materialise(revealing_terms(docs.select("__doc", "__key", "__bare", "__base"), **thresholds))
    hits = docs.select(F.col("__doc").alias("__d"), F.col("__key").alias("__k"), F.explode(_terms()).alias("term")).join(_small(revealing), "term")
    hits = hits.groupBy("__d", "__k").agg(F.map_from_entries(F.collect_set(F.struct("term", "remove"))).alias("__marks"))
    found = docs.join(hits, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    return found.withColumn("__terms", F.expr(_marked())).drop("__marks", "__bare", "__d", "__k")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts, a digest of the base spans, and all spans."""
    found = with_spans(df.select(id_col, text_col), id_col, text_col, **thresholds)
    names = "CASE x.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    base = F.expr(f"array_join(transform(__base, x -> concat({names}, ':', x.start, ':', x.end)), ',')")
    terms = F.expr("array_join(transform(__terms, x -> concat('term:', x.start, ':', x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(__base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """``df`` with its texts sanitised: entities become their kind, revealing terms [TERM] or, if removed, [REMOVED]."""
    found = with_spans(df, id_col, text_col, **thresholds)
    marks = "CASE x.kind " + " ".join(f"WHEN {i} THEN '[{k.upper()}]'" for i, k in enumerate(KINDS)) + " END"
    marked = f"""array_sort(concat(transform(__base, x -> named_struct('s', x.start, 'e', x.end, 'r', {marks})),
        transform(__terms, x -> named_struct('s', x.start, 'e', x.end, 'r', CASE WHEN x.remove THEN '[REMOVED]' ELSE '[TERM]' END))))"""
    step = """CASE WHEN x.s < s.pos THEN named_struct('pos', greatest(s.pos, x.e), 'out', s.out)
        ELSE named_struct('pos', x.e, 'out', array_append(array_append(s.out, substring(q.t, s.pos - a.pos + 1, x.s - s.pos)), x.r)) END"""
    text = f"CASE WHEN size(__marks) = 0 THEN __text ELSE {_running('__marks', 'string', step, "concat(array_join(flatten(a.out), ''), substring(__text, a.pos + 1))", "__text")} END"
    result = found.withColumn("__marks", F.expr(marked)).withColumn("__new", F.expr(text))
    return result.select(*[F.when(F.col(text_col).isNotNull(), F.col("__new")).alias(c) if c == text_col else F.col(c) for c in df.columns])
