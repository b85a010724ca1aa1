"""Personal data, and the terms that give it away.

Fixed patterns find the protected entities: mail and IP addresses, payment cards, phone numbers. A term is then judged by what it
tells about an entity in the corpus: of the entity's own information, log2(N / n(c)) bits, a term that stands beside it tells
log2(N n(c, t) / (n(c) n(t))) bits. N: words of all documents; n(c), n(t): places of the entity and of the term; n(c, t): places of
the entity with the term among the words next to it. Terms that tell more than a stated share of the entity's bits are taken out
of the documents that hold the entity. They are generalised (letters after the first few, or digits, are blanked), if what is left
tells less than that share by the same counts, summed over all terms with that generalisation; else they are removed.

Everything is DataFrame functions; no Python runs on the executors. Matches have no positions in SQL, so they come from lengths:
a pattern's matches and the gaps between them (``split`` by the same pattern) alternate, and running sums of both are the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vigilume.llm.arrow_rows import texts_of
from vigilume.session import stored

#: In this order in digests; ``term`` spans come after those of the patterns.
KINDS = ("email", "ip", "card", "phone", "term")
#: Java patterns. A run of characters is tried from its first one only (or from the end of the match before), as later ones can do
#: no better, and repeated groups are possessive: nothing that follows could make them give back, and they don't recurse.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What every match of a kind holds; texts without it aren't searched.
HINT = {"email": "@", "ip": ".", "phone": "+"}
WORD = r"[\p{L}\p{N}\p{M}]++(?:['’_-][\p{L}\p{N}\p{M}]++)*+"
#: Prefix sums work in blocks of this many items.
BLOCK = 64


@dataclass(frozen=True)
class Disclosure:
    """``share``: of an entity's bits that a term may tell at most. ``contexts``: different surroundings of an entity in which a
    term must stand to be judged (copies of one passage are one). ``words``, ``reach``: a term stands beside an entity when it is
    among so many words, and so many code points, before or after it, with no entity of that kind between. ``kept``: letters left of
    a generalised term."""

    share: float = 0.9
    contexts: int = 3
    words: int = 8
    reach: int = 200
    kept: int = 4


def starts_of(lengths: Column) -> Column:
    """Sums of all lengths before each one, in blocks, so that the work isn't quadratic in a long array.

    ``lengths`` is a column of its own: inside the lambdas an expression would be worked out again for each item.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(lengths, k * BLOCK + 1, BLOCK))
    before = F.aggregate(
        F.transform(blocks, total), F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    )
    inside = lambda block, base: F.transform(block, lambda _, j: base + total(F.slice(block, 1, j)))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, n), inside))


def _lengths(gaps: Column, matches: Column) -> Column:
    """Code points of each gap and the match after it; the last gap has none."""
    return F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))


def match_starts(at: Column, gaps: Column) -> Column:
    """Where each match starts (and the text's length at the end), from :func:`starts_of` of the lengths."""
    return F.zip_with(at, gaps, lambda x, gap: x + F.length(gap))


def _digits(match: Column) -> Column:
    return F.translate(match, " ()-.+", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(sum_: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return sum_ + F.when((n - i) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    """One spelling for an entity, the kind before it."""
    value = F.lower(match) if kind in ("email", "ip") else _digits(match)
    return F.concat(F.lit(f"{kind}:"), value)


def with_spans(texts: DataFrame) -> DataFrame:
    """Add, for each kind, ``gaps_<kind>`` (the text between matches), ``<kind>``: array of (start, stop, ok, value) by start."""
    found = texts
    for kind, pattern in PATTERNS.items():
        hinted = F.contains(F.col("text"), F.lit(HINT[kind])) if kind in HINT else F.lit(True)
        nothing = F.array().cast("array<string>")
        found = found.withColumn(f"m_{kind}", F.when(hinted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing))
        # the pattern runs again only where it matches
        found = found.withColumn(f"gaps_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(nothing))
    for kind in PATTERNS:
        found = found.withColumn(f"len_{kind}", _lengths(F.col(f"gaps_{kind}"), F.col(f"m_{kind}")))
    for kind in PATTERNS:
        found = found.withColumn(f"at_{kind}", F.when(F.size(f"m_{kind}") > 0, starts_of(F.col(f"len_{kind}"))))
    return found.select("*", *[_spans(kind).alias(kind) for kind in PATTERNS]).select(*texts.columns, *PATTERNS, *[f"gaps_{k}" for k in PATTERNS])


def _spans(kind: str) -> Column:
    def span(start: Column, match: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(match)).alias("stop"), _holds(kind, match).alias("ok"), match.alias("value"))

    n = F.size(f"m_{kind}")
    spans = F.zip_with(match_starts(F.col(f"at_{kind}"), F.col(f"gaps_{kind}")), f"m_{kind}", span)
    none = F.array().cast("array<struct<start:int,stop:int,ok:boolean,value:string>>")
    return F.when(n > 0, F.slice(spans, 1, n)).otherwise(none)


def contexts(found: DataFrame, how: Disclosure) -> DataFrame:
    """(key, entity, near): a row for each place of an entity, with the distinct lower-case words beside it."""
    # explode() would bring a filter on its argument, which is pushed to the scan and works out all patterns once more
    met = found.select("key", F.explode_outer(F.concat(*[_surroundings(kind, how) for kind in PATTERNS])).alias("p"))
    return met.where("p.ok").select("key", "p.entity", F.array_distinct("p.near").alias("near"))


def _surroundings(kind: str, how: Disclosure) -> Column:
    """(ok, entity, near) of each match of a kind."""
    word = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def beside(place: Column) -> Column:
        before, after = place["before"], place["after"]
        cut_before, cut_after = word(F.right(before, F.lit(how.reach))), word(F.left(after, F.lit(how.reach)))
        # a word that the reach cuts isn't whole
        whole_before = F.when(F.length(before) > how.reach, F.slice(cut_before, 2, how.reach)).otherwise(cut_before)
        whole_after = F.when(F.length(after) > how.reach, F.slice(cut_after, 1, F.greatest(F.size(cut_after) - 1, F.lit(0)))).otherwise(cut_after)
        near = F.concat(F.slice(F.reverse(whole_before), 1, how.words), F.slice(whole_after, 1, how.words))
        span = place["span"]
        return F.struct(span["ok"].alias("ok"), _entity(kind, span["value"]).alias("entity"), F.transform(near, F.lower).alias("near"))

    gaps = F.col(f"gaps_{kind}")
    # the last gap has no match of its own: its place has no ``ok`` and goes
    zipped = F.arrays_zip(F.col(kind).alias("span"), gaps.alias("before"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("after"))
    return F.transform(zipped, beside)


def general(term: Column, kept: int) -> Column:
    """A term's generalisation: digits blanked where it holds one, else its first letters; NULL where nothing would be left out."""
    blanked = F.regexp_replace(term, r"\p{N}", "0")
    short = F.when(F.length(term) > kept, F.concat(F.substring(term, 1, kept), F.lit("*")))
    return F.when(term.rlike(r"\p{N}"), F.when(blanked != term, blanked)).otherwise(short)


def disclosing_terms(places: DataFrame, docs: DataFrame, how: Disclosure) -> DataFrame:
    """(entity, term, instead): terms that tell too much about an entity beside which they stand; ``instead``: the
    generalisation, NULL where the term is to be removed. ``places`` is of :func:`contexts`, ``docs`` has all texts."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    counts = stored(words.groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("n_t")), "pii-words")
    of_entity = places.groupBy("entity").agg(F.count("*").alias("n_c"))
    # an entity met once in the corpus, or in one surrounding only, is settled before its words are counted
    judged = (
        places.groupBy("entity", F.xxhash64(F.array_sort("near")).alias("around")).agg(F.lit(1).alias("one")).groupBy("entity")
        .agg(F.count("*").alias("arounds")).where(F.col("arounds") >= how.contexts).select("entity")
    )
    beside = places.join(judged, "entity").select("entity", F.xxhash64(F.array_sort("near")).alias("around"), F.explode("near").alias("term"))
    pairs = stored(
        beside.groupBy("entity", "term", "around").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("arounds"))
        .withColumn("general", general(F.col("term"), how.kept)),
        "pii-pairs",
    )
    n_all = F.lit(float(counts.agg(F.sum("n_t")).first()[0] or 0))

    def told(joint: Column, alone: Column) -> Column:
        """Share of the entity's bits; places of a word beside two places of the entity count once."""
        joint = F.least(joint, alone).cast("double")
        own = F.log2(n_all / F.col("n_c"))
        return F.when(own > 0, F.log2(n_all * joint / (F.col("n_c") * alone)) / own).otherwise(0.0)

    candidates = pairs.where(F.col("arounds") >= how.contexts)
    telling = (
        candidates.join(counts, "term").join(of_entity, "entity")
        .where(told(F.col("n_ct"), F.col("n_t")) > how.share)
    )
    # what the generalisations of the telling terms tell, by the words of the whole corpus
    wider = telling.where("general is not null").select("general").distinct()
    n_general = counts.withColumn("general", general(F.col("term"), how.kept)).join(wider, "general", "left_semi").groupBy("general").agg(F.sum("n_t").alias("n_g"))
    joint = pairs.where("general is not null").groupBy("entity", "general").agg(F.sum("n_ct").alias("n_cg"))
    both = telling.join(n_general, "general", "left").join(joint, ["entity", "general"], "left")
    hides = F.coalesce(told(F.col("n_cg"), F.col("n_g")) <= how.share, F.lit(False))
    return both.select("entity", "term", F.when(hides, F.col("general")).alias("instead"))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["stop"]))


def _joined(pieces: list[Column]) -> Column:
    return F.array_join(F.concat(*pieces), ",")


def _placeholder(kind: str):
    return lambda match: F.when(_holds(kind, match), F.lit(f"[{kind}]")).otherwise(match)


def _rebuilt(text: Column, pattern: str, put: Column) -> Column:
    """The text with its matches of ``pattern`` replaced by the items of ``put``, as many."""
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), put, lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")


def sanitise(docs: DataFrame, how: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_email, n_ip, n_card, n_phone, n_term, base_spans, spans, sanitised).

    ``base_spans`` and ``spans`` are ``kind:start:stop`` items, comma-joined, by kind and then by start; code points of the text,
    end exclusive. A NULL text counts as empty: no spans, and an empty ``sanitised``. In ``sanitised`` each entity is replaced by its
    kind in brackets (kinds in their order, so of two that overlap the first is replaced) and each disclosing term by its
    generalisation or by ``[removed]``: in every place of a document in which the term stands beside the entity it tells of, but
    for words that overlap an entity. Documents without an entity have no spans. Repeated rows and rows without an id are rows of their
    own. Only the two named columns are read, whatever others there are.
    """
    rows = texts_of(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.md5("text"))
    found = with_spans(keyed)
    places = stored(contexts(found, how), "pii-places")
    telling = disclosing_terms(places, rows, how)
    # one row for each text that holds a telling term's entity, dealt to salted copies for texts that many rows share
    salts = 16
    flagged = (
        places.select("key", "entity", F.explode("near").alias("term")).join(telling, ["entity", "term"]).groupBy("key", "term")
        .agg(F.when(F.count("instead") == F.count("*"), F.min("instead")).alias("instead"))
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("instead", F.lit("[removed]"))))).alias("terms"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    shown = [F.filter(k, lambda s: s["ok"]).alias(k) for k in PATTERNS]
    # rows are numbered so that the filters aren't pushed to the scan with all patterns in them
    numbered = found.select("id", "text", "key", *shown).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    holds_one = sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0
    holders = numbered.where(holds_one & (F.col("salt") >= 0)).join(flagged, ["key", "salt"], "left").drop("key", "salt")
    plain = numbered.where(~holds_one & (F.col("salt") >= 0)).drop("key", "salt").withColumn("terms", F.lit(None).cast("map<string,string>"))
    return _results(holders.unionByName(plain), id_col)


def _results(rows: DataFrame, id_col: str) -> DataFrame:
    """From (id, text, one array of spans for each kind, terms): what :func:`sanitise` returns."""
    told = F.col("terms").isNotNull()
    at = (
        rows.withColumn("words", F.when(told, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
        .withColumn("between", F.when(told, F.split("text", WORD, -1)))
        .withColumn("len", _lengths(F.col("between"), F.col("words")))
        .withColumn("at", F.when(told, starts_of(F.col("len"))))
    )
    entities = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for k in PATTERNS])

    def word_span(start: Column, word: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(word)).alias("stop"), F.lower(word).alias("term"))

    every = F.slice(F.zip_with(match_starts(F.col("at"), F.col("between")), "words", word_span), 1, F.size("words"))
    telling = F.filter(every, lambda s: F.map_contains_key("terms", s["term"]))
    apart = F.filter(telling, lambda s: ~F.exists(F.col("entities"), lambda e: (e["start"] < s["stop"]) & (s["start"] < e["stop"])))
    none = F.array().cast("array<struct<start:int,stop:int,term:string>>")
    spanned = at.withColumn("entities", F.when(told, entities)).withColumn(
        "term", F.when(told, apart).otherwise(none)
    )
    base = [_listed(k, F.col(k)) for k in PATTERNS]
    out = spanned.withColumn("sanitised", F.col("text"))
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("sanitised", F.lit(pattern), F.lit(0))
        put = F.transform(found, _placeholder(kind))
        out = out.withColumn("sanitised", F.when(F.size(kind) > 0, _rebuilt(F.col("sanitised"), pattern, put)).otherwise(F.col("sanitised")))
    replaced = F.transform(F.regexp_extract_all("sanitised", F.lit(WORD), F.lit(0)), lambda w: F.coalesce(F.try_element_at("terms", F.lower(w)), w))
    return out.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        _joined(base).alias("base_spans"),
        _joined([*base, _listed("term", F.col("term"))]).alias("spans"),
        F.when(told, _rebuilt(F.col("sanitised"), WORD, replaced)).otherwise(F.col("sanitised")).alias("sanitised"),
    )
