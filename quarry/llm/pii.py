"""Personal data: base patterns, and terms that corpus statistics say give them away.

A kind of personal data is a protected entity.  Texts are cut into passages of ``PASSAGE``
words, across line ends.  A term discloses a kind by the pointwise mutual information of
being that term and standing in a passage with the kind, as a share of the kind's own
information content:

    log2(p(term, kind) / (p(term) p(kind))) / -log2 p(kind)

with p over all words of all texts.  A share of 1 means that the term stands in passages
with that kind only.  Terms need ``SUPPORT`` different passages, so that neither rare
words nor copies count.  From ``GENERALISE`` on a term is generalised (replaced by its
kind), from ``REMOVE`` on removed.  A term is acted on at every place in texts that hold
what it discloses; a text without personal data is never touched.

Only built-in functions.  Texts are read twice for the statistics (passages with a kind,
then counts of their terms) and once for the result, and are not exchanged; the first
exchanges the distinct passages that hold a kind.  Guilty terms up to ``LISTED`` are a hash set
in the plan, so that the last pass is narrow; more are joined by term.

Defined results: a null text is empty and has no spans; repeated rows get equal spans; with
too little support nothing is added to the base spans; an empty table gives an empty one;
other columns, whatever their names, are carried and never read; work on a text grows
with its length, not with the square of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
PASSAGE = 48
SUPPORT = 5
GENERALISE = 0.8
REMOVE = 0.95
#: Guilty terms up to this many are listed in the plan; more are joined.
LISTED = 20_000
#: Candidate terms up to this many are broadcast while they are counted; more are joined.
BROADCAST_TERMS = 100_000
#: Spans whose places are added up at once, so that long lists are not copied span by span.
RUN = 256
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One character for each kind stands for its matches in passages, and signs that are in no
#: word and no pattern for the digits of a match's checksum, so that passages with other
#: matches are other passages.
_MARKS, _SIGNS = "\x01\x02\x03\x04", "!\"#$&'*,:;"

# The patterns of the contract, written so that no start inside a run is tried again: a
# match begins where a run begins or where the last match ended; possessive, so that
# no run is too long for the stack.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9]*+(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that cannot have a span of the kind.
_GATE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"
_TERM = "array<struct<s:int,e:int,what:string,k:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not at each place where it is named."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, pattern: str | Column) -> Column:
    """The text as (gap, hit) pairs; the last has no hit."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))


def _located(text: Column, pattern: str | Column) -> Column:
    """All matches as (begin, end, match), in code points from 0."""
    kind = "array<struct<s:int,e:int,m:string>>"
    pieces = _pieces(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        here = F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("m")))
        return F.when(x["hit"].isNull(), a).otherwise(F.struct(e.alias("at"), F.concat(a["found"], here).alias("found")))

    def shifted(a: Column, x: Column) -> Column:
        moved = F.transform(x["found"], lambda y: F.struct((y["s"] + a["at"]).alias("s"), (y["e"] + a["at"]).alias("e"), y["m"].alias("m")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["found"], moved).alias("found"))

    runs = _let(pieces, lambda p: F.transform(_begins(p), lambda i: F.aggregate(F.slice(p, i + 1, F.lit(RUN)), start, step)))
    return F.aggregate(runs, start, shifted, lambda a: a["found"])


def _begins(array: Column) -> Column:
    """Where runs of ``RUN`` members begin, from 0."""
    return F.sequence(F.lit(0), (F.greatest(F.size(array), F.lit(1)) - 1).cast("int"), F.lit(RUN))


def _folded(array: Column, start: dict[str, Column], out: str, step) -> Column:
    """The last state of a fold whose state has a list ``out``, which grows run by run."""
    state = lambda x, rest: F.struct(*((rest if k == "out" else x[k]).alias(k) for k in [*start, "out"]))
    none = F.array().cast(out)

    def run(a: Column, i: Column, whole: Column) -> Column:
        inner = F.aggregate(F.slice(whole, i + 1, F.lit(RUN)), state(a, none), step)
        return _let(inner, lambda x: state(x, F.concat(a["out"], x["out"])))

    return _let(array, lambda w: F.aggregate(_begins(w), state(start, none), lambda a, i: run(a, i, w)))


def luhn(match: Column) -> Column:
    """Does the number of 14 to 19 digits pass the Luhn test?"""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    doubled = F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10)))

    def step(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, F.element_at(doubled, d + 1)).otherwise(d)

    n = F.length(digits)
    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(19))), F.lit(0), step) % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _given(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _any_gate(text: Column) -> Column:
    out = F.lit(False)
    for kind in KINDS:
        out = out | _GATE[kind](text)
    return out


def base_spans(text: Column) -> Column:
    """Base spans by begin, then kind as listed: (s, k, e, m) with the match itself."""
    found = []
    for k, kind in enumerate(KINDS):
        valid = F.filter(_located(text, _PATTERN[kind]), lambda x: _valid(kind, x["m"]))
        spans = F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
        found.append(F.when(_GATE[kind](text), spans).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*found))


def _marked(texts: DataFrame) -> DataFrame:
    """Texts t, lower-cased, with one mark in place of each match; what two kinds match is the first's."""
    out = texts.select(F.translate("t", _MARKS, "    ").alias("t"))
    for k, kind in enumerate(KINDS):
        by = F.transform(_pieces(F.col("t"), _PATTERN[kind]), lambda x: F.concat(x["gap"], F.when(x["hit"].isNull(), "").when(_valid(kind, x["hit"]), F.concat(F.lit(f" {_MARKS[k]}"), F.translate(F.crc32(F.encode(x["hit"], "UTF-8")).cast("string"), "0123456789", _SIGNS), F.lit(" "))).otherwise(x["hit"])))
        out = out.select(F.when(_GATE[kind](F.col("t")), F.array_join(by, "")).otherwise(F.col("t")).alias("t"))
    return out.select(F.translate("t", _UPPER, _LOWER).alias("t"))


def _words(text: Column) -> Column:
    """Words with a character that is no digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: w.rlike("[^0-9]"))


def _counted_words(text: Column) -> Column:
    """Words of a text outside of addresses."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, _PATTERN["email"], " ")).otherwise(text)
    return _words(F.translate(plain, _UPPER, _LOWER))


def _cut(text: Column) -> Column:
    """Passages of ``PASSAGE`` words each, with what stands between the words."""
    word = rf"{_WORD[:-1]}++{_BREAK}*+"
    return F.regexp_extract_all(text, F.lit(rf"(?:\A{_BREAK}*+)?+{word}(?:{word}){{0,{PASSAGE - 1}}}+"), F.lit(0))


def disclosing(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(k, term, share): terms whose share of the kind's information reaches the threshold."""
    given = _given(F.col("text"))
    texts = docs.select(given.alias("t"))
    marked = _marked(texts.filter(_any_gate(F.col("t"))))
    held = marked.select(F.explode(F.filter(_cut(F.col("t")), lambda p: p.rlike(f"[{_MARKS}]"))).alias("p"))
    # copies of a passage meet before the exchange and count with their number
    passages = held.groupBy("p").agg(F.count("*").alias("times"))
    has = [F.col("p").contains(mark).cast("long") for mark in _MARKS]
    rows = passages.select("times", *(x.alias(f"h{k}") for k, x in enumerate(has)), _words(F.col("p")).alias("w"))
    rows = rows.select("times", *(f"h{k}" for k in range(len(KINDS))), "w", F.posexplode("w").alias("i", "term"))
    fresh = (F.array_position("w", F.col("term")) == F.col("i") + 1).cast("long")
    rows = rows.select("term", "times", fresh.alias("fresh"), *(f"h{k}" for k in range(len(KINDS))))
    both = rows.groupBy("term").agg(*(F.sum(F.col("times") * F.col(f"h{k}")).alias(f"both{k}") for k in range(len(KINDS))), *(F.sum(F.col("fresh") * F.col(f"h{k}")).alias(f"seen{k}") for k in range(len(KINDS))))
    both = settle(both)
    of_kind = both.agg(*(F.coalesce(F.sum(f"both{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(KINDS)))).first()
    often = both.filter(F.greatest(*(f"seen{k}" for k in range(len(KINDS)))) >= support)
    known = often.count()
    # the rest of the words are one group, which gives the number of all words
    words = docs.select(F.explode(_counted_words(given)).alias("word"))
    terms = often.select("term")
    if known <= BROADCAST_TERMS:  # counted above
        matched = words.join(F.broadcast(terms), F.col("word") == F.col("term"), "left").groupBy("term").agg(F.count("*").alias("n"))
    else:
        matched = words.groupBy("word").agg(F.count("*").alias("n")).join(terms, F.col("word") == F.col("term"), "left").groupBy("term").agg(F.sum("n").alias("n"))
    counts = settle(matched)
    total = counts.agg(F.sum("n")).first()[0] or 0
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"both{k}").alias("both"), F.col(f"seen{k}").alias("seen"), F.lit(float(of_kind[f"n{k}"])).alias("of")) for k in range(len(KINDS)))))
    rows = often.select("term", kinds.alias("x")).select("term", "x.*").filter((F.col("seen") >= support) & (F.col("of") > 0)).join(counts.filter("term IS NOT NULL"), "term")
    gain = F.log2(F.col("both") * float(total) / (F.greatest("n", "both") * F.col("of")))
    share = F.when(F.col("of") < float(total), gain / -F.log2(F.col("of") / float(total))).otherwise(F.lit(0.0))
    return rows.select("k", "term", F.round(share, 9).alias("share")).filter(F.col("share") >= generalise)


def _guilty_words(text: Column, spans: Column, guilty: list, remove: float) -> Column:
    """(term, what, k) of the text's distinct guilty words; what is guilty by kinds that the text has not is not."""
    sets = [(k, what, {r["term"] for r in guilty if r["k"] == k and (r["share"] >= remove) == (what == "remove")}) for what in ("remove", "generalise") for k in range(len(KINDS))]
    sets = [(k, what, sorted(x)) for k, what, x in sets if x]
    if not sets:
        return F.array().cast("array<struct<term:string,what:string,k:int>>")

    def judged(w: Column, kinds: Column) -> Column:
        out = F.lit(None).cast("struct<what:string,k:int>")
        for k, what, terms in reversed(sets):  # removal first, then kinds as listed
            out = F.when(F.array_contains(kinds, k) & w.isin(terms), F.struct(F.lit(what).alias("what"), F.lit(k).alias("k"))).otherwise(out)
        return out

    words = F.array_distinct(_counted_words(text))
    each = _let(F.array_distinct(F.transform(spans, lambda x: x["k"])), lambda kinds: F.transform(words, lambda w: F.struct(w.alias("term"), judged(w, kinds).alias("j"))))
    return F.transform(F.filter(each, lambda x: x["j"].isNotNull()), lambda x: F.struct(x["term"].alias("term"), x["j"]["what"].alias("what"), x["j"]["k"].alias("k")))


def _places(text: Column, spans: Column, mine: Column) -> Column:
    """(s, e, what, k) of guilty words at all their places that no base span touches."""
    pattern = F.concat(F.lit(rf"(?<!{_WORD[:-1]})(?:"), F.array_join(F.transform(mine, lambda x: x["term"]), "|"), F.lit(rf")(?!{_WORD[:-1]})"))
    named = F.map_from_entries(F.transform(mine, lambda x: F.struct(x["term"], x)))
    words = _located(F.translate(text, _UPPER, _LOWER), pattern)
    words = _let(named, lambda by: F.transform(words, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("o"), x["e"].alias("e"), by[x["m"]]["what"].alias("what"), by[x["m"]]["k"].alias("k"))))
    rows = F.concat(
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("o"), x["e"].alias("e"), F.lit(None).cast("string").alias("what"), x["k"].alias("k"))),
        words,
    )
    # words do not overlap: a base span can touch the last word only, which waits until it cannot
    none = F.array().cast(_TERM)

    def step(a: Column, x: Column) -> Column:
        touched = F.exists(a["wait"], lambda w: w["e"] > x["s"])
        base = F.struct(F.greatest(a["reach"], x["e"]).alias("reach"), none.alias("wait"), F.when(touched, a["out"]).otherwise(F.concat(a["out"], a["wait"])).alias("out"))
        now = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["what"].alias("what"), x["k"].alias("k")))
        word = F.struct(a["reach"].alias("reach"), F.when(x["s"] >= a["reach"], now).otherwise(none).alias("wait"), F.concat(a["out"], a["wait"]).alias("out"))
        return F.when(x["o"] == 0, base).otherwise(word)

    placed = _let(_folded(F.array_sort(rows), {"reach": F.lit(0), "wait": none}, _TERM, step), lambda a: F.concat(a["out"], a["wait"]))
    return F.when(F.size(mine) > 0, placed).otherwise(none)


def _judged(docs: DataFrame, keep: Column, support: int, generalise: float, remove: float, listed: int) -> DataFrame:
    """row (what is kept of each document), text, spans and extra (the method's spans) of each document."""
    guilty = settle(disclosing(docs, support, generalise))
    rows = docs.select(keep.alias("row"), F.col("text").cast("string").alias("text"), _given(F.col("text")).alias("t"))
    rows = rows.withColumn("spans", F.when(_any_gate(F.col("t")), base_spans(F.col("t"))).otherwise(F.array().cast(_SPAN)))
    if guilty.count() <= listed:
        mine = _guilty_words(F.col("t"), F.col("spans"), guilty.collect(), remove)  # counted above
        rows = rows.withColumn("mine", F.when(F.size("spans") > 0, mine).otherwise(F.array().cast("array<struct<term:string,what:string,k:int>>")))
    else:
        rows = _joined(rows, guilty, remove)
    return rows.select("row", "text", "t", "spans", _places(F.col("t"), F.col("spans"), F.col("mine")).alias("extra"))


def _joined(rows: DataFrame, guilty: DataFrame, remove: float) -> DataFrame:
    """The same by joins, for more guilty terms than a plan should list: texts meet their words by a hash of the row."""
    key = F.struct(F.xxhash64("row", "t").alias("h"), F.crc32(F.encode("t", "UTF-8")).alias("c"), F.length("t").alias("n"))
    rows = rows.withColumn("key", F.when(F.size("spans") > 0, key))
    some = rows.filter("key IS NOT NULL").select("key", F.array_distinct(F.transform("spans", lambda x: x["k"])).alias("kinds"), F.explode(F.array_distinct(_counted_words(F.col("t")))).alias("term"))
    what = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    hit = some.join(guilty.select("k", "term", what.alias("what")), "term").filter(F.array_contains("kinds", F.col("k")))
    first = hit.groupBy("key", "term").agg(F.min(F.struct((F.col("what") != "remove").alias("o"), F.col("k").alias("k"), F.col("what").alias("what"))).alias("x"))
    mine = first.groupBy("key").agg(F.collect_list(F.struct("term", F.col("x.what").alias("what"), F.col("x.k").alias("k"))).alias("mine"))
    return rows.join(mine, "key", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<struct<term:string,what:string,k:int>>")))


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, listed: int = LISTED) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for each document."""
    rows = _judged(docs, F.col("doc_id").cast("long"), support, generalise, remove, listed)
    name = F.array(*(F.lit(k) for k in KINDS))
    written = lambda kind, x: F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string"))
    base = F.array_join(F.transform("spans", lambda x: written(F.element_at(name, x["k"] + 1), x)), ",")
    every = F.concat(
        F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("o"), x["e"].alias("e"), F.element_at(name, x["k"] + 1).alias("kind"))),
        F.transform("extra", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), x["e"].alias("e"), x["what"].alias("kind"))),
    )
    spans = F.array_join(F.transform(F.array_sort(every), lambda x: written(x["kind"], x)), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return rows.select(F.col("row").alias("doc_id"), *(number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("extra").cast("long").alias("n_terms"))


def _apart(spans: Column) -> Column:
    """Sorted (s, e, by) without overlaps: what an earlier span has taken is not replaced again."""

    def step(a: Column, x: Column) -> Column:
        now = F.struct(F.greatest(x["s"], a["at"]).alias("s"), F.greatest(x["e"], a["at"]).alias("e"), F.when(x["s"] >= a["at"], x["by"]).otherwise("").alias("by"))
        return F.struct(now["e"].alias("at"), F.concat(a["out"], F.array(now)).alias("out"))

    return _folded(spans, {"at": F.lit(0)}, "array<struct<s:int,e:int,by:string>>", step)["out"]


def _rewritten(text: Column, cuts: Column, i: Column) -> Column:
    """The text from where the run of cuts at ``i`` begins to where it ends, rewritten."""

    def run(x: Column) -> Column:
        begin, end = F.when(i > 0, F.element_at(cuts, F.greatest(i, F.lit(1)))["e"]).otherwise(0), F.element_at(x, -1)["e"]
        start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, c: Column, part: Column, first: Column) -> Column:
            gap = F.substring(part, a["at"] - first + 1, c["s"] - a["at"])
            return F.struct(c["e"].alias("at"), F.concat(a["out"], F.array(gap, c["by"])).alias("out"))

        return _let(F.struct(F.substring(text, begin + 1, end - begin).alias("part"), begin.alias("first")), lambda y: F.aggregate(x, start, lambda a, c: step(a, c, y["part"], y["first"]), lambda a: F.array_join(a["out"], "")))

    return _let(F.slice(cuts, i + 1, F.lit(RUN)), run)


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, listed: int = LISTED) -> DataFrame:
    """The documents with personal data replaced by ``[KIND]``, disclosing terms by
    ``[KIND TERM]`` or by nothing; all columns stay, ``n_chars`` follows."""
    names = docs.columns
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    rows = _judged(docs, F.struct(*(F.col(quoted(c)) for c in names)), support, generalise, remove, listed)
    name = F.array(*(F.lit(k.upper()) for k in KINDS))
    term = lambda x: F.when(x["what"] == "remove", "").otherwise(F.concat(F.lit("["), F.element_at(name, x["k"] + 1), F.lit(" TERM]")))
    spans = F.array_sort(F.concat(
        F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), F.element_at(name, x["k"] + 1), F.lit("]")).alias("by"))),
        F.transform("extra", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), term(x).alias("by"))),
    ))
    rows = rows.withColumn("cuts", _apart(spans))
    rewritten = F.concat(F.array_join(_let(F.col("cuts"), lambda c: F.transform(_begins(c), lambda i: _rewritten(F.col("t"), c, i))), ""), F.substring(F.col("t"), F.element_at("cuts", -1)["e"] + 1, F.length("t")))
    rows = rows.select("row", F.when(F.size("spans") > 0, rewritten).otherwise(F.col("text")).alias("text"), (F.size("spans") > 0).alias("changed"))
    out = {c: F.col(f"row.{quoted(c)}") for c in names}
    out["text"] = F.col("text")
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*(out[c].alias(c) for c in names))


__all__ = ["find", "sanitise", "disclosing"]
