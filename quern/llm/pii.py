"""Personal data, by patterns and by what the corpus gives away. DataFrame functions only.

Base spans (email, ip, card, phone) come from patterns. A text is split by each pattern; the lengths
of the pieces between matches and of the matches, added up, are the matches' places in code points.

The information-theoretic layer treats each distinct matched string as a protected entity *e* and
asks of the words anywhere in the texts that mention it how strongly they reveal it. With
``p(x)`` the share of rows that hold *x*::

    IC(e) = -log2 p(e)        PMI(t; e) = log2 (p(t, e) / (p(t) p(e)))

``PMI / IC`` is the share of what is to be known about *e* that *t* discloses: 1 if *t* never occurs
without it. Terms that reach ``DISCLOSURE`` with support in at least ``SUPPORT`` distinct texts are
marked wherever they occur, and ``sanitise`` generalises entities to their kind and removes such terms.
All words are weighed. ``term`` spans are those of words that reach it by the texts in which they stand in a form of
``LEAST_LETTERS``; those that reach it by all of their texts only are ``weak`` spans, in a column of their own.

Shuffles: (term, count) after partial sums for the counts over all texts, the words of texts that
hold an entity, and (entity, term) pairs. As ``p(t, e)`` is at most ``p(e)``, a term in more than
``N ** (1 - DISCLOSURE) * n(e) ** DISCLOSURE`` of ``N`` rows can't reach ``DISCLOSURE``; such pairs are not made. Texts
move only to meet the terms found in them; texts and their base spans are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import sieve, sifted, written

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns with possessive runs and anchored starts. They match the same strings as the
# plain forms, but no run of characters is tried again from each of its places and no repetition recurses.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Share of an entity's information from which a term is disclosing, and the texts that must show it.
DISCLOSURE = 0.9
SUPPORT = 3
#: Disclosing terms that may be broadcast to the texts; more of them meet the words in a shuffle.
BROADCAST_TERMS = 200_000
#: The shortest words that make ``term`` spans. Those with a capital, a digit or an East Asian letter make them from two characters.
LEAST_LETTERS = 4
#: The kind of the other disclosing words, listed after ``KINDS``.
WEAK = "weak"
#: Words in more than this share of the rows are broadcast to be left out before the others meet their counts.
COMMON = 0.005


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


HOLDS = {"email": lambda m: F.lit(True), "ip": _octets, "card": _luhn, "phone": _phone}


#: Matches that one fold adds up. Folds copy what they have, so long arrays are folded in blocks.
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _placed(text: Column, found: Column, between: Column) -> Column:
    """``array<struct<start, end, m>>`` of matches, from the pieces of text between them."""
    kind = "array<struct<start:int,end:int,m:string>>"

    def fold(block, at):
        def step(acc, x):
            begin = acc["at"] + F.length(x["b"])
            end = begin + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    def blocks(pieces):
        cut = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(_BLOCK)), lambda i: F.slice(pieces, i + 1, _BLOCK))
        return _let(cut, lambda every: F.flatten(F.zip_with(every, begins(every), fold)))

    def begins(every):
        total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["b"]) + F.length(x["m"]))
        return F.aggregate(F.slice(F.transform(every, total), 1, F.size(every) - 1), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    zipped = lambda m: F.zip_with(F.slice(between, 1, F.size(m)), m, lambda b, x: F.struct(b.alias("b"), x.alias("m")))
    return _let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(_let(zipped(m), blocks)))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, m>>`` of a pattern's matches in a text."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(text.rlike(pattern), _placed(text, found, F.split(text, pattern, -1))).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))


def _kind(text: Column, kind: str) -> Column:
    holds = HOLDS[kind]
    kept = F.filter(matches(text, PATTERNS[kind]), lambda x: holds(x["m"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, k, end, kind, m>>`` of the four kinds, by start and then kind."""
    return F.array_sort(F.concat(*(_kind(text, k) for k in KINDS[:-1])))


_WORD = r"([\p{L}\p{N}]++)"
_WEIGHED = rf"^\p{{L}}{{{LEAST_LETTERS},}}$|^\p{{Lu}}|\p{{N}}|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}]"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(1))


def _weighed(text: Column, spans: Column) -> Column:
    """The distinct words of a text without its spans, as structs of the word in lower case and whether its form makes terms."""
    ends = F.aggregate(spans, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s["end"]))))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    between = F.zip_with(starts, ends, lambda start, end: F.substring(text, end + 1, F.greatest(start - end, F.lit(0))))
    words = F.regexp_extract_all(F.array_join(between, " "), F.lit(_WORD), F.lit(1))
    return F.array_distinct(F.transform(words, lambda w: F.struct(F.lower(w).alias("term"), ((F.length(w) > 1) & w.rlike(_WEIGHED)).alias("strong"))))


def disclosing_terms(rows: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``term`` of every word that gives an entity away, and whether it is ``strong``: whether the texts where its form makes
    terms are enough for that. ``rows`` has ``t`` and its base ``spans``.

    Shares are shares of rows, and a word shares a row with an entity wherever in the text the two stand.
    Support counts distinct texts, so copying a text makes nothing in it disclosing. An entity in fewer
    texts than that, or a word in fewer rows, has no pair that could have it.
    """
    n_all = rows.count()
    held = rows.where(F.size("spans") > 0).withColumn("text", F.xxhash64("t"))
    mentions = held.select("text", F.explode(F.array_distinct(F.transform("spans", lambda s: s["m"]))).alias("entity")).groupBy("entity", "text").agg(F.count("*").alias("n"))
    known = mentions.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("n").alias("n_entity")).where((F.col("texts") >= support) & (F.col("n_entity") < n_all))
    mentions = written(mentions.join(known.drop("texts"), "entity"))
    most = mentions.agg(F.max("n_entity")).first()[0]
    if most is None:
        return rows.sparkSession.createDataFrame([], "term string, strong boolean")
    bound = lambda n: F.lit(float(n_all)) ** (1 - disclosure) * n**disclosure * (1 + 1e-9)
    highest = n_all ** (1 - disclosure) * most**disclosure * (1 + 1e-9)
    counts = written(rows.select(F.explode(F.array_distinct(_words(F.col("t")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= support))
    rare, common = counts.where(F.col("n_term") <= highest), counts.where(F.col("n_term") > max(highest, COMMON * n_all)).select("term")
    # one row of each text: its words are the same in all of them
    texts = held.join(mentions.select("text").distinct(), "text", "left_semi").select("text", F.inline(_weighed(F.col("t"), F.col("spans"))))
    texts = texts.join(F.broadcast(common), "term", "left_anti").groupBy("text", "term").agg(F.max("strong").alias("strong")).join(F.broadcast(rare) if rare.count() <= BROADCAST_TERMS else rare, "term")
    pairs = texts.join(mentions, "text").where(F.col("n_term") <= bound(F.col("n_entity")))
    sums = [F.count("*").alias("support"), F.sum("n").alias("n_both"), F.count_if("strong").alias("support_strong"), F.sum(F.when(F.col("strong"), F.col("n")).otherwise(0)).alias("n_strong")]
    scored = pairs.groupBy("entity", "term", "n_term", "n_entity").agg(*sums).where(F.col("support") >= support)
    share = lambda n: F.log2(F.col(n) * n_all / (F.col("n_term") * F.col("n_entity"))) / F.log2(n_all / F.col("n_entity"))
    strong = F.when(F.col("support_strong") >= support, share("n_strong") >= disclosure).otherwise(False)
    return scored.where(share("n_both") >= disclosure).groupBy("term").agg(F.max(strong).alias("strong"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per input row: ``id, t, base, spans, weak``, arrays of ``struct<start, k, end, kind, m>``.

    Null texts are empty; empty texts, and an empty table, have no spans. Ids may be null or
    repeated: terms are looked up by a hash of the text. Texts and words are read whole. Ties
    in the measure are all kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = written(rows.withColumn("spans", base_spans(F.col("t"))))  # patterns are looked for once, and read five times
    terms = written(disclosing_terms(rows, disclosure, support))
    named = lambda strong: F.nullif(F.concat_ws("|", F.array_sort(F.collect_set(F.when(F.col("strong") == strong, F.col("term"))))), F.lit(""))
    hits = (
        rows.select(F.xxhash64("t").alias("text"), F.explode(F.array_distinct(_words(F.col("t")))).alias("term"))
        .join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term")
        .distinct()
        .groupBy("text")
        .agg(named(True).alias("terms"), named(False).alias("weak"))
    )
    hits = written(hits)
    # texts without such a term stay where they are
    marked = sifted(rows.withColumn("text", F.xxhash64("t")), F.col("text"), sieve(hits, F.col("text")), "may")
    met = marked.where("may").join(hits, "text", "left").select("id", "t", "spans", "terms", "weak")
    none = F.lit(None).cast("string")
    found = marked.where("not may").select("id", "t", "spans", none.alias("terms"), none.alias("weak")).unionByName(met)
    spans = F.array_sort(F.concat("spans", _term_spans(F.col("t"), F.col("terms"), KINDS[-1], len(KINDS) - 1)))
    return found.select("id", "t", F.col("spans").alias("base"), spans.alias("spans"), _term_spans(F.col("t"), F.col("weak"), WEAK, len(KINDS)).alias("weak"))


def _term_spans(text: Column, words: Column, kind: str, k: int) -> Column:
    """Where ``words``, joined by bars, stand in a text; none if they are null."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), words, F.lit(r")(?![\p{L}\p{N}])"))
    found = _placed(text, F.regexp_extract_all(text, pattern, F.lit(1)), F.call_function("split", text, pattern, F.lit(-1)))
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")))
    return F.when(words.isNull(), F.array().cast("array<struct<start:int,k:int,end:int,kind:string,m:string>>")).otherwise(spans)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(found: DataFrame) -> DataFrame:
    """``id, t`` of ``find``'s rows with each entity replaced by its kind in brackets and each
    disclosing word removed, weak ones too. Where spans overlap, the one that starts first is replaced and what
    the others have beyond it is removed with them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        label = F.when(fresh & ~s["kind"].isin(KINDS[-1], WEAK), F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        keep = F.when(fresh, F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(keep, label)).alias("out"))

    text = F.aggregate(F.array_sort(F.concat("spans", "weak")), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("t"), acc["at"] + 1, F.length("t"))))
    return found.select("id", text.alias("t"))
