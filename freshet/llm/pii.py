"""Personal data: patterns first, then bootstrapped contextual extraction, in DataFrame functions only.

Pattern matches are seed entities. The two words before an entity, and the word before it with the
shape of the entity, are lexical patterns; rounds of grouped counts over the graph of patterns and
instances score patterns by how many of their instances are known (precision and support, as in
Riloff's RlogF), and instances of trusted patterns become known in turn, until no round finds any.
Their occurrences in trusted contexts are the added spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C
from freshet.llm.spans import joined, let, matches

# The patterns of the contract. Look-behinds keep long runs linear without changing matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: What may be an identifier: a group of digits, with signs and single spaces inside it, or a word with a digit or an @.
UNIT = r"(?<!\S)(?:[+(]?[0-9](?:[().-]*+\x20?[().-]*+[0-9])++(?![^\s.,;:!?)])|[^\s0-9@]*+[0-9@]\S*+)"
#: Signs around a unit that are not part of it.
LEAD, TAIL = "\"'`[{<", "\"'`)]}>.,;:!?"
#: One word in so many is counted first; most patterns are out of reach after that.
FIRST_WORDS = 16


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    each = F.transform(F.regexp_extract_all(F.reverse(d), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 1, (x.cast("int") * 2).cast("int")).otherwise(x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: (a + F.when(x > 9, x - 9).otherwise(x)).cast("int")) % 10 == 0


def _octet(x: Column) -> Column:
    short = F.regexp_replace(x, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.substring(short, 1, 3).try_cast("int") <= 255)


def base_spans(text: Column) -> list[Column]:
    """Spans of each kind of KINDS, in that order."""
    digits = F.rlike(text, F.lit("[0-9]"))
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, digits), lambda x: F.forall(F.split(x["t"], r"\."), _octet))
    number = lambda x: F.length(_digits(x["t"])).between(16, 19)
    card = F.filter(F.filter(matches(text, CARD, digits), number), lambda x: _luhn(_digits(x["t"])))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["t"])).between(8, 15))
    return [email, ip, card, phone]


def _units(text: Column) -> Column:
    """array<struct<s, e, t, w>>: place and text of each unit, without signs around it, and words before it."""

    def placed(u: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            bare = F.ltrim(x["t"], F.lit(LEAD))
            inst = F.rtrim(bare, F.lit(TAIL))
            start = x["s"] + F.length(x["t"]) - F.length(bare)
            # what lies between this unit and the one before, and the units before it
            text = F.lower(F.concat_ws(" ", F.get(u, i - 2)["t"], F.get(u, i - 1)["t"], x["l"]))
            words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
            return F.struct(start.alias("s"), (start + F.length(inst)).alias("e"), inst.alias("t"), words.alias("w"))

        return F.filter(F.transform(u, one), lambda x: x["t"] != "")

    return let(matches(text, UNIT, F.rlike(text, F.lit("[0-9@]")), left=True), placed)


def _two(w2: Column, w1: Column) -> Column:
    """The pattern of two words; null where there are fewer."""
    return F.concat(F.lit("2 "), w2, F.lit(" "), w1)


def _spread(graph: DataFrame, total: DataFrame, known: DataFrame, support: int, trust: float) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, share) and known instances (inst, kind) once no round finds any more.

    graph: pattern, inst; total: pattern and how many instances it has in all; known: the seeds.
    """
    while True:
        hits = graph.join(known, "inst").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        score = hits.where(F.col("hits") >= support).join(total, "pattern").withColumn("share", F.col("hits") / F.col("all"))
        trusted = C.checkpoint(score.where(F.col("share") >= trust).select("pattern", "kind", "share"))
        fresh = graph.join(trusted, "pattern").join(known.select("inst"), "inst", "left_anti")
        belief = fresh.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))).alias("belief"))
        best = C.checkpoint(belief.where(F.col("belief") >= trust).groupBy("inst").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind")))
        if best.isEmpty():
            return trusted, known
        known = C.checkpoint(known.union(best))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, trust: float = 0.6) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    spans: kind:start:end in code points, by kind and start. Added spans carry the kind of the pattern
    that found them and never overlap a base span. A pattern is trusted for a kind when at least
    `support` different known instances of it and a share of at least `trust` of all its instances,
    plain words included, are of that kind; what can become known is a unit with a digit or an @. Null
    and empty texts have no spans, and long ones are read whole; equal texts count once in all scores
    and have equal spans; where two kinds tie for a unit the first by name is taken; rows without an id,
    of one id or equal in all are rows of their own. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # steps, as an expression inside a lambda would be computed for each element
    rows = source.select("id", *[s.alias(k) for s, k in zip(base_spans(text), KINDS, strict=True)], _units(text).alias("tokens"))

    def of_kind(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("r"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["t"].alias("t")))

    base = F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)])
    rows = rows.select("id", *[F.size(k).alias(f"n_{k}") for k in KINDS], base.alias("base"), "tokens")
    # numbers stand for rows in all that follows, so copies of one text meet in no task
    rows = C.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))

    token = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("x"))
    token = token.select("row", "x", F.try_element_at("x.w", F.lit(-1)).alias("w1"), F.try_element_at("x.w", F.lit(-2)).alias("w2"))
    shape = F.regexp_replace(F.regexp_replace(F.col("x.t"), r"\p{L}+", "a"), "[0-9]+", "9")
    one = F.concat(F.lit("1 "), F.col("w1"), F.lit(" "), shape)
    found = token.select("row", "x.s", "x.e", F.col("x.t").alias("inst"), F.explode(F.array_compact(F.array(_two(F.col("w2"), F.col("w1")), one))).alias("pattern"))
    graph = found.select("pattern", "inst").distinct()
    many = graph.groupBy("pattern").agg(F.count("*").alias("all")).where(F.col("all") >= support)
    many = C.checkpoint(many)
    graph = C.checkpoint(graph.join(many.select("pattern"), "pattern"))
    known = rows.where(F.size("base") > 0).select(F.explode("base").alias("b")).groupBy(F.col("b.t").alias("inst")).agg(F.min("b.kind").alias("kind"))
    known = C.checkpoint(known)
    # Plain words count against a pattern too, so trust without them, and with all kinds as one, is the most
    # that a pattern can earn: only patterns that are trusted so need their words counted, and of these only
    # those that have an instance outside the base spans, as the others can find nothing. A pattern with a
    # shape has a digit in it and meets no plain word.
    starts = rows.where(F.size("base") > 0).select("row", F.explode("base").alias("b")).select("row", F.col("b.s").alias("s")).distinct()
    open_ = found.join(starts, ["row", "s"], "left_anti").select("pattern").distinct()
    hopeful, _ = _spread(graph, many, known.select("inst", F.lit("any").alias("kind")), support, trust)
    two = C.Written(hopeful.where(F.col("pattern").startswith("2 ")).groupBy("pattern").agg(F.max("share").alias("share")).join(open_, "pattern", "left_semi"))

    def counted(patterns: DataFrame, part: Column) -> DataFrame:
        """How many different plain words follow each pattern, of those in `part`."""
        w = F.split(F.btrim(F.lower(text), F.lit(" \t\n\r\f\x0b")), r"\s+")
        plain = source.select(w.alias("w")).where(F.size("w") > 2).withColumn("n", F.size("w") - 2)
        plain = plain.select(F.explode(F.arrays_zip(F.slice("w", 1, F.col("n")).alias("w2"), F.slice("w", 2, F.col("n")).alias("w1"), F.slice("w", 3, F.col("n")).alias("t"))).alias("x"))
        plain = plain.select(_two(F.col("x.w2"), F.col("x.w1")).alias("pattern"), F.col("x.t").alias("inst")).where(part & ~F.rlike("inst", F.lit("[0-9@]")))
        return plain.join(patterns.select("pattern"), "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("words"))

    total = many
    if not two.table.isEmpty():
        # A part of the words is enough to rule most patterns out, as their words only grow; the others are counted whole.
        first = counted(two.table, F.pmod(F.xxhash64("inst"), F.lit(FIRST_WORDS)) == 0)
        reach = F.col("share") * F.col("all") - trust * (F.col("all") + F.coalesce("words", F.lit(0))) < -1e-6
        first = C.Written(two.table.join(many, "pattern").join(first, "pattern", "left").select("pattern", "words", reach.alias("out")))
        words = counted(first.table.where("not out"), F.lit(True)).union(first.table.where("out").select("pattern", "words"))
        total = C.checkpoint(many.join(words, "pattern", "left").select("pattern", (F.col("all") + F.coalesce("words", F.lit(0))).alias("all")))
        first.drop()
    two.drop()
    trusted, known = _spread(graph, total, known, support, trust)
    place = found.join(trusted.select("pattern", "kind"), "pattern").join(known, ["inst", "kind"])
    place = place.groupBy("row", "s", "e").agg(F.min("kind").alias("kind"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    place = place.join(starts, ["row", "s"], "left_anti")  # most of them are the seeds themselves
    added = place.groupBy("row").agg(F.collect_list(F.struct("s", rank.alias("r"), "e", "kind")).alias("added"))
    out = rows.drop("tokens").join(added, "row", "left")
    out = out.withColumn("base", F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["r"].alias("r"), b["e"].alias("e"), b["kind"].alias("kind"))))
    apart = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
    out = out.withColumn("added", F.coalesce(F.filter("added", apart), F.array().cast("array<struct<s:int,r:int,e:int,kind:string>>")))
    order = lambda a, b: F.when(a["r"] != b["r"], a["r"] - b["r"]).otherwise(a["s"] - b["s"])
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.array_sort("base", order)), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"), order)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
