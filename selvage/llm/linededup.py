"""Recurring lines by a log-template tree, in SQL expressions only.

Every line is parsed into tokens; fields with digits or an at sign are masked.
A tree of fixed depth (token count, then the leading tokens) leads to a leaf.
Where a leaf holds several masked lines, the positions at which one token has
the majority are constant and the rest are variable; lines that agree with
enough constant positions share that template.  Other lines are grouped by their
tokens that are the most frequent in the leaf at their positions, as many as the
share AGREEMENT of the positions behind the leading tokens: a template of which
all lines share these is one group, whatever else fills the leaf.  Lines that
share them with no other are their own.

A template recurs if it stands in enough texts that are unrelated to each other:
texts of which a share of the word pairs stands in one only, or that both hold
lines of their own (of no template of several texts) whose word pairs the other
lacks, as short texts above one long footer do.  Copies of a whole document,
however many, are related and count once, edited ones too, as an edited line
resembles the other text; they are left to document-level deduplication.  What surrounds a line does not matter, so lines
of blocks (headers, footers, passages) recur like single ones.  Lines of
recurring templates are dropped from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, any_of, counted, discard, if_small, materialize, side

DEPTH = 3
AGREEMENT = 0.6
#: Word pairs of a text that are kept to compare it, those with the smallest hash.
SKETCH = 96
#: Texts whose numbers of different word pairs differ more are unrelated.
LONGER = 4
#: Own lines with fewer of a text's word pairs don't set it apart: a copy with a line added or replaced is a copy.
OWN_PART = 0.05
#: Share of the own lines' word pairs that the other text lacks; lines with edited words keep most of theirs.
OWN_APART = 0.7


def _masked(line: Column) -> Column:
    # digits one by one are a table to Java, a range beside a sign is not
    return F.when(line.rlike("[0123456789@]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "<*>")).otherwise(line)


def _spaced(text: Column, signs: str) -> Column:
    """``signs`` become spaces, without regular expressions."""
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return text


def _tokens(text: str | Column, signs: str = "\t\n\x0b\f\r") -> Column:
    """Words between white space."""
    return F.array_remove(F.split(_spaced(F.col(text) if isinstance(text, str) else text, signs), " "), "")


def _single_spaced(line: Column) -> Column:
    """A line's words with one space between them; most lines are so already."""
    odd = any_of([F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\f", "\r")]) | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, dh, pos, th, leaf``, a row for each line with words; ``dh`` fingerprints the whole text, ``th`` the masked line."""
    cut = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("dh"), F.split("text", "\n").alias("lines"))
    rows = cut.select("doc_id", "dh", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"\S")).withColumn("masked", _masked(F.col("line"))).withColumn("masked", _single_spaced(F.col("masked")))
    size = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "dh", "pos", F.xxhash64("masked").alias("th"), F.xxhash64(size, F.substring_index("masked", " ", DEPTH)).alias("leaf"))


def _sketches(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``dh, pairs, n``: the SKETCH smallest hashes of the word pairs of each different text of ``held(dh)``, and how many there are."""
    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("dh")).join(held, "dh", "left_semi")
    words = rows.select("dh", _tokens("text").alias("w")).where(F.size("w") > 0)
    hashed = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.hash(a, b))  # the last word alone
    rows = words.select("dh", F.sort_array(F.array_distinct(hashed)).alias("pairs"))
    return rows.select("dh", F.slice("pairs", 1, SKETCH).alias("pairs"), F.size("pairs").alias("n")).dropDuplicates(["dh"])


def _unrelated(apart: float) -> Column:
    """Whether texts with sketches ``pairs, n`` and ``o_pairs, o_n`` differ: the share ``apart`` of either's word pairs is not in the other, as estimated up to the hash that both sketches reach."""
    def reach(pairs: str, n: str) -> Column:
        return F.when(F.col(n) > SKETCH, F.element_at(pairs, -1)).otherwise(F.lit(2**31 - 1))

    def alone(x: Column, other: str) -> Column:
        return F.size(F.array_except(x, F.col(other))) / F.size(x)

    top = F.least(reach("pairs", "n"), reach("o_pairs", "o_n"))
    own, others = F.filter("pairs", lambda v: v <= top), F.filter("o_pairs", lambda v: v <= top)
    return (F.greatest("n", "o_n") > LONGER * F.least("n", "o_n")) | (F.greatest(alone(own, "o_pairs"), alone(others, "pairs")) >= apart)


def _masked_lines(docs: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """``leaf, th, masked`` for each different masked line of ``live(leaf, th, dh, pos)``, cut once more from one of its texts: lines are never stored or shuffled whole before it is known which are needed."""
    reps = materialize(live.groupBy("leaf", "th").agg(F.min(F.struct("dh", "pos")).alias("at")).select("leaf", "th", "at.*"), "reps")
    wanted = reps.groupBy("dh").agg(F.collect_list(F.struct("leaf", "th", "pos")).alias("at"))
    wanted = F.broadcast(wanted) if counted(reps, most) <= SMALL_ROWS else wanted
    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("dh")).join(wanted, "dh").select(F.split("text", "\n").alias("lines"), "at")
    rows = rows.select(F.explode(F.transform("at", lambda x: F.struct(x["leaf"], x["th"], F.get("lines", x["pos"]).alias("line")))).alias("x")).select("x.*")
    # rows that repeat a text have the same lines
    out = rows.select("leaf", "th", _single_spaced(_masked(F.col("line"))).alias("masked")).groupBy("leaf", "th").agg(F.first("masked").alias("masked"))
    out = materialize(out, "masked")
    discard(reps)
    return out


def _pair_templates(own: DataFrame, leaves: DataFrame, most: int) -> DataFrame:
    """``th, template`` for ``leaves(leaf)`` of two masked lines: they share a template if they agree in enough positions, which needs no vote."""
    both = own.join(if_small(leaves, most), "leaf", "left_semi").groupBy("leaf").agg(F.min(F.struct("th", "masked")).alias("a"), F.max(F.struct("th", "masked")).alias("b"))
    both = both.select("leaf", F.array("a.th", "b.th").alias("ths"), F.split("a.masked", " ").alias("a"), F.split("b.masked", " ").alias("b"))
    agree = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))  # the leading tokens among them
    both = both.select("leaf", "ths", F.size("a").alias("n"), agree.alias("agree"))
    least = F.ceil(AGREEMENT * (F.col("n") - DEPTH))
    alike = (F.col("agree") >= AGREEMENT * F.col("n")) | ((least > 0) & (F.col("agree") - DEPTH >= least))
    return both.where(alike).select(F.explode("ths").alias("th"), F.xxhash64("leaf").alias("template"))


def _templates(docs: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """``th, template`` for masked lines that join a generalised template of their leaf, for ``live(leaf, th, dh, pos)``, at most ``most`` rows of leaves of several masked lines."""
    masked = _masked_lines(docs, live, most)
    leaves = materialize(masked.groupBy("leaf").agg(F.count("*").alias("all")), "leaves")
    most = counted(leaves, most)
    pairs = _pair_templates(masked, leaves.where("all = 2").select("leaf"), most)
    sizes = leaves.where("all > 2")
    most = counted(sizes, most)
    own = masked.join(if_small(sizes.select("leaf"), most), "leaf", "left_semi").select("leaf", "th", F.split("masked", " ").alias("tokens"))
    # all lines of a leaf have its leading tokens, so only the others vote; the first stands for the line
    cells = own.select("leaf", "th", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")).where((F.col("at") == 0) | (F.col("at") >= DEPTH))
    cells = materialize(cells.select("leaf", "th", "n", "at", F.xxhash64("token").alias("t")), "cells")
    votes = materialize(cells.where(F.col("at") >= DEPTH).groupBy("leaf", "n", "at", "t").agg(F.count("*").alias("c")).where("c > 1"), "votes")
    shared = materialize(votes.join(if_small(sizes, most), "leaf").withColumn("fixed", 2 * F.col("c") > F.col("all")).drop("all"), "shared")
    lead = F.least(F.col("n"), F.lit(DEPTH))
    fixed = shared.where("fixed").groupBy("leaf").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("at", "t")).alias("mark"))
    lengths = cells.where("at = 0").select("leaf", "n").distinct()
    wide = lengths.join(fixed, "leaf", "left").select("leaf", "n", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("mark", F.lit(0)).alias("mark"))
    wide = side(wide.where(F.col("k") + lead >= AGREEMENT * F.col("n")), "wide", most)  # all lines of a leaf have one length
    behind = F.when(F.col("at") >= DEPTH, F.struct((-F.col("c")).alias("c"), "at", "t"))
    voted = cells.join(shared, ["leaf", "n", "at", "t"], "left").where("at = 0 OR c IS NOT NULL")
    lines = voted.groupBy("leaf", "n", "th").agg((F.count_if("fixed") + lead).alias("same"), F.sort_array(F.collect_list(behind)).alias("top"))
    least = F.ceil(AGREEMENT * (F.col("n") - DEPTH)).cast("int")
    group = F.transform(F.slice("top", 1, least), lambda x: F.struct(x["at"], x["t"]))
    template = F.when(F.col("k").isNotNull() & (F.col("same") >= AGREEMENT * F.col("n")), F.xxhash64("leaf", "mark")).when(
        (least > 0) & (F.size("top") >= least), F.xxhash64("leaf", F.sort_array(group)))
    found = lines.join(wide, ["leaf", "n"], "left").select("th", template.alias("template"))
    out = materialize(found.where("template IS NOT NULL").union(pairs), "templates")
    for x in (masked, leaves, cells, votes, shared, wide):
        discard(x)
    return out


def _own(docs: DataFrame, places: DataFrame, ids: DataFrame, most: int, of_texts: int) -> DataFrame:
    """``dh, own, own_n`` of texts ``ids(dh)`` that have lines of no template of several texts: the sketch of the word pairs of these lines, and how many there are."""
    shared = materialize(places.join(if_small(ids, of_texts), "dh", "left_semi").groupBy("dh").agg(F.collect_set("pos").alias("shared")), "shared")
    few = most <= SMALL_ROWS or (shared.agg(F.sum(F.size("shared"))).first()[0] or 0) <= SMALL_ROWS
    # only texts in doubt are shuffled, if any
    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("dh"))
    rows = rows.join(F.broadcast(shared), "dh") if few else rows.join(if_small(ids, of_texts), "dh", "left_semi").join(shared, "dh")
    lines = rows.select("dh", F.split("text", "\n").alias("lines"), "shared")
    alone = lines.select("dh", F.filter(F.expr("transform(array_except(sequence(0, size(lines) - 1), shared), i -> lines[i])"), lambda x: x.rlike(r"\S")).alias("own"))
    # a row keeps only its sketch, so copies of a text are put together without their texts; line ends are words here, so that no pair spans them
    words = alone.where(F.size("own") > 0).select("dh", _tokens(F.array_join("own", " \n "), "\t\x0b\f\r").alias("w"))
    hashed = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.when(a != "\n", F.hash(a, F.when(b != "\n", b))))
    pairs = words.select("dh", F.sort_array(F.array_distinct(F.array_compact(hashed))).alias("own"))
    out = materialize(pairs.select("dh", F.slice("own", 1, SKETCH).alias("own"), F.size("own").alias("own_n")).dropDuplicates(["dh"]), "own")
    discard(shared)
    return out


def _own_apart(own: str, own_n: str, n: str, pairs: str, other_n: str) -> Column:
    """Whether the own lines of a text are a part of it (OWN_PART) and most of their word pairs (OWN_APART) are not in the other text."""
    reach = F.when(F.col(other_n) > SKETCH, F.element_at(pairs, -1)).otherwise(F.lit(2**31 - 1))
    seen = F.filter(own, lambda v: v <= reach)
    return (F.col(own_n) >= OWN_PART * F.col(n)) & (F.size(seen) > 0) & (F.size(F.array_except(seen, F.col(pairs))) >= OWN_APART * F.size(seen))


def _apart_pairs(docs: DataFrame, places: DataFrame, sketches: DataFrame, pairs: DataFrame, apart: float, most: int, of_texts: int) -> DataFrame:
    """``dh, o_dh`` of ``pairs(dh, n, o_dh, o_n)`` that are unrelated, as whole texts or by their own lines.

    There are at most ``most`` places and ``of_texts`` different texts.
    """
    # lengths alone decide many pairs, whose sketches aren't joined
    longer = F.greatest("n", "o_n") > LONGER * F.least("n", "o_n")
    pairs = materialize(pairs.withColumn("longer", longer), "pairs")
    alike = pairs.where("NOT longer").select("dh", "o_dh")
    compared = materialize(alike.select(F.explode(F.array("dh", "o_dh")).alias("dh")).distinct(), "compared")
    sketches = sketches.join(if_small(compared, of_texts), "dh", "left_semi")
    alike = alike.join(sketches, "dh").join(sketches.toDF("o_dh", "o_pairs", "o_n"), "o_dh").select("dh", "o_dh", _unrelated(apart).alias("far"))
    judged = materialize(alike.union(pairs.where("longer").select("dh", "o_dh", "longer")), "judged")
    doubt = judged.where("NOT far").select("dh", "o_dh")
    ids = materialize(doubt.select(F.explode(F.array("dh", "o_dh")).alias("dh")).distinct(), "doubt")
    of_texts = counted(ids, of_texts)
    own = _own(docs, places, ids, most, of_texts)
    full = materialize(own.join(sketches.join(if_small(ids, of_texts), "dh", "left_semi"), "dh"), "full")
    both = doubt.join(full, "dh").join(full.toDF("o_dh", "o_own", "o_own_n", "o_pairs", "o_n"), "o_dh")
    both = both.where(_own_apart("own", "own_n", "n", "o_pairs", "o_n") & _own_apart("o_own", "o_own_n", "o_n", "pairs", "n"))
    out = materialize(judged.where("far").select("dh", "o_dh").union(both.select("dh", "o_dh")), "apart")
    for x in (pairs, compared, judged, ids, own, full):
        discard(x)
    return out


def _spread(docs: DataFrame, places: DataFrame, texts: DataFrame, sketches: DataFrame, least_texts: int, apart: float, most: int) -> DataFrame:
    """``g`` of ``texts(g, dh)`` that have ``least_texts`` texts unrelated to each other; ``places(g, dh, pos)``, at most ``most``, are the lines of all templates of several texts.

    The text of each template with the most word pairs is taken and all that are
    related to it leave; another of the rest follows.  So a text of nothing but
    recurring lines, which is related to all that hold little else, isn't taken
    before them.  Pairs of texts are compared once for all their lines.
    """
    of_texts = counted(sketches, most)
    left, held = texts.join(if_small(sketches.select("dh", "n"), of_texts), "dh").select("g", "dh", "n"), []
    for _ in range(least_texts - 1):
        taken = left.groupBy("g").agg(F.max(F.struct("n", "dh")).alias("t"))
        taken = side(taken.select("g", F.col("t.dh").alias("o_dh"), F.col("t.n").alias("o_n")), "taken", most)
        beside = materialize(left.join(taken, "g").where("dh <> o_dh"), "beside")
        apart_pairs = _apart_pairs(docs, places, sketches, beside.select("dh", "n", "o_dh", "o_n").distinct(), apart, most, of_texts)
        left = materialize(beside.join(apart_pairs, ["dh", "o_dh"]).select("g", "dh", "n"), "left")
        held += [taken, beside, apart_pairs, left]
    out = materialize(left.select("g").distinct(), "recurring")
    for x in held:
        discard(x)
    return out


def recurring(docs: DataFrame, least_texts: int = 3, apart: float = 0.3) -> DataFrame:
    """``doc_id, dh, dropped``: positions of the lines of recurring templates (:func:`_recurring`)."""
    return _recurring(docs, least_texts, apart)[0]


def _recurring(docs: DataFrame, least_texts: int, apart: float) -> tuple[DataFrame, int]:
    """``doc_id, dh, dropped``, positions of the lines of recurring templates, and a bound on the positions.

    A template recurs with ``least_texts`` texts that are unrelated to each
    other: at least the share ``apart`` of the word pairs of one is not in the
    other, or both have lines of their own that the other doesn't resemble,
    whatever their number of copies.
    """
    narrow = materialize(_lines(docs), "lines")
    # a template lies within a leaf, so leaves of one text hold none of several texts
    leaves = narrow.groupBy("leaf").agg(*(f(x).alias(f"{k}_{x}") for x in ("dh", "th") for k, f in (("lo", F.min), ("hi", F.max)))).where("lo_dh <> hi_dh")
    leaves = materialize(leaves.select("leaf", F.expr("lo_th <> hi_th").alias("varied")), "several-leaves")
    live = materialize(narrow.join(if_small(leaves), "leaf"), "live")
    for x in (narrow, leaves):
        discard(x)
    # what follows is made of these lines; where they are few, no table of theirs is counted
    most = live.count()
    templates = _templates(docs, live.where("varied"), most)
    named = live.join(if_small(templates, most), "th", "left").select("doc_id", "dh", "pos", F.coalesce("template", "th").alias("g"))
    several = named.groupBy("g").agg(F.min("dh").alias("lo"), F.max("dh").alias("hi")).where("lo <> hi").select("g")
    several = side(several, "several", most)
    places = materialize(named.join(several, "g", "left_semi").select("g", "dh", "pos").distinct(), "places")
    texts = materialize(places.select("g", "dh").distinct(), "texts")
    # templates of fewer texts only tell which lines aren't a text's own: their texts need no sketch
    enough = side(texts.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= least_texts).select("g"), "enough", most)
    of_enough = materialize(texts.join(enough, "g", "left_semi"), "of-enough")
    held = side(of_enough.select("dh").distinct(), "held", most)
    sketches = materialize(_sketches(docs, held), "sketches")
    found = _spread(docs, places, of_enough, sketches, least_texts, apart, most)
    out = materialize(named.join(if_small(found, most), "g", "left_semi").groupBy("doc_id", "dh").agg(F.collect_set("pos").alias("dropped")), "dropped")
    for x in (live, templates, several, places, texts, enough, of_enough, held, sketches, found):
        discard(x)
    return out, most


def drop_recurring_lines(docs: DataFrame, least_texts: int = 3, apart: float = 0.3) -> DataFrame:
    """The same rows and columns with recurring lines cut from ``text``, and ``n_lines``, ``n_dropped``.

    Null texts stay null with no lines; empty texts and blank lines are never
    recurring; a document of nothing but recurring lines becomes empty.  Repeated
    rows are treated alike and count once.  Other columns are kept, whatever their names; an empty
    table gives an empty result.
    """
    cut, most = _recurring(docs.select("doc_id", "text"), least_texts, apart)
    # a row's own columns stay in one struct, so that none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("dh"))
    # texts are shuffled, once, only if the positions are too many to send to every executor
    cut = F.broadcast(cut) if most <= SMALL_ROWS or (cut.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= SMALL_ROWS else cut
    rows = rows.join(cut.toDF("cut_id", "cut_dh", "dropped"), F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("dh") == F.col("cut_dh")), "left")
    rows = rows.withColumn("lines", F.when(F.col("dropped").isNotNull(), F.split("row.text", "\n")))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.expr(
        "array_join(transform(array_except(sequence(0, size(lines) - 1), dropped), i -> lines[i]), '\n')"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(
        *(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own),
        F.when(F.col("row.text").isNull(), 0).otherwise(1 + F.octet_length("row.text") - F.octet_length(F.replace("row.text", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"))
