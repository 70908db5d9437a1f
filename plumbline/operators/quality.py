"""Checks of a labelled test set. Each returns the offending rows; ``row_no`` is the key. Empty tables give no rows.

``none_is_empty`` treats the edge case 'none' as none; by default any value counts as one, as in the checks' definition.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import collapsed, ends_well, flags, stripped, word_set
from plumbline.operators.common import count_where
from plumbline.session import cut_lineage

REQUIRED = ("id", "source", "annex_iii_area", "annex_iii_point", "system_description", "label", "label_source")
LABELS = ("high-risk", "not-high-risk")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _edge(none_is_empty: bool) -> Column:
    e = _text("edge_case_type")
    return (e != "") & (e != "none") if none_is_empty else e != ""


def missing_fields(rows: DataFrame) -> DataFrame:
    missing = flags(**{c: _text(c) == "" for c in REQUIRED})
    return rows.select("row_no", "id", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """One row per repeated description: how many rows, the first, the last, the start of the text. ``exact_duplicate_rows`` names all of them."""
    text = stripped(_text("system_description"))
    return rows.select("row_no", text.alias("t")).where("t <> ''").groupBy("t").agg(
        F.count("*").alias("n"),
        F.min("row_no").alias("first_row"),
        F.max("row_no").alias("last_row"),
    ).where("n > 1").select("n", "first_row", "last_row", F.substring("t", 1, 80).alias("preview"))


def exact_duplicate_rows(rows: DataFrame) -> DataFrame:
    """A row per row whose description is repeated: (``row_no``, ``id``, ``first_row``, ``n``). Rows meet by a hash of the text; no group is gathered in one place."""
    text = stripped(_text("system_description"))
    hashed = rows.where(text != "").select("row_no", "id", F.sha2(text, 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row")).where("n > 1")
    return hashed.join(groups.hint("merge"), "h").select("row_no", "id", "first_row", "n")


def similar_classes(rows: DataFrame) -> DataFrame:
    """(``row_no``, ``rep``) for each row with words: ``rep`` is the least row of the same word set, by which ``similar_pairs`` names it."""
    words = F.sort_array(word_set(F.col("system_description")))
    hashed = rows.select("row_no", words.alias("ws")).where(F.size("ws") > 0).select(
        "row_no",
        F.sha2(F.array_join("ws", " "), 256).alias("h"),
    )
    return hashed.join(hashed.groupBy("h").agg(F.min("row_no").alias("rep")).hint("merge"), "h").select("row_no", "rep")


#: Longs of parities that a set carries.
_LONGS = 2


def _parities(words: Column, i: int) -> Column:
    """64 bits: each tells whether an odd number of the words fall on it by hash."""
    bit = lambda w: F.pmod(F.xxhash64(w, F.lit(1)), F.lit(64 * _LONGS))
    own = lambda w: F.when(F.shiftright(bit(w), 6) == i, F.expr("1L")).otherwise(F.lit(0).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", own(w), (bit(w) % 64).cast("int"))))


def _meeting_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(``rep``, ``n``, parities, ``key``, ``own``): keys of which two sets at the threshold share one with ``own`` true on a side at least.

    Sizes fall into intervals of the ratio that similar sets may have, so a set meets its partners under the number of its own interval or of the next. Two
    sets no larger than the upper end of an interval that are similar differ in at most k words. Their words fall into k + 3 parts by hash, so three parts at least have no difference. One of these
    has words, and its exclusive-or of hashes is a key of both; or three have none, and these three are.
    """
    ratio = 1.0001 / threshold
    interval = F.floor(F.log("n") / math.log(ratio) + 1e-9).cast("int")
    most = F.floor(F.pow(F.lit(ratio), F.col("tag") + 1)) + 1
    n_parts = (F.floor(2 * (1 - threshold) / (1 + threshold) * most + 1e-9) + 3).cast("int")
    parities = [f"p{i}" for i in range(_LONGS)]
    sized = sets.select("rep", "ws", F.size("ws").alias("n"), *parities).withColumn("at", interval)
    tagged = sized.withColumn("tag", F.explode(F.array("at", F.col("at") + 1))).withColumn("m", n_parts).withColumn("own", F.col("tag") == F.col("at"))
    words = tagged.select("rep", "n", *parities, "tag", "own", "m", F.explode(F.transform("ws", lambda w: F.xxhash64(w))).alias("h"))
    parts = words.groupBy("rep", "n", *parities, "tag", "own", F.pmod("h", "m").alias("part")).agg(F.bit_xor("h").alias("of"))
    full = parts.select("rep", "n", *parities, F.xxhash64("tag", "part", "of").alias("key"), "own")
    present = F.array_distinct(F.transform("ws", lambda w: F.pmod(F.xxhash64(w), F.col("m")).cast("int")))
    empty = tagged.withColumn("e", F.array_except(F.sequence(F.lit(0), F.col("m") - 1), present)).where(F.size("e") > 2)
    rest = lambda after: F.slice("e", after, F.size("e"))
    triple = lambda x, y, z: F.xxhash64("tag", x, y, z)
    third = lambda x, y, at: F.transform(rest(at), lambda z: triple(x, y, z))
    second = lambda x, i: F.flatten(F.transform(rest(i + 2), lambda y, j: third(x, y, i + j + 3)))
    triples = F.flatten(F.transform("e", second))
    return full.unionByName(empty.select("rep", "n", *parities, F.explode(triples).alias("key"), "own"))


def similar_pairs(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(``row_a``, ``row_b``, ``jaccard``) over distinct word sets, exact; a class of equal sets stands for its least row (members in ``similar_classes``).

    Sets meet on keys that similar ones must share, which is what few others do; what meets is verified on the words.
    """
    texts = rows.select("row_no", F.sort_array(word_set(F.col("system_description"))).alias("ws")).where(F.size("ws") > 0)
    distinct = texts.groupBy("ws").agg(F.min("row_no").alias("rep"))
    sets = cut_lineage(distinct.select("rep", "ws", *[_parities(F.col("ws"), i).alias(f"p{i}") for i in range(_LONGS)]))
    entries = cut_lineage(_meeting_keys(sets, threshold))
    kept = ("rep", "n", "own", *[f"p{i}" for i in range(_LONGS)])
    a, b = (entries.select("key", *[F.col(c).alias(f"{c}_{x}") for c in kept]) for x in "ab")
    bound = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    # Sets that differ in k words differ in k parities at most.
    unequal = reduce(Column.__add__, [F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(_LONGS)])
    near_enough = unequal <= (1 - threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9
    once = (F.col("rep_a") < F.col("rep_b")) & (F.col("own_a") | F.col("own_b"))
    met = a.join(b.hint("merge"), "key").where(once & bound & near_enough)
    near = met.select(F.col("rep_a").alias("row_a"), F.col("rep_b").alias("row_b")).distinct()
    for x in "ab":
        of = sets.select(F.col("rep").alias(f"row_{x}"), F.col("ws").alias(f"ws_{x}"))
        near = near.join(of.hint("merge"), f"row_{x}")
    common = F.size(F.array_intersect("ws_a", "ws_b"))
    jaccard = common / (F.size("ws_a") + F.size("ws_b") - common)
    return near.select("row_a", "row_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_links(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(``row_no``, ``rep``, ``n_links``) for each row with words: with how many other classes its class is linked in ``similar_pairs``."""
    links = similar_pairs(rows, threshold).select(F.explode(F.array("row_a", "row_b")).alias("rep")).groupBy("rep").agg(
        F.count("*").alias("n_links")
    )
    return similar_classes(rows).join(links.hint("merge"), "rep", "left").select(
        "row_no",
        "rep",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def length_outliers(rows: DataFrame, short: int = 60, long: int = 800) -> DataFrame:
    """Shorter than min(p5, ``short``) or longer than max(p95, ``long``), both strict. The percentiles are elements of the sorted lengths, found in a histogram of lengths."""
    sized = rows.select("row_no", "id", F.length(_text("system_description")).alias("n_chars"))
    hist = sized.where("n_chars > 0").groupBy("n_chars").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("n_chars"))
    placed = hist.select("n_chars", "n", upto.alias("upto"), total.alias("total"))
    low, high = F.greatest(F.floor(F.col("total") * 0.05) - 1, F.lit(0)), F.least(
        F.col("total") - 1,
        F.floor(F.col("total") * 0.95),
    )
    pick = lambda at: F.min(F.when(F.col("upto") > at, F.col("n_chars")))
    bounds = F.broadcast(placed.agg(F.least(pick(low), F.lit(short)).alias("low"), F.greatest(pick(high), F.lit(long)).alias("high")))  # one row
    kind = F.when((F.col("n_chars") > 0) & (F.col("n_chars") < F.col("low")), "short").when(
        F.col("n_chars") > F.col("high"),
        "long",
    )
    return sized.crossJoin(bounds).select("row_no", "id", "n_chars", kind.alias("kind")).where("kind is not null")


def unterminated(rows: DataFrame) -> DataFrame:
    text = F.regexp_replace(_text("system_description"), r"(?U)\s+$", "")
    return rows.select("row_no", "id", text.alias("t")).where((F.col("t") != "") & ~ends_well(F.col("t"))).select(
        "row_no",
        "id",
        F.right("t", F.lit(60)).alias("ending"),
    )


def label_against_mode(rows: DataFrame, none_is_empty: bool = False) -> DataFrame:
    """Rows without an edge case whose label isn't the commonest of their point, for points of three rows or more; ties go to the label seen first."""
    pointed = rows.where(_text("annex_iii_point") != "")
    counts = pointed.groupBy("annex_iii_point", "label").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    modes = counts.groupBy("annex_iii_point").agg(
        F.sum("n").alias("size"),
        F.max_by("label", F.struct("n", -F.col("first"))).alias("modal_label"),
    )
    joined = pointed.where(~_edge(none_is_empty)).join(modes.where("size >= 3"), "annex_iii_point")
    return joined.where(~F.col("label").eqNullSafe(F.col("modal_label"))).select(
        "row_no",
        "id",
        "annex_iii_point",
        "label",
        "modal_label",
    )


def filter_case_labels(rows: DataFrame, none_is_empty: bool = False) -> DataFrame:
    high = F.lower(_text("label")).isin("high-risk", "high_risk", "highrisk", "true", "1")
    return rows.where(_edge(none_is_empty) & high & (stripped(_text("notes")) == "")).select(
        "row_no",
        "id",
        "edge_case_type",
        "label",
    )


def label_vocabulary(rows: DataFrame) -> DataFrame:
    """Labels outside the vocabulary. A null label reads as the word none, as it does in the checks' definition."""
    label = F.lower(stripped(F.coalesce("label", F.lit("None"))))
    return rows.where((label != "") & ~label.isin(*LABELS)).select("row_no", "id", "label")


def set_summary(rows: DataFrame, none_is_empty: bool = False) -> DataFrame:
    """(``level``, ``value``, ``n``): rows, areas, labels in lower case, edge cases, review reasons."""
    parts = [
        rows.agg(F.count("*").alias("n"), count_where(_edge(none_is_empty)).alias("e")).select(
            F.inline(
                F.array(
                    F.struct(F.lit("rows").alias("level"), F.lit("all").alias("value"), F.col("n").alias("n")),
                    F.struct(F.lit("edge cases").alias("level"), F.lit("all").alias("value"), F.col("e").alias("n")),
                )
            )
        ),
        *[
            rows.groupBy(expr.alias("value")).agg(F.count("*").alias("n")).select(
                F.lit(level).alias("level"),
                "value",
                "n",
            )
            for level, expr in (
                ("area", F.coalesce("annex_iii_area", F.lit("None"))),
                ("label", F.lower(F.coalesce("label", F.lit("None")))),
                ("edge", F.coalesce("edge_case_type", F.lit("None"))),
            )
        ],
        rows.select(F.explode("needs_review").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(
            F.lit("review reason").alias("level"),
            "value",
            "n",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def corpus_statistics(chunks: DataFrame, limit: int = 1800) -> DataFrame:
    """(``level``, ``value``, ...): overall, by section and by area: number, least, upper median, greatest and floored mean length, and how many are over the limit.

    Medians come from a histogram of lengths, so only counts are shuffled and sorted.
    """
    lengths = chunks.select(
        "section",
        "annex_iii_area",
        F.length(collapsed(F.coalesce("text", F.lit("")))).alias("len"),
    ).groupBy("section", "annex_iii_area", "len").agg(F.count("*").alias("n"))
    levels = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("level"), value.alias("value"))
                for name, value in (
                    ("overall", F.lit(None).cast("string")),
                    ("section", F.col("section")),
                    ("area", F.col("annex_iii_area")),
                )
            ]
        )
    )
    hist = lengths.select(levels.alias("of"), "len", "n").groupBy("of.level", "of.value", "len").agg(
        F.sum("n").alias("n")
    )
    each = Window.partitionBy("level", "value")
    placed = hist.withColumn("upto", F.sum("n").over(each.orderBy("len"))).withColumn("total", F.sum("n").over(each))
    return placed.groupBy("level", "value").agg(
        F.sum("n").alias("n_chunks"),
        F.min("len").alias("min_len"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len"))).alias("median_len"),
        F.max("len").alias("max_len"),
        F.floor(F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_len"),
        F.sum(F.when(F.col("len") > limit, F.col("n")).otherwise(0)).alias("n_over"),
    )


def displayed(similarity: Column) -> Column:
    """A similarity as reports show it: two decimals, halves to the even digit. Thresholds take the unrounded one."""
    return F.bround(similarity, 2)
