"""Redaction and clean-up of descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import ends_well, redaction_sentences, replaced, stripped, without_legal_wording


def redacted(
    rows: DataFrame,
    reviews: DataFrame | None = None,
    overrides: DataFrame | None = None,
    trims: DataFrame | None = None,
    strips: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """``rows`` with ``system_description`` redacted, the former text and how: 'reviewer', 'manual', 'auto' or 'unchanged'.

    A reviewer's text (``id``, ``text``) comes first, less its literal strips (``id``, ``pairs`` array of old, new); then an override (``id``, ``text``); else sentences
    with legal wording go, and those with one of the trims (``id``, ``fragments``). Lookups hold an id once at most. ``strict`` raises on a row that becomes empty or
    a strip that isn't found; otherwise these stand as they are. A null description counts as empty.
    """
    out = rows
    for name, found, columns in (("review", reviews, ["text"]), ("override", overrides, ["text"]), ("trim", trims, ["fragments"]), ("strip", strips, ["pairs"])):
        kinds = {"text": "string", "fragments": "array<string>", "pairs": "array<struct<old:string,new:string>>"}
        if found is None:
            out = out.withColumn(f"_{name}", F.lit(None).cast(kinds[columns[0]]))
        else:
            out = out.join(
                found.select("id", F.col(columns[0]).cast(kinds[columns[0]]).alias(f"_{name}")),
                "id",
                "left",
            )
    original = F.coalesce("system_description", F.lit(""))
    pairs = F.coalesce("_strip", F.array().cast("array<struct<old:string,new:string>>"))
    if strict:
        found_all = F.forall(pairs, lambda p: F.contains(F.col("_review"), p["old"]))
        reviewed = F.when(found_all, stripped(replaced(F.col("_review"), pairs))).otherwise(
            F.raise_error(F.concat(F.lit("strip target not found: "), F.col("id"))).cast("string")
        )
    else:
        reviewed = stripped(replaced(F.col("_review"), pairs))
    auto = without_legal_wording(original)
    trimmed = F.when(
        F.size(F.coalesce("_trim", F.array().cast("array<string>"))) > 0,
        F.array_join(
            F.filter(redaction_sentences(auto), lambda s: ~F.exists("_trim", lambda t: F.contains(s, t))),
            " ",
        ),
    ).otherwise(auto)
    has_review, has_override = F.coalesce("_review", F.lit("")) != "", F.coalesce("_override", F.lit("")) != ""
    new = F.when(has_review, reviewed).when(has_override, F.col("_override")).otherwise(trimmed)
    how = F.when(has_review, "reviewer").when(has_override, "manual").when(
        trimmed != stripped(original),
        "auto",
    ).otherwise("unchanged")
    if strict:
        new = F.when(
            stripped(new) == "",
            F.raise_error(F.concat(F.lit("redacted to empty: "), F.col("id"))).cast("string"),
        ).otherwise(new)
    kept = [c for c in rows.columns if c != "system_description"]
    return out.select(
        *kept,
        new.alias("system_description"),
        F.col("system_description").alias("system_description_original"),
        how.alias("redaction"),
    )


def redaction_counts(redacted_rows: DataFrame) -> DataFrame:
    return redacted_rows.groupBy("redaction").agg(F.count("*").alias("n"))


def cut_at_markers(rows: DataFrame, markers: DataFrame, drop_ids: DataFrame | list[str]) -> DataFrame:
    """Rows without the dropped ids, a table with ``id`` or a short list; those with a marker (``id``, ``marker``) end before its first occurrence. ``outcome``: 'kept', 'fixed', or why it couldn't be: 'marker not
    found', 'bad ending' (then the text stands). A row whose id is null is kept."""
    text = F.coalesce("system_description", F.lit(""))
    at = F.instr(text, F.col("marker"))
    head = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"(?U)\s+$", "")
    outcome = F.when(F.col("marker").isNull(), "kept").when(at == 0, "marker not found").when(
        ends_well(head, (".", "?", "!", ")")),
        "fixed",
    ).otherwise("bad ending")
    if isinstance(drop_ids, DataFrame):
        kept = rows.join(drop_ids.select("id"), "id", "left_anti")
    else:
        kept = rows.where(F.col("id").isNull() | ~F.col("id").isin(*drop_ids)) if drop_ids else rows
    joined = kept.join(markers.select("id", "marker"), "id", "left").withColumn("outcome", outcome)
    rest: list[Column | str] = [c for c in rows.columns if c != "system_description"]
    return joined.select(
        *rest,
        F.when(F.col("outcome") == "fixed", head).otherwise(F.col("system_description")).alias("system_description"),
        "outcome",
    )
