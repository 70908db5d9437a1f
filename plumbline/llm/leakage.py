"""Documents that repeat held-out items, whole or in part.

A prefix-filtered set join. Words are runs of letters or digits without regard to case; shingles have five words. A
stretch of an item of ``STRETCH`` words or more, with one word in ``EDIT_EVERY`` changed, added or dropped, keeps at least
``SURVIVORS`` of its shingles, and some window of ``STRETCH`` words of it keeps ``IN_WINDOW``. So of the shingles of each window, ordered
by rarity in the documents, a prefix of all but ``IN_WINDOW - 1`` must meet the document. Documents with fewer hits than
``SURVIVORS`` are out by length; the places of the hits give the item-sized windows of the document in which an alignment
verifies the words themselves.

Null and empty texts, of documents or items, give no rows; repeated documents are each reported; a pair is reported once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import SHINGLE, Bitmap, hashes, plain_words, shingles
from plumbline.session import cut_lineage, spread

STRETCH, EDIT_EVERY = 20, 8
#: The least of (n - 4) - 5 * (n // 8) over n >= 20, and what one of the two outer windows keeps of these.
SURVIVORS, IN_WINDOW = 5, 3


def _item_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [hashes(plain_words(t)) if isinstance(t, str) else np.empty(0, np.uint64) for t in pdf["text"]]
        yield pd.DataFrame(
            {
                "item_id": pdf["item_id"],
                "item_words": [w.view(np.int64) for w in words],
                "item_shingles": [shingles(w).view(np.int64) for w in words],
            }
        )


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The necessary prefix of each window, as the union over the item's windows."""
    width = STRETCH - SHINGLE + 1
    for pdf in batches:
        out = []
        for item, found in zip(pdf["item_id"], pdf["counted"], strict=True):
            by_place = sorted((x["pos"], x["n_docs"], x["shingle"]) for x in found)
            if len(by_place) < width:
                continue
            kept = set()
            for lo in range(len(by_place) - width + 1):
                kept.update(sorted(by_place[lo : lo + width], key=lambda x: (x[1], x[2]))[: width - IN_WINDOW + 1])
            out.extend((item, pos, shingle) for pos, _, shingle in kept)
        yield pd.DataFrame(out, columns=["item_id", "item_pos", "shingle"])


def contains_stretch(item: np.ndarray, document: np.ndarray, offsets: list[int]) -> bool:
    """Whether a stretch of ``item`` is in ``document`` near one of ``offsets`` (place in the document less place in the item)."""
    slack = len(item) // EDIT_EVERY + 1
    ends: list[list[int]] = []
    for offset in sorted(set(offsets)):  # offsets within a slack of each other share a window
        if ends and offset - ends[-1][0] <= slack:
            ends[-1][1] = offset
        else:
            ends.append([offset, offset])
    own = shingles(item)
    for a, b in ends:
        window = document[max(0, a - slack) : b + len(item) + slack]
        if np.isin(own, shingles(window)).sum() >= SURVIVORS and _aligns(item, window):
            return True
    return False


def _aligns(item: np.ndarray, window: np.ndarray) -> bool:
    m, w = len(item), len(window)
    starts = m - STRETCH + 1
    if starts <= 0 or w < STRETCH - STRETCH // EDIT_EVERY:
        return False
    equal = item[:, None] == window[None, :]
    run = np.zeros(w + 1, dtype=np.int32)
    for i in range(m):
        run[1:] = np.where(equal[i], run[:-1] + 1, 0)
        if run.max() >= STRETCH:
            return True
    # edits[s, j]: least edits from the item's words from s on, up to the current one, to words of the window that end
    # at j.
    columns = np.arange(w + 1, dtype=np.int32)
    edits = np.full((starts, w + 1), 10_000, dtype=np.int32)
    for i in range(m):
        if i < starts:
            edits[i] = 0
        active = edits[: min(i + 1, starts)]
        step = active + 1
        np.minimum(step[:, 1:], active[:, :-1] + ~equal[i], out=step[:, 1:])
        step = np.minimum.accumulate(step - columns, axis=1) + columns
        edits[: len(step)] = step
        length = i + 1 - np.arange(len(step))
        if ((step.min(axis=1) * EDIT_EVERY <= length) & (length >= STRETCH)).any():
            return True
    return False


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kept = [
            contains_stretch(np.asarray(item, np.int64).view(np.uint64), np.asarray(document, np.int64).view(np.uint64), list(offsets)) for item, document, offsets in zip(pdf["item_words"], pdf["doc_words"], pdf["offsets"], strict=True)
        ]
        yield pdf.loc[kept, ["doc_id", "item_id"]]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents``: (``doc_id``, ``text``); ``items``: (``item_id``, ``text``). Returns the distinct pairs (``doc_id``, ``item_id``)."""
    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = cut_lineage(
        source.mapInPandas(_item_shingles, "item_id long, item_words array<long>, item_shingles array<long>")
    )
    placed = known.select("item_id", F.posexplode("item_shingles").alias("pos", "shingle"))
    distinct = placed.select("shingle").distinct()
    # A bitmap of fixed size drops the shingles that no item has; the few that pass by chance meet no item in the joins.
    wanted = documents.sparkSession.sparkContext.broadcast(Bitmap.of(known.select("item_shingles")))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not isinstance(text, str):
                    continue
                words = hashes(plain_words(text))
                found = shingles(words)
                places = np.flatnonzero(wanted.value.has(found))
                found = found.view(np.int64)
                if len(places):
                    enough = len(places) >= SURVIVORS
                    rows.append((doc, places.astype(np.int32), found[places], words.view(np.int64) if enough else None))
            yield pd.DataFrame(rows, columns=["doc_id", "places", "found", "doc_words"])

    pages = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = cut_lineage(
        spread(pages).mapInPandas(hits, "doc_id long, places array<int>, found array<long>, doc_words array<long>")
    )
    each = hit.select(F.explode(F.array_distinct("found")).alias("shingle"))
    n_docs = each.groupBy("shingle").agg(F.count("*").alias("n_docs")).join(distinct, "shingle", "left_semi")
    counted = placed.join(n_docs.hint("merge"), "shingle", "left").select(
        "item_id",
        F.struct("pos", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "shingle").alias("x"),
    )
    prefixes = counted.groupBy("item_id").agg(F.collect_list("x").alias("counted")).mapInPandas(
        _prefixes,
        "item_id long, item_pos int, shingle long",
    )
    prefixes = cut_lineage(prefixes)
    seeds = hit.where("doc_words is not null").select(
        "doc_id",
        F.explode(F.arrays_zip("places", "found")).alias("x"),
    ).select("doc_id", F.col("x.places").alias("place"), F.col("x.found").alias("shingle"))
    candidates = (
        seeds.join(prefixes.hint("merge"), "shingle")
        .groupBy("doc_id", "item_id")
        .agg(F.collect_set(F.col("place") - F.col("item_pos")).alias("offsets"))
    )
    # The words of an item are joined first: they are few, where those of a document would be copied for each of its items.
    known_words = known.select("item_id", "item_words")
    full = candidates.join(known_words.hint("merge"), "item_id").join(hit.select("doc_id", "doc_words").hint("merge"), "doc_id")
    return full.mapInPandas(_verified, "doc_id long, item_id long").distinct()
