"""Texts in training sequences of fixed capacity: vector bin packing by the dot product.

Every text, or part of a text of more than the capacity, is an item with three demands: tokens, one segment, and the tokens that
bear loss: those outside links, markup and quoted lines, less the first of a segment, which nothing predicts. Items fall by hash into groups of about ``GROUP``;
each group fills one sequence after another, always with the fitting item whose demands have the largest dot product
with the room left, both in shares of the limits and weighted by how scarce the limit is in the group. A group ends with at most about one sequence that isn't full, so the groups
cost one sequence in some hundreds.

A text of up to ``TOKENS`` tokens must stay whole, so the limit on tokens that bear loss can't be under ``TOKENS - 1`` unless texts over it may be divided; a lower one given to ``pack`` divides these.

Null and empty texts are items of no tokens and come out once, too. Repeated rows of one ``doc_id`` are one text: the key must be unique.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, spread

TOKENS, SEGMENTS, LOSS = 2048, 64, 2047
GROUP = 8192
#: The file of a public vocabulary; ``PLUMBLINE_VOCABULARY`` names another place.
VOCABULARY = os.environ.get("PLUMBLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with Path(path).open("rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: What is read but not to be learned: links, tags and entities, quoted lines.
_MASKED = re.compile(r"(?:\b(?:https?|ftp):)?//[^\s<>()\]]+|\bwww\.[^\s<>()\]]+|<[^<>]{1,200}>|&#?[A-Za-z0-9]{1,10};|^[ \t]*>.*$", re.MULTILINE)
#: A text without these has no masked span.
_MARKS = ("//", "www.", "&", ">")


def bears_loss(text: str, pieces: list[bytes]) -> np.ndarray:
    """For each token, given as its bytes, whether any of it lies outside the masked spans."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    free = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for m in _MASKED.finditer(text):
        start = len(text[: m.start()].encode("utf-8", "replace"))
        free[start : start + len(m.group().encode("utf-8", "replace"))] = 0
    upto = np.concatenate(([0], np.cumsum(free)))
    return upto[ends] > upto[ends - sizes]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = TOKENS) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``losses``) of ``documents`` (``doc_id``, ``text``): for each part of ``capacity`` tokens, how many bear loss."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for pdf in batches:
            sizes, losses = [], []
            for text in pdf["text"]:
                tokens = encoding.encode_ordinary(text) if isinstance(text, str) else []
                starts = np.arange(0, max(len(tokens), 1), capacity)
                if tokens and any(mark in text for mark in _MARKS) and _MASKED.search(text):
                    bearing = np.concatenate((bears_loss(text, encoding.decode_tokens_bytes(tokens)), [False]))
                    own = np.add.reduceat(bearing, starts) - bearing[starts]
                else:
                    own = np.maximum(np.minimum(capacity, len(tokens) - starts) - 1, 0)
                sizes.append(len(tokens))
                losses.append(own.astype(np.int32))
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "n_tokens": sizes, "losses": pd.Series(losses, dtype=object, index=pdf.index)}
            )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(source).mapInPandas(count, "doc_id long, n_tokens int, losses array<int>")


def fill(
    tokens: np.ndarray,
    limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS),
    losses: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """For items of these sizes, none over the limits: the sequence of each and its place there. All tokens but the first bear loss unless ``losses`` says otherwise."""
    losses = np.maximum(tokens - 1, 0) if losses is None else losses
    kinds, kind = np.unique(
        np.stack([tokens, np.ones_like(tokens), losses], axis=1).astype(np.int64),
        axis=0,
        return_inverse=True,
    )
    kind = kind.reshape(-1)
    queues: list[list[int]] = [[] for _ in kinds]
    for i in range(len(tokens) - 1, -1, -1):
        queues[kind[i]].append(i)
    most = np.array(limits, dtype=np.int64)
    scale = 1.0 / np.maximum(most, 1)
    shares = kinds * scale
    left = np.bincount(kind, minlength=len(kinds)) if len(kinds) else np.empty(0, dtype=np.int64)
    need = (shares * left[:, None]).sum(axis=0) if len(kinds) else np.zeros(3)
    weighted = shares * (need / max(need.sum(), 1e-9))
    sequence, place = np.empty(len(tokens), dtype=np.int64), np.empty(len(tokens), dtype=np.int64)
    room, at, n = most.copy(), 0, 0
    for _ in range(len(tokens)):
        fits = (left > 0) & (kinds <= room).all(axis=1)
        if not fits.any():
            room, at, n = most.copy(), at + 1, 0
            fits = left > 0
        k = int(np.where(fits, weighted @ (room * scale), -1.0).argmax())
        i = queues[k].pop()
        sequence[i], place[i] = at, n
        left[k] -= 1
        room = room - kinds[k]
        n += 1
    return sequence, place


_PACKED = "doc_id long, part_no int, n_parts int, token_from int, token_to int, sequence_id long, segment_no int, starts_at int, n_loss int"


def pack(
    documents: DataFrame,
    vocabulary: str = VOCABULARY,
    limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS),
    group: int = GROUP,
) -> DataFrame:
    """A row per text, or part of a text over the capacity: its tokens from ``token_from`` up to ``token_to``, of which ``n_loss`` bear loss, are segment ``segment_no`` of
    ``sequence_id``, from its token ``starts_at`` on."""
    capacity = min(limits[0], limits[2] + 1)
    counts = cut_lineage(token_counts(documents, vocabulary, capacity))
    n_parts = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    parts = counts.withColumn("n_parts", n_parts).select(
        "doc_id",
        "n_tokens",
        "n_parts",
        F.posexplode("losses").alias("place", "n_loss"),
    ).withColumn("part_no", F.col("place") + 1)
    parts = parts.select(
        "doc_id",
        "part_no",
        "n_parts",
        "n_loss",
        ((F.col("part_no") - 1) * capacity).alias("token_from"),
        F.least(F.col("part_no") * capacity, "n_tokens").alias("token_to"),
    )
    n_groups = max(1, -(-counts.count() // group))
    # The sizes are few bytes, but filling takes seconds a group: the number of partitions is set lest they be coalesced
    # into one.
    n_tasks = min(n_groups, 4 * documents.sparkSession.sparkContext.defaultParallelism)
    grouped = parts.withColumn(
        "group_no",
        F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(n_groups)),
    ).repartition(n_tasks, "group_no")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no"], ignore_index=True)
        sizes = (pdf["token_to"] - pdf["token_from"]).to_numpy()
        sequence, segment = fill(sizes, limits, pdf["n_loss"].to_numpy())
        order = np.lexsort((segment, sequence))
        total = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
        fresh = np.concatenate(([True], sequence[order][1:] != sequence[order][:-1]))
        starts = np.empty(len(pdf), dtype=np.int64)
        starts[order] = total - np.maximum.accumulate(np.where(fresh, total, 0))
        return pdf.drop(columns="group_no").assign(
            sequence_id=int(pdf["group_no"].iloc[0]) * (1 << 32) + sequence,
            segment_no=segment + 1,
            starts_at=starts,
        )

    return grouped.groupBy("group_no").applyInPandas(place, _PACKED)


def packing_summary(packed: DataFrame, capacity: int = TOKENS) -> DataFrame:
    """(``n_texts``, ``n_parts``, ``n_sequences``, ``n_tokens``, ``least_sequences``, ``unused_share``, ``most_tokens``, ``most_segments``, ``most_loss``) of ``pack``'s result; one row, also for an empty one."""
    tokens_of = F.sum(F.col("token_to") - F.col("token_from"))
    sequences = packed.groupBy("sequence_id").agg(
        tokens_of.alias("n_tokens"),
        F.count("*").alias("n_parts"),
        F.sum((F.col("part_no") == 1).cast("long")).alias("n_texts"),
        F.sum("n_loss").alias("n_loss"),
    )
    n, total = F.count("*"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    most = [
        F.coalesce(F.max(c), F.lit(0)).alias(name)
        for c, name in (("n_tokens", "most_tokens"), ("n_parts", "most_segments"), ("n_loss", "most_loss"))
    ]
    return sequences.agg(
        total("n_texts").alias("n_texts"),
        total("n_parts").alias("n_parts"),
        n.alias("n_sequences"),
        total("n_tokens").alias("n_tokens"),
        F.ceil(total("n_tokens") / capacity).alias("least_sequences"),
        F.when(n > 0, 1 - total("n_tokens") / (n * capacity)).alias("unused_share"),
        *most,
    )
