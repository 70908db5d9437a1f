"""Oversized texts in pieces under a size limit, by dynamic programming over boundary positions.

A chunk is embedded as its heading, a line break and its text with white space collapsed; a chunk over ``LIMIT`` characters
is split. Each piece ends at one of the candidate places; the plan minimises, in this order of weight, cuts off any boundary, the
number of pieces, the penalties of the cuts and the squared imbalance of the sizes. Consecutive pieces share ``OVERLAP`` characters.

Candidate places are ends of sentences and clauses; where two of them are too far apart for one piece, ends of words between them too, and
where a word is too long for that, places within it. A heading that leaves less room than the overlap needs is shortened until it leaves
just enough, and its pieces are flagged; all others are planned with and given as they are.

Null and blank texts are never over the limit; repeated rows are each split; surplus columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

LIMIT = 1800
OVERLAP = (100, 200)

#: Penalties by kind of cut; the last three are cuts off any boundary.
SENTENCE, CLAUSE, COMMA, WORD, INSIDE = 0.0, 0.3, 1e4, 2e4, 1e5
PIECE, IMBALANCE = 10.0, 4.0
_SPACE = re.compile(r"\s+")
_BOUNDARY = re.compile(r"(?<=[.;:]) ")


def collapsed(text: str | None) -> str:
    return _SPACE.sub(" ", text).strip() if isinstance(text, str) else ""


def cut_kind(body: str, share: int, limit: int = LIMIT) -> str | None:
    """'forced' or 'boundary' for a text over the limit, else null. ``share``: what the heading takes."""
    if len(body) + share <= limit:
        return None
    return "forced" if max(map(len, _BOUNDARY.split(body))) > limit - share else "boundary"


def _places(body: str, reach: int) -> list[tuple[int, float]]:
    """Where a piece may end, with its penalty."""
    places = [
        (m.start(), SENTENCE if body[m.start() - 1] in ".!?" else CLAUSE) for m in re.finditer(r"(?<=[.;:!?]) ", body)
    ]
    out: list[tuple[int, float]] = []
    last = 0
    for at, penalty in [*places, (len(body), SENTENCE)]:
        if at - last > reach:
            blanks = [i for i in range(last + 1, at) if body[i] == " "]
            before = last
            for b in [*blanks, at]:
                if b - before > reach:
                    out.extend((i, INSIDE) for i in range(before + 25, b, 25))
                if b < at:
                    out.append((b, COMMA if body[b - 1] == "," else WORD))
                before = b
        out.append((at, penalty))
        last = at
    return out


def _next_start(body: str, end: int, overlap: tuple[int, int]) -> int:
    """Where the piece after one that ends at ``end`` starts: a sentence, else a word, else the middle of the allowed range."""
    low, high = end - overlap[1], end - overlap[0]
    if low <= 0:
        return max(0, min(high, low))
    best, rank = end - sum(overlap) // 2, 3
    for i in range(low, high + 1):
        if body[i - 1] == " ":
            now = 0 if body[i - 2] in ".!?" else 1 if body[i - 2] in ";:" else 2
            if now < rank:
                best, rank = i, now
    return best


def plan(body: str, room: int, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int, float]]:
    """Start, end and penalty of each piece of ``body``, each at most ``room`` characters."""
    if len(body) <= room:
        return [(0, len(body), 0.0)]
    if room <= 2 * overlap[1]:
        raise ValueError("the limit leaves too little room for the overlap")
    places = [p for p in _places(body, (room - overlap[1]) // 2) if p[0] > overlap[1]]
    ends = [p[0] for p in places]
    starts = [_next_start(body, e, overlap) for e in ends]
    target = len(body) / -(-(len(body) - overlap[1]) // (room - overlap[1]))
    best = np.full(len(places), np.inf)
    back = [-1] * len(places)
    at = np.array(starts, dtype=np.float64)
    for k, (end, penalty) in enumerate(places):
        own = PIECE + (penalty if end < len(body) else 0.0)
        if end <= room:
            best[k] = own + IMBALANCE * (1 - end / target) ** 2
        # The start of the piece lies at most room before its end, and starts rise with the ends they follow.
        low = bisect_left(ends, end - room)
        if low < k:
            sizes = end - at[low:k]
            costs = np.where(sizes <= room, best[low:k] + own + IMBALANCE * (1 - sizes / target) ** 2, np.inf)
            j = int(costs.argmin())
            if costs[j] < best[k]:
                best[k], back[k] = costs[j], low + j
    pieces = []
    k = len(places) - 1
    while k >= 0:
        j = back[k]
        pieces.append((starts[j] if j >= 0 else 0, ends[k], places[k][1] if ends[k] < len(body) else 0.0))
        k = j
    return pieces[::-1]


_KINDS = {SENTENCE: "sentence", CLAUSE: "clause", COMMA: "comma", WORD: "word", INSIDE: "inside"}


def split_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> DataFrame:
    """``chunks``: (``row_no``, ``heading_path``, ``text``). The pieces of those over the limit: (``row_no``, ``cut_kind``, ``piece_no``, ``n_pieces``,
    ``starts_at``, ``ends_at``, ``shared``, ``ends_with``, ``heading``, ``text``, ``heading_shortened``)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row_no, heading, text in zip(pdf["row_no"], pdf["heading_path"], pdf["text"], strict=True):
                heading = heading if isinstance(heading, str) else None
                body, share = collapsed(text), 0 if heading is None else len(heading) + 1
                kind = cut_kind(body, share, limit) if body else None
                if kind is None:
                    continue
                shortened = heading is not None and limit - share <= 2 * overlap[1]
                if shortened:
                    share = max(1, limit - 2 * overlap[1] - 1)
                    heading = heading[: share - 1]
                pieces = plan(body, limit - share, overlap)
                before = 0
                for n, (start, end, penalty) in enumerate(pieces, 1):
                    rows.append(
                        (
                            row_no,
                            kind,
                            n,
                            len(pieces),
                            start,
                            end,
                            before - start if n > 1 else 0,
                            "end" if end == len(body) else _KINDS[penalty],
                            heading,
                            body[start:end],
                            shortened,
                        )
                    )
                    before = end
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    source = chunks.select(
        F.col("row_no").cast("long").alias("row_no"),
        F.col("heading_path").cast("string").alias("heading_path"),
        F.col("text").cast("string").alias("text"),
    )
    return spread(source).mapInPandas(split, _PIECES)


_PIECES = "row_no long, cut_kind string, piece_no int, n_pieces int, starts_at int, ends_at int, shared int, ends_with string, heading string, text string, heading_shortened boolean"


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    return split_pieces(chunks, limit).where("piece_no = 1").select("row_no", "cut_kind")
