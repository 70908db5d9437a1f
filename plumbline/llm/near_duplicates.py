"""Near-duplicate texts by b-bit MinHash.

A text is the set of its distinct lower-cased words, words being what white space separates. Texts with the same
set form a class; the search runs over one representative per class. For each class: ``BANDS * ROWS`` minima, a key per band, and the
``BITS`` low bits of ``SIGNED`` of the minima packed into longs. Entries of a band key and a signature are dealt out by band key, packed
by the thousand into one binary value per place. Classes that share a band key meet there, and their packed signatures give an estimate of the
similarity by bit counts, corrected for the chance agreement of b bits; what may reach the threshold is verified on the whole word sets, which are
made again from the texts of these classes alone. Where entries are many they are dealt some bands at a time.

At a similarity of 0.85 a pair shares no band with probability (1 - 0.85**8)**40 = 3e-6, and the margin of the estimate
is six standard deviations.

Texts that differ in a word or two by the thousand fill buckets whose pairs all have to be verified. A sample of the keys of two bands at once, which
texts that merely come from the same templates hardly share, finds such buckets; each of their members is linked to the least of the bucket, the
components of these links are blobs, and a blob is verified in blocks, each pair of blocks by one product of
word incidences. Blocks give pairs, or for groups only the number of links of each member and links enough to connect them. The sample decides which way
a pair is verified, never whether.

Null and blank texts have no words and take no part, rows without a key have no name and are left out. Repeated rows are pairs of similarity 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Bitmap, hashes
from plumbline.operators.components import connected_components
from plumbline.session import cut_lineage, free_unused, spread

BANDS, ROWS, BITS, SIGNED = 40, 8, 2, 128
#: A similarity estimate this far below the threshold still goes to verification.
MARGIN = 0.225
#: One class in ``SAMPLE`` is looked at to find the buckets of two bands of about ``SAMPLE * HOT`` members or more.
SAMPLE, HOT = 16, 8
#: A block has about so many members, and so many words, at most; word incidences are multiplied so many columns at a
#: time.
BLOCK, BLOCK_WORDS, COLUMNS = 1024, 200_000, 2048
#: Entries are dealt in passes of about so many bytes, of which there are at most ``PASSES``, to places of about so many bytes each.
PASS_BYTES, PASSES, PLACE_BYTES = 256_000_000, 10, 32_000_000
#: Entries count words up to here; the bound on the sizes of two sets still holds then.
MOST_WORDS = (1 << 16) - 1
_K = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, _K, dtype=np.uint64)
#: The minima are of the upper 32 bits of word hashes, mixed by these.
_A32, _B32 = (_A >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_B >> np.uint64(31)).astype(np.uint32)
#: The lowest bits of a minimum follow those of the word alone; signatures take bits above so many.
_ABOVE = 10
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PER_LONG = 64 // BITS
_SIGNATURE = [f"s{i}" for i in range(SIGNED // _PER_LONG)]
#: The lowest bit of each group of bits.
_LOW = np.uint64(sum(1 << (BITS * i) for i in range(_PER_LONG)))
_HEAD = "n_words int, " + ", ".join(f"{x} long" for x in _SIGNATURE) + ", bands binary"


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, ids, sets = [], [], []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            words = set(text.lower().split()) if isinstance(text, str) else None
            if words:
                h = np.sort(hashes(list(words)))
                keys.append(key)
                ids.append(xxhash.xxh3_128_digest(h.tobytes()))
                sets.append(h.view(np.int64))
        yield pd.DataFrame(
            {
                "key": pd.Series(keys, dtype="int64"),
                "set_id": pd.Series(ids, dtype=object),
                "words": pd.Series(sets, dtype=object),
            }
        )


def _minima(word_hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), _K), dtype=np.uint32)
    word_hashes, ends = (word_hashes >> np.uint64(32)).astype(np.uint32), np.append(starts[1:], len(word_hashes))
    for lo in range(0, len(starts), 512):  # so many texts stay in the cache
        hi = min(lo + 512, len(starts))
        own, at = word_hashes[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
        mixed = np.empty_like(own)
        for k in range(_K):
            np.multiply(own, _A32[k], out=mixed)
            np.add(mixed, _B32[k], out=mixed)
            out[lo:hi, k] = np.minimum.reduceat(mixed, at)
    return out.astype(np.uint64)


def _pack(minima: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, ``_PER_LONG`` of them to a long."""
    low = (minima >> np.uint64(_ABOVE)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(len(low), -1, _PER_LONG) << shifts, axis=2).view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _word_sets(batches):
        every = pdf["words"].map(len).to_numpy()
        for _, at in pdf.groupby(np.cumsum(every) // 200_000).indices.items():  # so many words at once, or one long text
            part, sizes = pdf.iloc[at], every[at]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            minima = _minima(np.concatenate(part["words"].to_list()).view(np.uint64), starts)
            with np.errstate(over="ignore"):
                bands = (minima.reshape(len(part), BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64)
                bands = (bands ^ (bands >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            bands = (bands >> np.uint64(32)).astype(np.uint32)
            packed = _pack(minima[:, :SIGNED])
            yield pd.DataFrame(
                {
                    "key": part["key"].to_numpy(),
                    "set_id": part["set_id"].to_numpy(),
                    "n_words": sizes,
                    **dict(zip(_SIGNATURE, packed.T, strict=True)),
                    "bands": [x.tobytes() for x in bands],
                }
            )


def _bands(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["bands"]), dtype=np.uint32).reshape(len(pdf), BANDS)


def _unequal(x: Column, y: Column) -> Column:
    """How many groups of bits of two longs differ."""
    d = x.bitwiseXOR(y)
    folded = d
    for i in range(1, BITS):
        folded = folded.bitwiseOR(F.shiftrightunsigned(d, i))
    low = sum(1 << (BITS * i) for i in range(_PER_LONG))
    return F.bit_count(folded.bitwiseAND(F.lit(low - (1 << 64) if BITS == 1 else low).cast("long"))).cast("int")


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from two packed signatures: the share of agreeing groups of bits, less what agrees by chance."""
    chance = 1.0 / (1 << BITS)
    differing = reduce(Column.__add__, [_unequal(x, y) for x, y in zip(a, b, strict=True)])
    return (1.0 - differing / F.lit(float(len(a) * _PER_LONG)) - chance) / (1.0 - chance)


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(
        F.col(key).cast("long").alias("key"),
        F.col(text).cast("string").alias("text"),
    ).where("key is not null")


def classes(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``key``, ``rep``) and classes (``rep``, number of words, signature, band keys): texts of the same word set share the least key as ``rep``."""
    sets = cut_lineage(spread(source).mapInPandas(_sketches, f"key long, set_id binary, {_HEAD}"))
    sketch = ["n_words", *_SIGNATURE, "bands"]
    heads = sets.groupBy("set_id").agg(F.min("key").alias("rep"), *[F.first(c).alias(c) for c in sketch])
    heads = cut_lineage(heads)
    free_unused(source.sparkSession)
    members = cut_lineage(
        sets.select("key", "set_id").join(heads.select("set_id", "rep").hint("merge"), "set_id").select("key", "rep")
    )
    return members, heads.select("rep", *sketch)


def _word_sets_of(source: DataFrame, reps: DataFrame) -> DataFrame:
    """(``rep``, ``words``) of the classes in ``reps``, a table with one column, an array of them; by chance of some others, too."""
    wanted = source.sparkSession.sparkContext.broadcast(Bitmap.of(reps))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(wanted.value.has(keys))).to_pandas()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _word_sets(asked(batches)):
            words = pa.array(pdf["words"].to_list(), type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(pdf["key"]), words], names=["rep", "words"])

    return spread(source).mapInArrow(sets, "rep long, words array<long>")


def _twins(hot: Callable[[], Bitmap] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The keys of two bands at once; of these only what is in ``hot``, if it is given."""

    def twins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bands = _bands(pdf).astype(np.uint64)
            with np.errstate(over="ignore"):
                keys = ((bands[:, 0::2] << np.uint64(32)) | bands[:, 1::2]) * _A[0] + _A[1 : 1 + BANDS // 2]
            row, column = np.nonzero(hot().has(keys)) if hot else np.nonzero(np.ones(keys.shape, dtype=bool))
            yield pd.DataFrame({"rep": pdf["rep"].to_numpy()[row], "twin": keys[row, column].view(np.int64)})

    return twins


def _hot_blobs(heads: DataFrame) -> DataFrame | None:
    """(``rep``, ``blob``) of all classes in hot buckets; null when there are none."""
    sampled = heads.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select("rep", "bands")
    twins = sampled.mapInPandas(_twins(), "rep long, twin long")
    hot = cut_lineage(twins.groupBy("twin").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("twin"))
    if not hot.head(1):
        return None
    # A bitmap of fixed size drops the keys that aren't hot; the few that pass by chance meet none in the join.
    wanted = heads.sparkSession.sparkContext.broadcast(Bitmap.of(hot.select(F.array("twin").alias("twins"))))
    near = heads.select("rep", "bands").mapInPandas(_twins(lambda: wanted.value), "rep long, twin long")
    inside = cut_lineage(near.join(hot.hint("merge"), "twin"))
    least = inside.groupBy("twin").agg(F.min("rep").alias("least"))
    star = inside.join(least.hint("merge"), "twin").select(F.col("rep").alias("src"), F.col("least").alias("dst"))
    return cut_lineage(
        connected_components(star).select(F.col("node").alias("rep"), F.col("component").alias("blob"))
    )


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words each of the ``left`` sets has in common with each of the ``right`` ones."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, word, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    everywhere = int((n == len(sets)).sum())
    kept = (n > 1) & (n < len(sets))
    number = np.cumsum(kept) - 1
    row, column = row[kept[word]], number[word[kept[word]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.full((len(left), len(right)), everywhere, dtype=np.float32)
    for lo in range(0, int(kept.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[row[at], column[at] - lo] = 1
        common += has[left] @ has[right].T
    return common


def _block_verifier(threshold: float, as_pairs: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The links between the members of two blocks, or within one: as pairs, or as numbers of links with links enough to connect the linked ones."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
        reps, block = pdf["rep"].to_numpy(), pdf["block"].to_numpy()
        sets = [np.asarray(w, dtype=np.int64) for w in pdf["words"]]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        common = _common(sets, left, right)
        sizes = np.fromiter(map(len, sets), np.float64, len(sets))
        similarity = common / (sizes[left][:, None] + sizes[right][None, :] - common)
        linked = similarity >= threshold
        if one == two:
            linked &= reps[left][:, None] < reps[right][None, :]
        i, j = np.nonzero(linked)
        a, b = reps[left[i]], reps[right[j]]
        if as_pairs:
            return pd.DataFrame(
                {"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": similarity[i, j].astype(np.float64)}
            )
        least = np.arange(len(reps))
        while len(i):
            low = np.minimum(least[left[i]], least[right[j]])
            before = least.copy()
            np.minimum.at(least, left[i], low)
            np.minimum.at(least, right[j], low)
            if (before == least).all():
                break
        links = np.bincount(left[i], minlength=len(reps)) + np.bincount(right[j], minlength=len(reps))
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": reps[some], "n_links": links[some], "to": reps[least[some]]})

    return verify


def _blob_links(blobs: DataFrame, source: DataFrame, threshold: float, as_pairs: bool) -> DataFrame:
    words = _word_sets_of(source, blobs.select(F.array("rep").alias("reps")))
    members = cut_lineage(blobs.join(words.hint("merge"), "rep"))
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("words")) / BLOCK_WORDS)).cast("int")
    sizes = members.groupBy("blob").agg(n_blocks.alias("n_blocks"))
    placed = members.join(sizes.hint("merge"), "blob").withColumn(
        "block",
        F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"),
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pairs = met.select(
        "blob",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        "block",
        "rep",
        "words",
    )
    session = source.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    schema = "a long, b long, similarity double" if as_pairs else "rep long, n_links long, to long"
    return pairs.repartition(tasks, "blob", "one", "two").groupBy("blob", "one", "two").applyInPandas(
        _block_verifier(threshold, as_pairs),
        schema,
    )


def _entry(with_blobs: bool) -> np.dtype:
    fields = [("band", np.uint32), ("n_words", np.uint16), ("rep", np.int64), *[(x, np.uint64) for x in _SIGNATURE]]
    return np.dtype([*fields, *([("blob", np.int64)] if with_blobs else [])])


def _deal(bands: range, places: int, entry: np.dtype) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The entries of some bands, those for the same place packed together."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entries = np.empty((len(pdf), len(bands)), dtype=entry)
            with np.errstate(over="ignore"):  # the same key in another band is another one
                entries["band"] = _bands(pdf)[:, bands.start : bands.stop] + _A[: len(bands)].astype(np.uint32)
            entries["n_words"] = np.minimum(pdf["n_words"].to_numpy(), MOST_WORDS)[:, None]
            for x in entry.names[2:]:
                entries[x] = pdf[x].to_numpy().astype(np.int64).view(entry[x])[:, None]
            entries = entries.ravel()
            place = entries["band"] % np.uint32(places)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(places + 1))
            some = np.flatnonzero(np.diff(cuts))
            entries = entries[order]
            yield pd.DataFrame(
                {"place": some.astype(np.int32), "entries": [entries[cuts[i] : cuts[i + 1]].tobytes() for i in some]}
            )

    return deal


def _meet(entry: np.dtype, threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The pairs of entries with the same band key whose estimate may reach the threshold, without those within a blob."""
    chance = 1.0 / (1 << BITS)
    most = int((1.0 - (threshold - MARGIN) * (1.0 - chance) - chance) * SIGNED + 1e-9)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = [x for pdf in batches for x in pdf["entries"]]
        every = np.frombuffer(b"".join(packed), dtype=entry)
        del packed
        band = every["band"]
        order = np.argsort(band, kind="stable")
        same = np.diff(band[order]) == 0
        order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        if "blob" in entry.names:  # members of a blob stand together, so that their pairs are passed over
            order = order[np.lexsort((every["blob"][order], band[order]))]
        every = every[order]
        n, band = len(every), every["band"]
        end = np.searchsorted(band, band, side="right")
        partner = np.arange(1, n + 1)
        if "blob" in entry.names and n:
            edge = np.flatnonzero(np.append((np.diff(band) != 0) | (np.diff(every["blob"]) != 0), True)) + 1
            partner = np.where(every["blob"] < 0, partner, edge[np.searchsorted(edge, partner)])
        sizes = every["n_words"].astype(np.float32)
        rep, signature = np.ascontiguousarray(every["rep"]), [np.ascontiguousarray(every[x]) for x in _SIGNATURE]
        one = np.flatnonzero(partner < end)
        partner, end = partner[one], end[one]
        found, held = [], 0
        while len(one):
            differing = np.zeros(len(one), dtype=np.uint8)
            for x in signature:
                d = x[one] ^ x[partner]
                folded = d
                for i in range(1, BITS):
                    folded = folded | (d >> np.uint64(i))
                differing += np.bitwise_count(folded & _LOW)
            close = np.flatnonzero(differing <= most)
            if len(close):
                n_a, n_b = sizes[one[close]], sizes[partner[close]]
                close = close[np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 0.01]
            if len(close):
                a, b = rep[one[close]], rep[partner[close]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                held += len(close)
            if held > 2_000_000:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])
                found, held = [], 0
            partner = partner + 1
            left = partner < end
            if not left.all():
                one, partner, end = one[left], partner[left], end[left]
        if found:
            yield pd.DataFrame(np.concatenate(found), columns=["a", "b"]).drop_duplicates()

    return meet


def _candidates(heads: DataFrame, blobs: DataFrame | None, threshold: float) -> DataFrame:
    """(``a``, ``b``), a < b, each once: the pairs of classes, not of the same blob, that share a band key and may reach the threshold."""
    if blobs:
        heads = heads.join(blobs.hint("merge"), "rep", "left").withColumn("blob", F.coalesce("blob", F.lit(-1).cast("long")))
        heads = cut_lineage(heads)
    entry, n = _entry(bool(blobs)), heads.count()
    size = n * BANDS * entry.itemsize
    step = -(-BANDS // max(1, min(PASSES, -(-size // PASS_BYTES))))
    places = max(heads.sparkSession.sparkContext.defaultParallelism, size * step // BANDS // PLACE_BYTES)
    columns = ["rep", "n_words", *_SIGNATURE, "bands", *(["blob"] if blobs else [])]
    found = []
    for lo in range(0, BANDS, step):
        deal = _deal(range(lo, min(lo + step, BANDS)), places, entry)
        dealt = heads.select(*columns).mapInPandas(deal, "place int, entries binary").repartitionById(places, F.col("place"))
        found.append(cut_lineage(dealt.select("entries").mapInPandas(_meet(entry, threshold), "a long, b long")))
        del dealt
        if step < BANDS:
            free_unused(heads.sparkSession)
    return reduce(DataFrame.unionByName, found).distinct()


def _links(
    source: DataFrame,
    heads: DataFrame,
    threshold: float,
    as_pairs: bool,
) -> tuple[DataFrame, DataFrame | None]:
    """(``a``, ``b``, ``similarity``), a < b, each once: the linked pairs of classes outside blobs; and the links within blobs, as ``_blob_links`` gives them, or null."""
    blobs = _hot_blobs(heads)
    inside = cut_lineage(_blob_links(blobs, source, threshold, as_pairs)) if blobs else None
    candidates = cut_lineage(_candidates(heads, blobs, threshold))
    words = _word_sets_of(source, candidates.select(F.array("a", "b").alias("reps")))
    # Merge joins throughout: the planner sizes these tables by their sources and would broadcast them.
    for x in "ab":
        candidates = candidates.join(
            words.select(F.col("rep").alias(x), F.col("words").alias(f"words_{x}")).hint("merge"),
            x,
        )
    common = F.size(F.array_intersect("words_a", "words_b"))
    verified = candidates.select(
        "a",
        "b",
        (common / (F.size("words_a") + F.size("words_b") - common)).alias("similarity"),
    )
    return verified.where(F.col("similarity") >= threshold), inside


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """(``row_a``, ``row_b``, ``similarity``), row_a < row_b: every pair of rows at or over the threshold, copies included."""
    source = _source(df, key, text)
    members, heads = classes(source)
    free_unused(df.sparkSession)
    links, inside = _links(source, heads, threshold, as_pairs=True)
    # A class of several members is linked to itself, too: the pairs of its own members.
    several = members.where("key <> rep").select("rep").distinct()
    itself = several.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    every = reduce(DataFrame.unionByName, [links, itself, *([inside] if inside else [])])
    one, two = (members.select(F.col("rep").alias(r), F.col("key").alias(k)) for r, k in (("a", "k1"), ("b", "k2")))
    pairs = every.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where("a <> b or k1 < k2")
    return pairs.select(F.least("k1", "k2").alias("row_a"), F.greatest("k1", "k2").alias("row_b"), "similarity")


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """A row per text: (``row_no``, ``class_id``, ``group_id``, ``n_links``).

    ``class_id`` is the least row of the same word set, ``group_id`` the least row that chains of links reach, ``n_links`` the number
    of other classes linked to this one. Copies aren't expanded into pairs. Rows without words are their own group.
    """
    source = _source(df, key, text)
    members, heads = classes(source)
    free_unused(df.sparkSession)
    links, inside = _links(source, heads, threshold, as_pairs=False)
    links = cut_lineage(links)
    edges, counts = links.select(F.col("a").alias("src"), F.col("b").alias("dst")), links.select(
        F.explode(F.array("a", "b")).alias("rep"),
        F.lit(1).cast("long").alias("n_links"),
    )
    if inside:
        edges, counts = edges.unionByName(
            inside.select(F.col("rep").alias("src"), F.col("to").alias("dst"))
        ), counts.unionByName(inside.select("rep", "n_links"))
    groups = connected_components(edges)
    counts = counts.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    known = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    every = df.select(F.col(key).cast("long").alias("row_no")).where("row_no is not null").distinct()
    return every.join(known.withColumnRenamed("key", "row_no"), "row_no", "left").select(
        "row_no",
        F.coalesce("rep", "row_no").alias("class_id"),
        F.coalesce("component", "rep", "row_no").alias("group_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
