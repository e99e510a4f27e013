"""Duplicates, leakage and outliers over a whole dataset."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vocalith.operators.ranges import ranged, running
from vocalith.plans.scratch import drop, materialize


def exact_payload(rows: DataFrame, payload: str, speaker: str, order: str = "id") -> DataFrame:
    """``rows`` with ``dup``: null for the first row of a payload; later ones say whether the speaker is the first's."""
    w = Window.partitionBy(payload).orderBy(order)
    first = F.first(speaker).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("dup", F.when(F.row_number().over(w) > 1, F.when(first == F.col(speaker), "duplicate_audio").otherwise("speaker_leak_audio")))


def exact_text(rows: DataFrame, speaker: str, key: str, order: str = "id") -> DataFrame:
    """``rows`` with ``dup`` for all but the first row of a speaker's text."""
    w = Window.partitionBy(speaker, key).orderBy(order)
    return rows.withColumn("dup", F.when(F.row_number().over(w) > 1, "duplicate_text"))


def shared_keys(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys of two or more owners."""
    return rows.groupBy(key).agg(F.countDistinct(owner).alias("n")).where("n > 1")


def cross_speaker(rows: DataFrame, speaker: str, key: str, order: str = "id") -> DataFrame:
    """``rows`` with ``dup`` where another speaker used the text first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("dup", F.when(F.first(speaker).over(w) != F.col(speaker), "speaker_leak_text"))


def keep_first(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of ``pairs`` (a < b) with ``kept``: the lexicographically first maximal independent set.

    A node stays if no smaller neighbour stays. Rounds decide all nodes without an undecided or kept smaller neighbour, then
    drop the neighbours of what is kept; each round is written, and only the number of open nodes reaches the driver.
    """
    edges = materialize(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a < b").distinct(), "pairs")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    state = materialize(nodes.withColumn("kept", F.lit(None).cast("boolean")), "state")
    while state.where("kept is null").limit(1).count():
        below = edges.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy("b").agg(
            F.coalesce(F.bool_or(F.coalesce("ka", F.lit(True))), F.lit(False)).alias("blocked")).withColumnRenamed("b", "id")
        kept = state.join(below, "id", "left").select("id", F.when(F.col("kept").isNull() & ~F.coalesce("blocked", F.lit(False)), True).otherwise(F.col("kept")).alias("kept"))
        hit = edges.join(kept.where("kept").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("hit", F.lit(True))
        state = materialize(kept.join(hit, "id", "left").select("id", F.when(F.col("kept").isNull() & F.col("hit").isNotNull(), False).otherwise(F.col("kept")).alias("kept")), "state", state)
    return state


def centre(rows: DataFrame, vector: str) -> list[float]:
    """Mean vector: sums by place, a row a place on the driver."""
    sums = rows.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("k").collect()
    return [r.m for r in sums]


def near_vectors(rows: DataFrame, id_col: str, vector: str, least: float = 0.97, duration: str | None = None, tolerance: float = 0.1, speaker: str | None = None, bits: int = 20, tables: int = 60) -> DataFrame:
    """Pairs a < b of rows whose centred, normalised vectors have a cosine of at least ``least`` and durations within a tolerance of the
    longer, with ``cosine`` and, where ``speaker`` is named, ``reason`` by whether it is the same.

    Rows meet in a table of random hyperplanes if they lie on the same side of ``bits`` of them. Vectors with a cosine of 0.97 do so in none of 60 tables
    twice in a million; unrelated ones in one in 20,000. A table's key also holds the class of the duration, of a width such that durations within
    the tolerance are at most one class apart. Cosines of pairs that meet are exact. Null vectors and durations have no pair.
    """
    mean = centre(rows, vector)
    kind = dict(rows.dtypes)[id_col]
    if not mean:
        return rows.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cosine double" + ", reason string" * bool(speaker))
    planes = np.random.default_rng(5).normal(size=(len(mean), bits * tables))
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("struct<unit:array<double>,keys:array<long>>")
    def placed(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float) - mean
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        keys = (x @ planes > 0).reshape(-1, tables, bits) @ weights + (np.arange(tables, dtype=np.int64) << bits)
        return pd.DataFrame({"unit": list(x), "keys": list(keys)})

    length = F.col(duration).cast("double") if duration else F.lit(1.0)
    who = F.col(speaker) if speaker else F.lit(None)
    base = rows.where(F.col(vector).isNotNull() & length.isNotNull()).select(F.col(id_col).alias("id"), length.alias("dur"), who.alias("who"), placed(vector).alias("p"))
    u = materialize(base.select("id", "dur", "who", "p.*"), "units")
    filed = u.select("id", "dur", _duration_class("dur", tolerance).alias("cls"), F.explode("keys").alias("key"))
    met = _same_file(filed, ["key"], tolerance)
    side = lambda x: u.select(F.col("id").alias(x), F.col("unit").alias(f"u{x}"), F.col("who").alias(f"w{x}"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    found = met.join(side("a"), "a").join(side("b"), "b").withColumn("cosine", dot).where(F.col("cosine") >= least)
    reason = F.when(F.col("wa") == F.col("wb"), "near_duplicate_audio").otherwise("speaker_leak_audio").alias("reason")
    return found.select("a", "b", "cosine", *([reason] if speaker else []))


def _duration_class(duration: str, tolerance: float):
    """Class of a duration: those within the tolerance of the longer are at most one class apart. Durations of zero or less are one class."""
    return F.when(F.col(duration) > 0, F.floor(F.log(F.col(duration)) / float(-np.log(1 - tolerance)))).otherwise(-(1 << 20)).cast("int")


def _same_file(filed: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Distinct pairs a < b of ids of ``filed`` (id, dur, cls and ``by``) that share a file and are near in duration."""
    a, b = filed.alias("a"), filed.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1))).alias("b")
    on = (F.col("a.cls") == F.col("b.cls")) & (F.col("a.id") < F.col("b.id"))
    for c in by:
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    on &= F.abs(F.col("a.dur") - F.col("b.dur")) <= tolerance * F.greatest("a.dur", "b.dur")
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


#: Classes of duration in one file of ``_met_once``: one row in so many, and so many below, is filed twice.
CLASSES = 8


def _met_once(filed: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """The pairs of ``_same_file`` with a row in one file, or in two at the edge of ``CLASSES`` classes, in place of four; both sides of the join are one
    shuffled table, as what tells them apart is asked of pairs."""
    own = F.floor(F.col("cls") / CLASSES).cast("int")
    files = F.array(own, F.floor((F.col("cls") - 1) / CLASSES).cast("int"), F.floor((F.col("cls") + 1) / CLASSES).cast("int"))
    rows = filed.select("id", "dur", own.alias("own"), F.xxhash64(*by).alias("key"), *by[:1], F.explode(F.array_distinct(files)).alias("file"))
    rows = rows.select("id", "dur", *by[:1], (F.col("own") == F.col("file")).alias("own"), F.xxhash64("key", "file").alias("key"))
    a, b = rows.alias("a"), rows.alias("b")
    near = F.abs(F.col("a.dur") - F.col("b.dur")) <= tolerance * F.greatest("a.dur", "b.dur")
    on = (F.col("a.key") == F.col("b.key")) & (F.col(f"a.{by[0]}") == F.col(f"b.{by[0]}")) & F.when(F.col("a.id") < F.col("b.id"), (F.col("a.own") | F.col("b.own")) & near).otherwise(False)
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _trigrams(text: str) -> list[str]:
    t = f"  {text} "
    return [t[k : k + 3] for k in range(len(t) - 2)]


#: CRC32 of each byte, and trigrams that are hashed at once, of so many rows.
_CRC = np.array([functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 * (c & 1)), range(8), k) for k in range(256)], np.uint32)
TRIGRAMS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 256


def _trigram_table(texts: list[bytes], dim: int) -> np.ndarray:
    """A row a text (UTF-8) with the number of its trigrams by CRC32 modulo ``dim``."""
    padded = [b"  " + t + b" " for t in texts]
    raw = np.frombuffer(b"".join(padded), np.uint8)
    at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # where code points begin
    ends = np.searchsorted(at, np.cumsum([len(t) for t in padded]))
    first = np.ones(len(at) - 1, bool)
    first[ends - 1] = first[ends - 2] = False
    first = np.flatnonzero(first)
    out = np.zeros(len(texts) * dim, np.int64)
    for low in range(0, len(first), TRIGRAMS_AT_ONCE):
        k = first[low : low + TRIGRAMS_AT_ONCE]
        begin, size, crc = at[k], at[k + 3] - at[k], np.full(len(k), 0xFFFFFFFF, np.uint32)
        for j in range(size.max()):
            on = slice(None) if j < 3 else np.flatnonzero(size > j)
            crc[on] = _CRC[(crc[on] ^ raw[begin[on] + j]) & 0xFF] ^ (crc[on] >> 8)
        out += np.bincount(np.searchsorted(ends, k, "right") * dim + (~crc % dim).astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), dim)


def trigram_counts(rows: DataFrame, id_col: str, text: str, dim: int = 1024) -> DataFrame:
    """Per id (unique) a map ``vector`` from place to count of hashed trigrams; the hash is CRC32 of a trigram's UTF-8. Null texts have none.

    A text's trigrams are counted where it lies: none becomes a row.
    """
    @F.arrow_udf("map<int,int>")
    def counted(texts: pa.Array) -> pa.Array:
        every = texts.to_pylist()
        keys, values, sizes = [], [], []
        for low in range(0, len(every), ROWS_AT_ONCE):
            some = every[low : low + ROWS_AT_ONCE]
            table = _trigram_table([(t or "").encode() for t in some], dim)
            table[[k for k, t in enumerate(some) if t is None]] = 0
            row, place = np.nonzero(table)
            keys.append(place)
            values.append(table[row, place])
            sizes.append(np.bincount(row, minlength=len(some)))
        offsets = np.concatenate([[0], *sizes]).cumsum()
        void = np.array([t is None for t in every] + [False])
        flat = lambda x: pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int32))
        return pa.MapArray.from_arrays(pa.array(offsets.astype(np.int32), mask=void), flat(keys), flat(values))

    return rows.select(id_col, counted(text).alias("vector"))


#: Bands that are shuffled at once, of all rows; all bands at once where there are few rows.
BANDS_A_PASS, FEW_BANDS = 5, 2_000_000
#: Longs that hold the letter counts of a text, in 7 places of a byte, each 127 at most.
LETTER_LONGS = 2
#: Characters of texts, pieces of texts, trigrams of a piece and pairs that are taken at once; the largest cube of an alphabet that is a table.
CHARS_AT_ONCE, PIECES_AT_ONCE, PIECE, PAIRS_AT_ONCE, CUBE = 1 << 20, 1_024, 256, 1 << 19, 1 << 22


def _parts(texts: list[str]):
    """Slices of ``texts`` of about ``CHARS_AT_ONCE`` characters."""
    low = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars > CHARS_AT_ONCE:
            yield texts[low : k + 1]
            low, chars = k + 1, 0
    if low < len(texts):
        yield texts[low:]


def _grams(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams (21 bits a code point) of texts of ``sizes`` code points, which follow each other in ``codes``; the number of each trigram in its place."""
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    place, n = np.zeros(len(seen), np.int64), len(letters)
    place[letters] = np.arange(n)
    c, inside = place[codes], np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    g = ((c[:-2] * n + c[1:-1]) * n + c[2:])[inside[:-2]]
    if n**3 <= CUBE:
        there = np.zeros(n**3, bool)
        there[g] = True
        known, number = np.flatnonzero(there), np.zeros(n**3, np.int32)
        number[known] = np.arange(len(known))
        at = number[g]
    else:
        known, at = np.unique(g, return_inverse=True)
    letters = letters.astype(np.uint64)
    return (letters[known // (n * n)] << np.uint64(42)) + (letters[known // n % n] << np.uint64(21)) + letters[known % n], at


def _lowest(table: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The minimum by column of each text's rows of ``table``; ``at`` names them, ``sizes`` a text, one at least. Long texts go in pieces."""
    pieces = -(-sizes // PIECE)
    first = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + inner * PIECE
    last = np.minimum(np.repeat(sizes, pieces) - inner * PIECE, PIECE) - 1
    out, order = np.empty((len(starts), table.shape[1]), table.dtype), np.argsort(last, kind="stable")
    for low in range(0, len(order), PIECES_AT_ONCE):
        k = order[low : low + PIECES_AT_ONCE]
        places = at[starts[k] + np.minimum(np.arange(last[k[-1]] + 1)[:, None], last[k])]
        least = table[places[0]]
        for row in places[1:]:
            np.minimum(least, table.take(row, axis=0), out=least)
        out[k] = least
    return np.minimum.reduceat(out, first, axis=0)


def _banded(mult: np.ndarray, add: np.ndarray, size: int):
    """Of texts: their minimum hashes in bands of ``size``, a long a band, their length, and counts of their letters in ``LETTER_LONGS`` longs."""
    odd = np.random.default_rng(12).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    names, places, bands = [f"l{k}" for k in range(LETTER_LONGS)], 7 * LETTER_LONGS, len(mult) // size

    def part(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        padded = [f"  {t} " for t in texts]
        codes, sizes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, padded), np.int64, len(padded))
        grams, at = _grams(codes, sizes)
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        low = _lowest(((grams[:, None] * mult + add) >> np.uint64(32)).astype(np.uint32), at, sizes - 2)
        band = (low.reshape(len(texts), bands, size) * odd).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
        counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * places + codes % places, minlength=len(texts) * places)
        packed = np.zeros((len(texts), LETTER_LONGS, 8), np.uint8)
        packed[:, :, :7] = np.minimum(counts, 127).reshape(len(texts), LETTER_LONGS, 7)
        return band.view(np.int64), sizes - 3, packed.view("<i8")[:, :, 0]

    @F.arrow_udf(f"struct<size:int,{','.join(f'{x}:long' for x in names)},bands:array<long>>")
    def banded(texts: pa.Array) -> pa.Array:
        got = [part(t) for t in _parts(texts.to_pylist())] or [(np.empty((0, bands), np.int64), np.empty(0, np.int64), np.empty((0, LETTER_LONGS), np.int64))]
        band, sizes, letters = (np.concatenate(x) for x in zip(*got, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands, pa.int32()), pa.array(band.ravel()))
        return pa.StructArray.from_arrays([pa.array(sizes.astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in letters.T), lists], ["size", *names, "bands"])

    return banded.asNondeterministic()  # else Spark runs it again for filters that it infers


def _in_common(size: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Letters that texts of ``size``, with counts ``a``, have in common with others at most: bytes for several letters, and counts that end at 127, only
    raise it. Bytes are taken from each other side by side: where ``a`` has as many or more, the byte's highest bit, set before, still is."""
    ones, high, even = (np.uint64(x) for x in (0x01010101010101, 0x80808080808080, 0x00FF00FF00FF00FF))
    sums = np.zeros(len(size), np.uint64)
    for x, y in zip(a, b, strict=True):
        left = (x | high) - y
        on = (left >> np.uint64(7)) & ones
        left &= (on << np.uint64(7)) - on
        sums += (left & even) + ((left >> np.uint64(8)) & even)
    sums += sums >> np.uint64(32)
    return size - ((sums + (sums >> np.uint64(16))) & np.uint64(0xFFFF)).astype(np.int64)


def _close(t: pa.Table, new: int, least: float, tolerance: float):
    """Places i < j, ``new`` <= j, of rows of ``t`` (sorted by ``key`` and ``dur``) of one key, with durations within the tolerance of the longer and letters
    in common that let a matching-blocks ratio, twice what matches by both lengths, be ``least``; some at a time."""
    key, dur, size = (t[x].to_numpy() for x in ("key", "dur", "size"))
    size, letters = size.astype(np.int64), [t[f"l{k}"].to_numpy().view(np.uint64) for k in range(LETTER_LONGS)]
    values, rank = np.unique(dur, return_inverse=True)
    cell = np.cumsum(np.append(False, key[1:] != key[:-1])) * (len(values) + 1)
    start = np.searchsorted(cell + rank, cell + np.searchsorted(values, dur - tolerance * dur - 1e-9 * np.abs(dur)))
    count = np.maximum(np.arange(len(t)) - start, 0)
    count[:new] = 0
    upto = np.cumsum(count)
    low = new
    while low < len(t):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - count[low] + PAIRS_AT_ONCE, "right")))
        n = count[low:high]
        j = np.repeat(np.arange(low, high), n)
        i = np.arange(len(j)) + np.repeat(start[low:high] - (np.cumsum(n) - n), n)
        for test in (lambda i, j: np.abs(dur[i] - dur[j]) <= tolerance * np.maximum(dur[i], dur[j]), lambda i, j: 2 * np.minimum(size[i], size[j]) >= (least - 1e-9) * (size[i] + size[j]), lambda i, j: 2 * _in_common(size[i], [x[i] for x in letters], [x[j] for x in letters]) >= (least - 1e-9) * (size[i] + size[j])):
            ok = test(i, j)
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j
        low = high


def _windows(batches, tolerance: float):
    """Tables of rows sorted by ``key`` and ``dur``, with the number of rows that the one before held already: those that a later row may be near to."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]).combine_chunks() if kept is not None and len(kept) else t
        yield t, len(t) - batch.num_rows
        key, dur = t["key"].to_numpy(), t["dur"].to_numpy()
        kept = t.slice(int(np.argmax((key == key[-1]) & (dur >= dur[-1] - tolerance * np.abs(dur[-1]) - 1e-9 * np.abs(dur[-1])))))


def _with_partner(least: float, tolerance: float):
    """Of batches of rows sorted by ``key`` and ``dur``, the rows of a pair of ``_close``, once or twice."""
    def run(batches):
        for t, new in _windows(batches, tolerance):
            there = np.zeros(len(t), bool)
            for i, j in _close(t, new, least, tolerance):
                there[i] = there[j] = True
            yield from t.filter(pa.array(there)).to_batches()

    return run


def _near_counts(least: float, tolerance: float, cosine: float, dim: int = 1024):
    """Of batches of rows sorted by ``key`` and ``dur``, ids of the pairs of ``_close`` of one speaker whose hashed trigram counts have a cosine of ``cosine``."""
    def run(batches):
        for t, new in _windows(batches, tolerance):
            speaker, texts = (np.array(t[x].to_pylist(), object) for x in ("sp", "text"))
            for i, j in _close(t, new, least, tolerance):
                ok = (speaker[i] == speaker[j]) & (texts[i] != texts[j])
                i, j = i[ok], j[ok]
                near = np.empty(len(i), bool)
                for low in range(0, len(i), ROWS_AT_ONCE):
                    some = slice(low, low + ROWS_AT_ONCE)
                    rows, at = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
                    table, (a, b) = _trigram_table([x.encode() for x in texts[rows]], dim), at.reshape(2, -1)
                    norm = np.sqrt((table * table).sum(axis=1))
                    near[some] = np.einsum("ij,ij->i", table[a], table[b]) >= cosine * norm[a] * norm[b]
                yield pa.RecordBatch.from_arrays([t["id"].take(pa.array(x[near])).combine_chunks() for x in (i, j)], ["x", "y"])

    return run


def near_texts(rows: DataFrame, id_col: str, speaker: str, key: str, duration: str, least: float = 0.92, cosine: float = 0.8, tolerance: float = 0.1, bands: int = 40, size: int = 5) -> DataFrame:
    """Pairs a < b of one speaker's rows with near equal texts: durations within a tolerance, different keys, hashed trigram counts
    of a cosine of at least ``cosine``, and a matching-blocks ratio of at least ``least``.

    Rows meet that share a speaker and a band of minimum hashes over their trigrams. Sets of trigrams with a similarity of 0.7, low for such a
    ratio, share one of 40 bands of 5 but for 6 in 1,000. Null keys, speakers and durations have no pair.

    Most rows that share a band are not alike, and their pairs grow with the square of the rows. So none is written: rows are sorted by band and duration,
    each is held against those before it within the tolerance, by counts of letters, which lose no pair, and only rows that still have a partner
    get their texts. Both scores are computed over whole texts. Bands are shuffled ``BANDS_A_PASS`` at once; a pass leaves pairs of near
    counts. ``rows`` that are written already are not written again.
    """
    from difflib import SequenceMatcher

    rng = np.random.default_rng(11)
    mult, add = (rng.integers(1, 1 << 63, bands * size, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (SequenceMatcher(None, a, b) for a, b in zip(x, y, strict=True))
        return pd.Series([m.quick_ratio() >= least and m.ratio() >= least for m in both], dtype=bool)

    base = rows.select(F.col(id_col).alias("id"), F.col(speaker).alias("sp"), F.col(key).alias("text"), F.col(duration).cast("double").alias("dur")).dropna()
    own = None if getattr(rows, "scratch_path", None) else (base := materialize(base, "texts", lean=True))
    step, found = bands if base.count() * bands <= FEW_BANDS else BANDS_A_PASS, None
    kind, letters = dict(base.dtypes)["id"], [f"l{k}" for k in range(LETTER_LONGS)]
    sorted_ = lambda df: df.repartition("key").sortWithinPartitions("key", "dur")
    for low in range(0, bands, step):
        some = slice(low * size, (low + step) * size)
        placed = base.select("id", "sp", "dur", _banded(mult[some], add[some], size)("text").alias("p")).select("id", "sp", "dur", "p.size", *[f"p.{x}" for x in letters], F.explode("p.bands").alias("band"))
        filed = sorted_(placed.select("id", "dur", "size", *letters, F.xxhash64("sp", "band").alias("key")))
        kept = materialize(filed.mapInArrow(_with_partner(least, tolerance), filed.schema).distinct(), "met", lean=True)
        texts = sorted_(kept.join(base.select("id", "sp", "text"), "id"))
        met = texts.mapInArrow(_near_counts(least, tolerance, cosine), f"x {kind}, y {kind}").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        found = materialize((met.union(found) if found else met).distinct(), "pairs", found, lean=True)
        drop(kept)
    side = lambda x: base.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    out = materialize(found.join(side("a"), "a").join(side("b"), "b").where(alike("ta", "tb")).select("a", "b"), "near", found, lean=True)
    drop(own)
    return out


#: Values that one range holds while a median is sought.
COUNTS_A_RANGE = 500_000


def _medians(counts: DataFrame, name: str) -> DataFrame:
    """Exact median by ``by`` of ``counts`` (by, value, n; written already). Running sums go over ranges of the values, so that no task holds a group."""
    total = counts.groupBy("by").agg(F.sum("n").alias("_n"))
    upto = running(ranged(counts, "by", ["value"], COUNTS_A_RANGE), "by", ["value"], sums={"_upto": F.col("n")})
    at = lambda rank: F.min_by("value", F.when(F.col("_upto") >= F.expr(rank), F.col("_upto")))
    mids = upto.join(F.broadcast(total), "by").groupBy("by").agg(F.max("_n").alias("n"), at("(_n + 1) div 2").alias("lo"), at("_n div 2 + 1").alias("hi"))
    return mids.select("by", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0.5 * F.col("lo") + 0.5 * F.col("hi")).alias(name))


def condition_outliers(rows: DataFrame, group: list[str], floors: dict[str, float], z: float = 4.0, least: int = 20) -> DataFrame:
    """Rows (id, feature) whose robust z-score within their group is beyond ``z``; groups of fewer rows are left out.

    Both medians come from one count of values by group; rows are read once more, to be scored.
    """
    long = rows.unpivot(["id", *group], list(floors), "feature", "value").where("value is not null")
    by = [*group, "feature"]
    named = long.dropna(subset=group).select(F.struct(*by).alias("by"), F.col("value").cast("double").alias("value"))
    counts = materialize(named.groupBy("by", "value").agg(F.count("*").alias("n")), "counts")
    mids = materialize(_medians(counts, "med").where(F.col("n") >= least).select("by", "med"), "medians")
    gaps = counts.join(F.broadcast(mids), "by").groupBy("by", F.abs(F.col("value") - F.col("med")).alias("value")).agg(F.sum("n").alias("n"))
    both = mids.join(_medians(materialize(gaps, "gaps"), "mad"), "by").select("by.*", "med", "mad")
    floor = F.element_at(F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("feature"))
    score = (F.col("value") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), floor)
    return long.join(F.broadcast(both), by).where(F.abs(score) > z).select("id", F.concat(F.lit("condition_outlier_"), "feature").alias("reason"))


def ngrams(words, n: int = 5):
    """Runs of ``n`` words of an array, joined by spaces; none for fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


#: Windows of the evaluation side that are broadcast; beyond it all of the training side's are shuffled.
BROADCAST_GRAMS = 500_000


def overlap(evals: DataFrame, train: DataFrame, n: int = 5, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """Per row of ``evals`` (id, words) that is in ``train`` (line, words): ``exact`` or ``ngram``, and the first line.

    The training side's texts and windows are looked up among those of the evaluation side, broadcast sets, in one scan and before they become rows: as many
    rows are written as there are hits. Beyond ``limit`` windows or texts all of them are shuffled, with equal results.
    """
    whole = F.array_join("words", " ")
    e = evals.select("id", whole.alias("t"), ngrams(F.col("words"), n).alias("g"))
    texts = e.select("t").distinct()
    grams = materialize(e.select("id", F.explode("g").alias("g")).distinct(), "grams")
    if grams.count() <= limit and texts.count() <= limit:
        known = frozenset(r.g for r in grams.select("g").distinct().collect())  # ``limit`` strings at most
        exact_texts = frozenset(r.t for r in texts.where("t is not null").collect())  # as many, with no more words than the windows have, and four each

        @F.pandas_udf("struct<exact:boolean,g:array<string>>")
        def hits(train_texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in train_texts:
                w = t.split(" ") if t is not None else []
                out.append((t in exact_texts, list({g for g in map(" ".join, zip(*(w[k:] for k in range(n)))) if g in known})))
            return pd.DataFrame(out, columns=["exact", "g"])

        looked = train.select("line", whole.alias("t")).withColumn("h", hits("t")).where("h.exact or size(h.g) > 0")
        found = materialize(looked.select("line", F.when(F.col("h.exact"), F.col("t")).alias("t"), F.col("h.g").alias("g")), "hits")
        same, met = found.where("t is not null").select("t", "line"), found.select("line", F.explode("g").alias("g"))
    else:
        same = train.select(whole.alias("t"), "line").join(texts, "t", "left_semi")
        met = train.select("line", F.explode(ngrams(F.col("words"), n)).alias("g"))
    exact = e.join(same, "t").groupBy("id").agg(F.min("line").alias("line")).withColumn("kind", F.lit("exact"))
    hit = met.join(grams, "g").groupBy("id").agg(F.min("line").alias("line"))
    return exact.unionByName(hit.join(exact.select("id"), "id", "left_anti").withColumn("kind", F.lit("ngram")))


def merge_corpus(base: DataFrame, new: DataFrame, norm: str, order: str, prefix: str) -> DataFrame:
    """New rows whose norm is neither in the base nor in an earlier new row, numbered within their prefix: ``p-001``."""
    fresh = new.join(base.select(norm).distinct(), norm, "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(norm).orderBy(order))).where("_r = 1").drop("_r")
    number = F.row_number().over(Window.partitionBy(prefix).orderBy(order))
    return first.withColumn("new_id", F.concat_ws("-", prefix, F.lpad(number.cast("string"), 3, "0")))


def repeat_rate(rows: DataFrame, *unit: str) -> DataFrame:
    """One row: rows, distinct units and the share that recurs."""
    each = rows.groupBy(*unit).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("n"), F.count("*").alias("n_units")).withColumn("rate", 1 - F.col("n_units") / F.col("n"))
