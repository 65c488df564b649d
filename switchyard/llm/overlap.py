"""Same or near-same records across splits (problem 2): bit fingerprints and segmented code blocks.

Texts are compared by letters and digits, without case and look-alike differences. A pair overlaps if at
most a tenth of the longer text's characters must be inserted, deleted or replaced.

The code of a text is the sequence of its hashed characters; its bit fingerprint sets a bit for each bigram
on either side of a block, so that an edit flips at most 4 bits of its side: texts within k edits that agree
in a block lie within Hamming radii of 4i on the left and 4 (k - i) on the right for some i, always. The code of a training text is cut into kmax + 1 disjoint
blocks, kmax being the most edits any partner may need; with k <= kmax edits at least one block stays
whole (pigeonhole) and stands in the other text at most k places away. Which blocks is free: they are
chosen by dynamic programming over SIZES, so that they meet as few evaluation texts as can be (rare
stretches are cut short, common ones long). Blocks are joined across splits, with place, length and the
Hamming radius tested within the join; what passes is verified by its edit distance. No true pair can be
lost and no bucket is capped. The sign-of-sums fingerprint that the method is usually built on gives no
such guarantee, and blocks cut from the bits of the fingerprint itself select nothing at these radii: see
the README for figures.

Three tables of a fixed size go to the executors: how often the windows of the evaluation texts occur, by
hash bucket, which only guides the choice of blocks; a bitmap of the blocks chosen, so that only windows
that may meet one become rows; and one of these windows, for the blocks. Their size is bounded by COUNTERS
and BITS; collisions in them cost time and never change the result.

Equal texts are one class, so copies are not compared; the result is expanded to records at the end.

Defined cases: null texts, and texts without a letter or digit, take no part; texts of under 10
characters must be equal; whole texts are used, of any length; repeated records are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.confusables import letters_and_digits_column
from switchyard.session import materialize

#: Edits allowed are len(longer) // TENTH.
TENTH = 10
#: Lengths that a block may have.
SIZES = (4, 6, 8, 12, 16, 24)
#: Hash buckets in which windows are counted, and bits of the map of chosen blocks.
COUNTERS, BITS = 1 << 20, 1 << 26
#: Blocks that are chosen together; longer texts are cut at even places first.
TOGETHER = 8
#: Words of 64 bits on either side of a block, and their columns.
SIDE_WORDS = 4
WORDS = tuple(f"w{i}" for i in range(2 * SIDE_WORDS))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.random.default_rng(7).integers(1, 1 << 62, max(SIZES), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def most_edits(length):
    """Most edits that a pair with a text of this length may have: its partner is at most 10/9 as long."""
    return length // (TENTH - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Codes:
    """The texts of a batch as one array of code points, with the hashes of all their windows."""

    def __init__(self, texts: list[str]) -> None:
        self.length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), self.length)
        self.place = np.arange(len(self.cp)) - self.start[:-1][self.owner]
        self.left = self.length[self.owner] - self.place  # characters from here to the end of the text

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Size and, for each place, the hash of the window that begins there (of no meaning where left < size)."""
        h = np.zeros(len(self.cp), dtype=np.uint64)
        for j in range(max(SIZES)):
            h[: len(h) - j] += self.cp[j:] * _ODD[j]
            if j + 1 in SIZES:
                yield j + 1, _mixed(h + np.uint64(j + 1))

    def sides(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For blocks from begin to end in the array, in order of begin, the words of the two sides of their text."""
        owner = self.owner[begin]
        a, z = self.start[:-1][owner], self.start[1:][owner]
        pairs = _one_hot(_mixed(self.cp * _ODD[1] + np.r_[self.cp[1:], np.zeros(1, dtype=np.uint64)]), SIDE_WORDS)
        return np.stack([*(_ored(w, a, begin - 1) for w in pairs), *(_ored(w, end, z - 1) for w in pairs)], axis=1)


def _one_hot(h: np.ndarray, words: int) -> list[np.ndarray]:
    """The bit of each hash, in the word that it falls into."""
    bit, word = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(words)
    return [np.where(word == np.uint64(w), bit, np.uint64(0)) for w in range(words)]


def _ored(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits of words[begin:end] together, for each range; none where it is empty."""
    padded, some = np.r_[words, np.zeros(1, dtype=np.uint64)], end > begin
    got = np.bitwise_or.reduceat(padded, np.stack([begin, np.maximum(begin, end)], axis=1).ravel())[::2] if len(begin) else np.zeros(0, dtype=np.uint64)
    return np.where(some, got, np.uint64(0))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h & np.uint64(buckets - 1)).astype(np.int64)


def window_counts(texts: list[str], counters: int = COUNTERS) -> np.ndarray:
    codes, out = Codes(texts), np.zeros(counters, dtype=np.int64)
    for size, h in codes.windows():
        out += np.bincount(_bucket(h[codes.left >= size], counters), minlength=counters)
    return out


def _stretches(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin, length and number of blocks of the stretches, of up to TOGETHER blocks, that texts are cut into."""
    blocks = most_edits(length) + 1
    parts = -(-blocks // TOGETHER)
    text = np.repeat(np.arange(len(length)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, last = blocks[text] * nth // parts[text], blocks[text] * (nth + 1) // parts[text]
    begin, end = length[text] * first // blocks[text], length[text] * last // blocks[text]
    return text, begin, end - begin, last - first


def chosen_blocks(codes: Codes, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place, hash and size of the kmax + 1 disjoint blocks of each text (of 9 characters or more) that meet the fewest windows.

    best[j, p] is the least sum of counts of j blocks within the first p characters of a stretch.
    """
    hashes = dict(codes.windows())
    cost = {s: counts[_bucket(h, len(counts))].astype(np.float64) for s, h in hashes.items()}
    text, begin, size, number = _stretches(codes.length)
    at = codes.start[:-1][text] + begin
    out: list[tuple[np.ndarray, ...]] = []
    for m in np.unique(number):
        rows = np.flatnonzero(number == m)
        width = int(size[rows].max())
        places = np.arange(width)
        flat = np.minimum(at[rows, None] + places, len(codes.cp) - 1)
        fits = size[rows, None] - places
        price = {s: np.where(fits >= s, cost[s][flat], np.inf) for s in SIZES if s <= width}
        best = np.zeros((len(rows), width + 1))
        choice, reach = [], []
        for _ in range(m):
            found, used = np.full((len(rows), width + 1), np.inf), np.zeros((len(rows), width + 1), dtype=np.int64)
            for s, p in price.items():
                value = best[:, : width + 1 - s] + p[:, : width + 1 - s]
                better = value < found[:, s:]
                found[:, s:] = np.where(better, value, found[:, s:])
                used[:, s:] = np.where(better, s, used[:, s:])
            best = np.minimum.accumulate(found, axis=1)
            fresh = np.ones(found.shape, dtype=bool)
            fresh[:, 1:] = best[:, 1:] < best[:, :-1]
            choice.append(used)
            reach.append(np.maximum.accumulate(np.where(fresh, np.arange(width + 1), 0), axis=1))
        end, line = np.full(len(rows), width), np.arange(len(rows))
        for used, to in zip(reversed(choice), reversed(reach)):
            end = to[line, end]
            s = used[line, end]
            end = end - s
            where = at[rows] + end
            h = np.zeros(len(rows), dtype=np.uint64)
            for k in np.unique(s):
                h[s == k] = hashes[k][where[s == k]]
            out.append((text[rows], codes.place[where], h, s))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bit_set(bit: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _marked(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether both bits of a hash are set: that of its low half, and, looked at where it is, that of its high half."""
    mask = np.uint64(8 * len(bitmap) - 1)
    out = _bit_set(h & mask, bitmap)
    at = np.flatnonzero(out)
    out[at] = _bit_set((h[at] >> np.uint64(32)) & mask, bitmap)
    return out


def met_windows(codes: Codes, bitmap: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place, hash and size of the windows whose bit is set."""
    out = []
    for size, h in codes.windows():
        at = np.flatnonzero(_marked(h, bitmap) & (codes.left >= size))
        out.append((codes.owner[at], codes.place[at], h[at], np.full(len(at), size)))
    return tuple(np.concatenate(x) for x in zip(*out))


_SCHEMA = "rep bigint, block bigint, lo int, hi int, len int, " + ", ".join(f"{w} bigint" for w in WORDS)


def _rows(reps: np.ndarray, codes: Codes, owner: np.ndarray, place: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of _SCHEMA. A block that occurs repeatedly in its text is one row for the range of its places; it
    has no sides, which is told by lo < hi, and is tested without them."""
    order = np.lexsort((place, h, owner))
    owner, place, h, size = owner[order], place[order], h[order], size[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], len(h)] - 1 if len(first) else first
    order = np.lexsort((place[first], owner[first]))
    first, last = first[order], last[order]
    of, begin = owner[first], codes.start[:-1][owner[first]] + place[first]
    words = codes.sides(begin, begin + size[first])
    columns = [reps[of], h[first].view(np.int64), place[first].astype(np.int32), place[last].astype(np.int32), codes.length[of].astype(np.int32), *words.view(np.int64).T]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "block", "lo", "hi", "len", *WORDS])


#: Characters that are worked on as one array; a longer text is one by itself.
_AT_ONCE = 250_000


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for batch in batches:
        reps, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        part = np.cumsum([len(t) for t in texts]) // _AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                yield reps[i:j], texts[i:j]


_BLOCK = np.dtype([("hash", "<u8"), ("place", "<i4"), ("size", "u1")])


def with_blocks(classes: DataFrame, counts: Broadcast) -> DataFrame:
    """classes (key, rep, form) with `blocks`: those chosen of each text, as _BLOCK in binary; none for texts below 9 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, dtype=np.float32)
        for batch in batches:
            out = [b""] * batch.num_rows
            for rows, texts in _batches([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2)], names=["row", "form"])]):
                long = [i for i, t in enumerate(texts) if len(t) >= TENTH - 1]
                if not long:
                    continue
                owner, place, h, size = chosen_blocks(Codes([texts[i] for i in long]), table)
                order = np.argsort(owner, kind="stable")
                packed = np.empty(len(owner), dtype=_BLOCK)
                packed["hash"], packed["place"], packed["size"] = h[order], place[order], size[order]
                cuts = np.searchsorted(owner[order], np.arange(len(long) + 1))
                for n, i in enumerate(long):
                    out[rows[i]] = packed[cuts[n] : cuts[n + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["key", "rep", "form", "blocks"])

    return classes.select("key", "rep", "form").mapInArrow(run, "key binary, rep bigint, form string, blocks binary")


def _block_hashes(b: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=_BLOCK)["hash"]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hashes).view(np.int64))], names=["block"])

    return b.select("blocks").mapInArrow(run, "block bigint")


def _indexed(b: DataFrame, sought: Broadcast) -> DataFrame:
    """Rows of _SCHEMA of the blocks that some window may meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sought.value, dtype=np.uint8)
        for batch in batches:
            packs = batch.column(2).to_pylist()
            for rows, texts in _batches([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["row", "form"])]):
                mine = [packs[i] for i in rows]
                packed = np.frombuffer(b"".join(mine), dtype=_BLOCK)
                owner = np.repeat(np.arange(len(mine)), [len(x) // _BLOCK.itemsize for x in mine])
                keep = _marked(packed["hash"], bits)
                packed, owner = packed[keep], owner[keep]
                yield _rows(batch.column(0).to_numpy(zero_copy_only=False)[rows], Codes(texts), owner, packed["place"].astype(np.int64), np.ascontiguousarray(packed["hash"]), packed["size"].astype(np.int64))

    return b.select("rep", "form", "blocks").mapInArrow(run, _SCHEMA)


def _sought(a: DataFrame, blocks: Broadcast, hashes_only: bool = False) -> DataFrame:
    """Rows of _SCHEMA of the windows that may meet a block, or their hashes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(blocks.value, dtype=np.uint8)
        for reps, texts in _batches(batches):
            codes = Codes(texts)
            met = met_windows(codes, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(met[2]).view(np.int64))], names=["block"]) if hashes_only else _rows(reps, codes, *met)

    return a.select("rep", "form").mapInArrow(run, "block bigint" if hashes_only else _SCHEMA)


#: Classes of characters, and words of one bit for each: word n has the bits of the classes that occur more than n times.
_CLASSES, BAG = 64, tuple(f"g{i}" for i in range(8))


def bag_words(codes: Codes) -> np.ndarray:
    """For each text, the counts of its characters by class in unary, in the words BAG; an edit changes 2 bits at most."""
    cp = codes.cp.astype(np.int64)
    digit, letter = (cp >= 48) & (cp < 58), (cp >= 97) & (cp < 123)
    of = np.where(digit, cp - 48, np.where(letter, cp - 87, 36 + cp % (_CLASSES - 36)))
    counts = np.bincount(codes.owner * _CLASSES + of, minlength=len(codes.length) * _CLASSES).reshape(-1, _CLASSES)
    bits = np.uint64(1) << np.arange(_CLASSES, dtype=np.uint64)
    return np.stack([np.where(counts > n, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64) for n in range(len(BAG))], axis=1)


def _with_bags(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _batches([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2)], names=["row", "form"])]):
                part = batch.slice(int(rows[0]), len(rows))
                words = bag_words(Codes(texts)).view(np.int64).T
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(w)) for w in words)], names=["key", "rep", "form", *BAG])

    return classes.select("key", "rep", "form").mapInArrow(run, "key binary, rep bigint, form string, " + ", ".join(f"{w} bigint" for w in BAG))


_SLICE = 1 << 14


def _counted(texts: DataFrame, counters: int) -> bytes:
    """Windows of the texts by bucket, added up by slices of the table; float32 each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for _, part in _batches(batches):
            total += window_counts(part, counters)
        slices = total.reshape(-1, min(_SLICE, counters)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slices))), pa.array([s.tobytes() for s in slices], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x.as_py(), dtype=np.float32) for x in table.column("counts")], axis=0, dtype=np.float64)
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

    schema = "part bigint, counts binary"
    parts = texts.select("rep", "form").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect()  # counters * 4 bytes in all
    return b"".join(bytes(r.counts) for r in sorted(parts)) if parts else bytes(4 * counters)


def _bitmap(blocks: DataFrame, bits: int) -> bytes:
    """Two bits for each block, built by Spark in pieces of 4 KB; bits / 8 bytes in all."""
    # Spark's buckets count from 1: bucket n holds the 32768 values from 32768 (n - 1) + 1 on.
    halves = F.array(F.col("block"), F.shiftrightunsigned("block", 32))
    at = F.col("half").bitwiseAND(F.lit(bits - 1)) + 1
    parts = blocks.select(F.explode(halves).alias("half")).groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map")).collect()
    out = bytearray(max(bits // 8, 4096))
    for r in parts:
        out[(r.part - 1) * 4096 : r.part * 4096] = r.map
    return bytes(out)


def near_classes(a: DataFrame, b: DataFrame, counters: int = COUNTERS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """a, b: (key, rep, form) of distinct texts, a written. Gives key_a, key_b, edits of all pairs of different texts within a tenth, and b as written."""
    context = a.sparkSession.sparkContext
    a = a.where(F.length("form") >= TENTH - 1)
    b = written = materialize(with_blocks(b, context.broadcast(_counted(a, counters))))
    b = b.where(F.length("form") >= TENTH - 1)
    # About a bit set in 64; a small corpus needs no large map.
    n = b.count()
    while bits > 1 << 18 and bits > 512 * n:
        bits //= 2
    blocks = context.broadcast(_bitmap(_block_hashes(b), bits))
    sought = context.broadcast(_bitmap(_sought(a, blocks, True), bits))
    ra, rb = _sought(a, blocks).alias("a"), _indexed(b, sought).alias("b")
    k = F.floor(F.greatest("a.len", "b.len") / F.lit(TENTH))

    side = lambda words: sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words), F.lit(0))
    longer = lambda x, y: F.abs(x - y)
    # Each side takes as many edits as its length changes, and one for every 4 bits flipped, or part of 4.
    left = F.greatest(longer(F.col("a.lo"), F.col("b.lo")), F.shiftright(side(WORDS[:SIDE_WORDS]) + 3, 2))
    right = F.greatest(longer(F.col("a.len") - F.col("a.lo"), F.col("b.len") - F.col("b.lo")), F.shiftright(side(WORDS[SIDE_WORDS:]) + 3, 2))
    one_place = (F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi"))
    close = (
        (F.col("a.block") == F.col("b.block"))
        & (F.abs(F.col("a.len") - F.col("b.len")) <= k)
        & (F.col("a.lo") - F.col("b.hi") <= k)
        & (F.col("b.lo") - F.col("a.hi") <= k)
        & (~one_place | (left + right <= k))
    )
    # The rows made here are many more than the plan's estimate for them, so no side may be sent whole.
    met = ra.join(rb.hint("merge"), close).select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct()
    # What meets is tested by the counts of its characters before the edit distance is taken.
    named = lambda x, s: _with_bags(x).withColumnsRenamed({c: f"{c}_{s}" for c in ("rep", "key", "form", *BAG)})
    texts = met.join(named(a, "a"), "rep_a").join(named(b, "b"), "rep_b").where("key_a <> key_b")
    limit = F.floor(F.greatest(F.length("form_a"), F.length("form_b")) / F.lit(TENTH)).cast("int")
    changed = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in BAG), F.lit(0))
    return texts.withColumn("k", limit).where(changed <= 2 * F.col("k")).withColumn("edits", F.expr("levenshtein(form_a, form_b, k)")).where("edits >= 0").select("key_a", "key_b", "edits"), written


def _forms(records: DataFrame) -> DataFrame:
    """records (id, text, ...) with `form` and its 128-bit key, written once; null and blank ones left out."""
    named = records.where(F.col("text").isNotNull() & F.col("id").isNotNull()).withColumn("id", F.col("id").cast("string"))
    formed = named.withColumn("form", letters_and_digits_column(F.col("text"))).drop("text").where("form <> ''")
    return materialize(formed.withColumn("key", F.unhex(F.md5("form"))))


def _classes(forms: DataFrame) -> DataFrame:
    """key, form and a number `rep`, to be written once, of each distinct text."""
    return forms.groupBy("key").agg(F.min("form").alias("form")).withColumn("rep", F.monotonically_increasing_id())


def overlaps(evals: DataFrame, trains: DataFrame) -> DataFrame:
    """All overlapping pairs: the columns of evals (id, text, ...) as eval_*, those of trains as intent_*, and edits."""
    e, t = _forms(evals), _forms(trains)
    ec = materialize(_classes(e))
    links, tc = near_classes(ec, _classes(t))
    same = ec.select("key").join(tc.select("key"), "key").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0).alias("edits"))
    links = links.unionByName(same)
    em, tm = (x.drop("form").withColumnsRenamed({c: f"{side}_{c}" for c in x.columns if c not in ("form", "key")}).withColumnRenamed("key", key) for x, side, key in ((e, "eval", "key_a"), (t, "intent", "key_b")))
    return links.join(em, "key_a").join(tm, "key_b").drop("key_a", "key_b")


def overlap_report(evals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split and source of the evaluation records: records, those with an equal and with only near-equal training texts."""
    worst = pairs.groupBy("eval_id").agg(F.min("edits").alias("edits"), F.count("*").alias("n"))
    base = evals.select(F.col("id").cast("string").alias("eval_id"), "split", "source")
    joined = base.join(worst, "eval_id", "left")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("n_records"),
        F.count(F.when(F.col("edits") == 0, 1)).alias("n_same"),
        F.count(F.when(F.col("edits") > 0, 1)).alias("n_near"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"),
    )
