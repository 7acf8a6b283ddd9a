"""SimHash near-duplicates: fingerprints, bit-sliced comparison in blocks, components.

:func:`near_duplicates` links 64-bit fingerprints a few bits apart;
:func:`similar` and :func:`one_of_each` link texts by the similarity of their
shingle sets, by wider fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import WORD, Scratch, keyed, pieces_of, release, ship, sifted
from .components import stars

#: Two fingerprints link when at most so many bits differ.
RADIUS = 3
#: The 64 bits are cut in at least this many bands; all but RADIUS of them make a key, so linked fingerprints share one.
BANDS = 5
#: Fingerprints compared in one block; larger groups are dealt in blocks of this size.
BLOCK = 4096
SEED = 42

_WORDS = regex.compile(WORD.encode()).findall
_CUT = regex.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hash of each shingle of ``width`` words, of all words where they are fewer."""
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        shingles = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(s, SEED) for s in shingles], np.uint64, len(shingles))


def hashes_of(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The shingle hashes of a whole text, piece by piece; nothing where it has no word."""
    tail, some = [], False
    for piece in pieces_of(text or "", _CUT):
        words = tail + _WORDS(piece.encode().translate(_LOWER))
        if len(words) >= width:
            yield shingle_hashes(words, width)
            some, tail = True, words[len(words) - width + 1 :]
        else:
            tail = words
    if tail and not some:
        yield shingle_hashes(tail, width)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits how many of ``hashes`` have it, least bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text; 0 where it has no word."""
    count, bits = 0, np.zeros(64, np.int64)
    for hashes in hashes_of(text, width):
        count, bits = count + len(hashes), bits + set_bits(hashes)
    return sum(1 << i for i in range(64) if 2 * int(bits[i]) > count) if count else 0


def fingerprints(docs: DataFrame, *, text: str = "text", width: int = 3, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (none of them named ``fp``) of each row and ``fp``, its text's SimHash as a signed long.

    Words are runs of anything but ASCII white space, A to Z lower-cased;
    shingles of ``width`` words count as often as they occur, fewer words make
    one shingle; a null text or one without a word has fingerprint 0. Very long
    texts are hashed piece by piece, whole.
    """
    ship(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = np.array([fingerprint(v.as_py(), width) for v in batch.column("whole")], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, StructType(source.schema.fields[:-1]).add("fp", "long")).toDF(*keep, "fp")


def band_keys(bands: int = BANDS, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(number, mask) of each key: the bits of all choices of ``bands - radius`` bands."""
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    return list(enumerate(sum(chosen) for chosen in combinations(masks, bands - radius)))


def bands_for(count: int, radius: int = RADIUS) -> int:
    """So many bands that a key has at least as many bits as it takes to number ``count`` fingerprints, up to half of the 64 and a few.

    With more bands a key has more bits and there are more keys: 10 of 26 bits
    up to 6e7 fingerprints, 20 of 32 up to 4e9, 35 of 37 up to 1e11.
    """
    bands = max(BANDS, radius + 2)
    while 64 * (bands - radius) // bands < count.bit_length() and bands < 2 * radius + 4:
        bands += 1
    return bands


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of all ``values``, 64 of them to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the places of the fingerprints in ``planes`` at most ``radius`` bits away.

    The distances of 64 fingerprints are counted at once: each plane, flipped
    where the query has the bit, is added into bitwise counters with a
    carry-save chain, and words in which every count has passed the radius are
    abandoned.
    """
    digits = radius.bit_length()
    words = planes.shape[1]
    for q, query in enumerate(queries.tolist()):
        live = np.arange(words)
        part = planes
        counters = [np.zeros(words, np.uint64) for _ in range(digits)]
        over = np.zeros(words, np.uint64)
        for bit in range(64):
            carry = part[bit] ^ np.uint64(0xFFFFFFFFFFFFFFFF if query >> bit & 1 else 0)
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            over = over | carry
            if bit % 8 == 7 and bit < 63:
                left = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
                if not len(left):
                    live = left
                    break
                if len(left) < len(live) // 2:
                    live, part, over = live[left], part[:, left], over[left]
                    counters = [c[left] for c in counters]
        if len(live):
            near = over  # counters hold the count where nothing has passed over
            if radius + 1 != 1 << digits:
                near = near | _above(counters, radius)
            bits = np.unpackbits((~near).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(bits)
            yield q, live[w] * 64 + b


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters exceed ``radius``."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for d in reversed(range(len(counters))):
        if radius >> d & 1:
            equal = equal & counters[d]
        else:
            above, equal = above | (equal & counters[d]), equal & ~counters[d]
    return above


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join all linked fingerprints: of ``left`` among themselves, or between ``left`` and ``right``.

    Edges that close a circle are left out, so there are fewer edges than
    fingerprints however many of them link.
    """
    values = left if right is None else np.concatenate((left, right))
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    base = 0 if right is None else len(left)
    planes = planes_of(left if right is None else right)
    count = len(values) - base
    for q, places in within(planes, left, radius):
        for p in places.tolist():
            if p < count and (right is not None or p > q):
                a, b = root(q), root(base + p)
                if a != b:
                    parent[b] = a
                    edges.append((int(values[q]), int(values[base + p])))
    return edges


def links(distinct: DataFrame, scratch: Scratch, *, radius: int = RADIUS, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """From distinct fingerprints (``fp``) edges (a, b) whose components are those of all links.

    A fingerprint goes out once under each of its band keys, whose width grows
    with the number of fingerprints; all links share a key. A key's group is compared bit-sliced in one task, or, where it holds
    more than ``block``, dealt in parts of about ``block`` whose every pair of
    parts is a group of its own. So no group exceeds two blocks and none is cut.
    """
    ship(distinct.sparkSession)
    bands = bands or bands_for(distinct.count(), radius)
    keys = F.array(
        *[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")) for n, mask in band_keys(bands, radius)]
    )
    out = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.n", "key.bits")
    sizes = out.groupBy("n", "bits").agg(F.count("*").alias("size")).where(F.col("size") > block)
    dealt = out.join(sizes, ["n", "bits"], "left")
    parts = F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int")
    dealt = dealt.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        F.xxhash64("n", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("deal"),
        "n", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp",
    )
    group = ["deal", "n", "bits", "i", "j"]
    dealt = dealt.repartition("deal").sortWithinPartitions(*group, "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare(rows: np.ndarray) -> list[tuple[int, int]]:
            fp = rows["fp"].view(np.uint64)
            if rows["i"][0] == rows["j"][0]:
                return forest(fp, None, radius)
            mine = rows["own"] == rows["i"]
            return forest(fp[mine], fp[~mine], radius)

        def frame(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.empty(batch.num_rows, [("n", "i4"), ("bits", "i8"), ("i", "i4"), ("j", "i4"), ("own", "i4"), ("fp", "i8")])
            for name in rows.dtype.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            if held:
                rows = np.concatenate([*held, rows])
            new = np.ones(len(rows), bool)
            new[1:] = (rows["n"][1:] != rows["n"][:-1]) | (rows["bits"][1:] != rows["bits"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])
            starts = np.flatnonzero(new)
            edges: list[tuple[int, int]] = []
            many = np.flatnonzero(np.diff(starts) > 1)  # single fingerprints link to nothing; the last group may go on
            for g in many.tolist():
                edges += compare(rows[starts[g] : starts[g + 1]])
            held = [rows[starts[-1] :].copy()]
            if edges:
                yield frame(edges)
        if held and len(held[0]) > 1:
            yield frame(compare(held[0]))

    return scratch.table(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def near_duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = 3,
    radius: int = RADIUS,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, str]:
    """Per row of ``docs``: its locator, doc_id, ``fp``, ``component_id`` and ``root``; and the locator's name.

    Fingerprints at most ``radius`` bits apart link, directly or through
    others; ``component_id`` is the smallest doc_id so reached, the row's own
    included (null ids are passed over unless a component has no other), so two
    components share it where an id is repeated or all are null; ``root``, the
    component's least fingerprint, names it for good. Texts
    without a word have fingerprint 0, which links like any other. Repeated
    rows share a fingerprint. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    rows, key = keyed(docs, scratch)
    chosen = rows.select(F.col(key).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = scratch.table(fingerprints(chosen, width=width, keep=["row", "doc_id"]), "prints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = stars(links(classes.select("fp"), scratch, radius=radius), scratch)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = scratch.table(rooted.join(smallest, "root").select("fp", "component_id", "root"), "components")
    return prints.join(by_print, "fp").select(F.col("row").alias(key), "doc_id", "fp", "component_id", "root"), key


# --- similar texts: wider fingerprints, so that a similarity of 0.8 is told from less ---------

#: Words of 64 bits to a wide fingerprint.
WIDE = 4
#: Least hashes of a shingle set, in so many keys of so many each; texts that share a key are compared.
KEYS, ROWS = 14, 4
#: Hashes of the members' sets in one part of a group that is compared in full.
HELD = 1 << 19
#: Queries compared at once in a large block.
QUERIES = 32
#: The columns that name a block.
_GROUP = ["deal", "key", "i", "j"]
_BLOCK = ["deal", "group", "key", "i", "j"]
_GOLD = 0x9E3779B97F4A7C15


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


_BITS = np.array([_GOLD * (i + 1) & 0xFFFFFFFFFFFFFFFF for i in range(WIDE)], np.uint64)
_SALTS = np.array([_GOLD * (i + 101) & 0xFFFFFFFFFFFFFFFF for i in range(KEYS * ROWS)], np.uint64)


def radius_for(similarity: float, bits: int = 64 * WIDE) -> int:
    """Most differing bits of a candidate: what texts of that similarity differ by on average, and 2.33 standard deviations.

    Shingle sets of similarity s have a cosine of 2s / (1 + s), and each bit
    differs with the probability of their angle, so 99 in 100 pairs just that
    similar are candidates, and more of those more similar.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * apart + 2.33 * math.sqrt(bits * apart * (1 - apart)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The hashes of a whole text's set of shingles, ascending; a single 0 where it has no word."""
    pieces = list(hashes_of(text, width))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(1, np.uint64)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Shared members of two sets over all their members."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both)


def wide_print(text: str | None, width: int) -> tuple[bytes, list[int]]:
    """The wide SimHash of a whole text's set of shingles, and its keys; texts without a word share one."""
    hashes = shingle_set(text, width)
    total, least = np.zeros(64 * WIDE, np.int64), np.full(KEYS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None]
        total += np.unpackbits(_mixed(part + _BITS).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, _mixed(part ^ _SALTS).min(axis=0), out=least)
    found = np.packbits(2 * total > len(hashes), bitorder="little").tobytes()
    raw = least.tobytes()
    step = 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[i : i + step], i) for i in range(0, len(raw), step)]
    return found, [k if k < 1 << 63 else k - (1 << 64) for k in keys]


def _lanes(prints: np.ndarray) -> np.ndarray:
    """Bit planes [bits, words] of prints [n, WIDE], 64 prints to a word."""
    n = len(prints)
    padded = np.zeros((-(-n // 64) * 64, WIDE), np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_lanes(planes: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Which lanes of each word are at most ``radius`` bits from the word's query: masks [words].

    ``planes`` is [bits, words] and ``asked`` [words, WIDE], the query of each
    word. The distances of all lanes are counted at once in bitwise counters
    with a carry-save chain; words all of whose lanes have passed the radius are
    abandoned.
    """
    digits = radius.bit_length()
    words = planes.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    flips = np.unpackbits(np.ascontiguousarray(asked).view(np.uint8), axis=1, bitorder="little").T  # [bits, words]
    live = np.arange(words)
    out = np.zeros(words, np.uint64)
    counters, over = np.zeros((digits, words), np.uint64), np.zeros(words, np.uint64)
    for bit in range(64 * WIDE):
        carry = planes[bit] ^ np.where(flips[bit], full, np.uint64(0))
        for d in range(digits):
            before = counters[d]
            counters[d], carry = before ^ carry, before & carry
        over |= carry
        if bit % 32 == 31 and bit >= 95:
            gone = over | _above(list(counters), radius)
            left = np.flatnonzero(gone != full)
            if len(left) < len(live) * 3 // 4 or bit == 64 * WIDE - 1:
                if bit == 64 * WIDE - 1:
                    out[live] = ~gone
                    return out
                if not len(left):
                    return out
                live, planes, flips, over, counters = live[left], planes[:, left], flips[:, left], over[left], counters[:, left]
    return out


def _small_forests(blocks: list[np.ndarray], radius: int) -> list[tuple[bytes, bytes]]:
    """Edges that join all links within each block of at most 64 prints; a block is a word, and all are compared side by side."""
    edges = []
    sizes = np.array([len(b) for b in blocks])
    planes = np.concatenate([_lanes(b) for b in blocks], axis=1)
    parents = [list(range(len(b))) for b in blocks]
    for r in range(int(sizes.max()) - 1):
        words = np.flatnonzero(sizes > r + 1)
        near = near_lanes(planes[:, words], np.stack([blocks[w][r] for w in words]), radius)
        lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for w, p in zip(*np.nonzero(lanes[:, r + 1 :]), strict=True):
            block, p = int(words[w]), int(p) + r + 1
            if p >= sizes[block]:
                continue
            parent = parents[block]
            a, b = r, p
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((blocks[block][r].tobytes(), blocks[block][p].tobytes()))
    return edges


def _large_forest(prints: np.ndarray, asked: int, radius: int) -> list[tuple[bytes, bytes]]:
    """Edges that join all links between the first ``asked`` prints and all of them.

    Words whose prints are all joined with the queries already are passed over,
    so a dense block costs little more than one row of comparisons.
    """
    edges, n = [], len(prints)
    label = np.arange(n)
    planes = _lanes(prints)
    words = planes.shape[1]
    of_word = np.concatenate((label, np.full(words * 64 - n, -1)))
    for at in range(0, asked, QUERIES):
        queries = np.arange(at, min(at + QUERIES, asked))
        of_word[:n] = label
        same = label[queries] == label[queries[0]]
        open_ = np.flatnonzero(((of_word != label[queries[0]]) & (of_word >= 0)).reshape(words, 64).any(axis=1)) if same.all() else np.arange(words)
        if not len(open_):
            continue
        near = near_lanes(np.tile(planes[:, open_], (1, len(queries))), np.repeat(prints[queries], len(open_), axis=0), radius).reshape(len(queries), -1)
        for i, q in enumerate(queries.tolist()):
            lanes = np.unpackbits(near[i].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(lanes)
            places = open_[w] * 64 + b
            places = places[places < n]
            others, first = np.unique(label[places], return_index=True)
            joined = others != label[q]
            if joined.any():
                for p in places[first[joined]].tolist():
                    edges.append((prints[q].tobytes(), prints[p].tobytes()))
                least = min(int(others.min()), int(label[q]))
                label[np.isin(label, np.append(others, label[q]))] = least
    return edges


def linked_sets(sets: list[np.ndarray], label: np.ndarray, asked: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels that links join, between the first ``asked`` sets and all of them; without those that close a circle.

    A set's shared members with all others are counted at once, by the places
    where each of its members stands; no pair is held.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(hashes)))
    run = np.empty(len(hashes), np.int64)
    run[order] = np.cumsum(new) - 1
    names, now = label, label.copy()
    edges = []
    for q in range(asked):
        if (now == now[q]).all():
            continue
        own = run[ends[q] - sizes[q] : ends[q]]
        both = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            part = part[count[part] > 1]
            many = count[part]
            places = np.repeat(first[part] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            both += np.bincount(owner[places], minlength=len(sets))
        near = np.flatnonzero((both / (sizes[q] + sizes - both) >= similarity) & (now != now[q]))
        for p in near.tolist():
            if now[p] != now[q]:
                edges.append((int(names[q]), int(names[p])))
                now[now == now[p]] = now[q]
    return edges


def similar(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8, block: int = BLOCK, held: int = HELD, scratch: Scratch | None = None
) -> tuple[DataFrame, str]:
    """Per row of ``docs``: its locator, doc_id, ``fp`` (wide, binary) and ``root``; and the locator's name.

    Texts whose sets of ``width``-word shingles have ``similarity`` or more link,
    directly or through others; ``root``, the least fingerprint so reached,
    names the component. Candidates are told by wide fingerprints at most
    :func:`radius_for` bits apart, compared where two texts share one of
    ``KEYS`` keys of the least hashes of their shingles (at 0.8 all but 6 in
    10,000 do), and the sets of each are compared in full: no texts less
    similar link. Texts of one fingerprint of 256 bits count as alike, without a comparison. Texts without a word
    are one component; a null text is an empty one; repeated rows share a
    fingerprint; very long texts are hashed whole; an empty table gives an
    empty result.

    A key that only one fingerprint has goes no further. The rest is compared
    in blocks, a key's group of more than ``block`` dealt in parts of which
    every pair is a block. A block gives the candidates that join all its near
    fingerprints, without those that close a circle; a text that is among them
    is read and hashed once, and these pairs are joined with the sets. Good ones
    make classes. Where one turned out less similar and its texts are of two
    classes, all classes that such pairs join are a group, in which every two
    sets of different classes are compared: the group's heaviest class answers,
    the others ask. Each member goes out with its set to blocks of about
    ``held`` hashes, or two of these; no pair is made. A group whose asking
    members fill more blocks than there are keys is split by key.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "similar")
    radius = radius_for(similarity)
    rows, key = keyed(docs, scratch)
    source = rows.select(F.col(key).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [wide_print(v.as_py(), width) for v in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))], ["row", "doc_id", "fp", "keys"])

    prints = scratch.table(source.mapInArrow(run, StructType(source.schema.fields[:2]).add("fp", "binary").add("keys", ArrayType(LongType()))), "prints")
    shared = prints.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.table(shared, "shared")
    out = prints.select("fp", F.explode("keys").alias("key")).join(shared, F.col("key") == F.col("k")).select("key", "fp", "size")
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = out.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    dealt = dealt.withColumn("deal", F.xxhash64("key", "i", "j")).select(*_GROUP, "own", "fp").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def frame(edges: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges, strict=True)], ["a", "b"])

        def small(least: int) -> list[tuple]:
            if len(pending) < least or not pending:
                return []
            by_size = sorted(pending, key=len)
            pending.clear()
            return [edge for at in range(0, len(by_size), 512) for edge in _small_forests(by_size[at : at + 512], radius)]

        group, members, owners = None, [], []

        def close() -> list[tuple]:
            if len(members) < 2:
                return []
            rows = np.frombuffer(b"".join(members), np.uint64).reshape(-1, WIDE)
            if group[2] != group[3]:
                mine = np.array(owners) == group[2]
                return _large_forest(np.concatenate((rows[mine], rows[~mine])), int(mine.sum()), radius)
            if len(rows) > 64:
                return _large_forest(rows, len(rows), radius)
            pending.append(rows)
            return small(4096)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            edges = []
            for *now, own, fp in zip(*columns, strict=True):
                if tuple(now) != group:
                    edges += close()
                    group, members, owners = tuple(now), [], []
                members.append(fp)
                owners.append(own)
            if edges:
                yield frame(edges)
        edges = close() + small(1)
        if edges:
            yield frame(edges)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sets = [pa.array(shingle_set(v.as_py(), width).view(np.int64)) for v in batch.column("text")]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(sets))], ["fp", "hashes"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, own = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                good = []
                for a, one, two in zip(batch.column("a"), batch.column("one"), batch.column("two"), strict=True):
                    if a.as_py() != last:  # sorted by the join, so a hub's set is read once
                        last, own = a.as_py(), one.values.to_numpy()
                    good.append(likeness(own, two.values.to_numpy()) >= similarity)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        group, sets, classes, mine = None, [], [], []

        def close() -> list[tuple]:
            if not any(mine) or len(set(classes)) < 2:
                return []
            names, label = np.unique(np.array(classes, object), return_inverse=True)
            order = np.argsort(~np.array(mine), kind="stable")
            found = linked_sets([sets[i] for i in order], label[order], sum(mine), similarity)
            return [(names[a], names[b]) for a, b in found]

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                edges = []
                columns = [batch.column(c).to_pylist() for c in (*_BLOCK, "own", "class")]
                for *now, own, of, found in zip(*columns, batch.column("hashes"), strict=True):
                    if tuple(now) != group:
                        edges += close()
                        group, sets, classes, mine = tuple(now), [], [], []
                    sets.append(found.values.to_numpy().copy())
                    classes.append(of)
                    mine.append(own == now[3])
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges, strict=True)], ["a", "b"])
        if edges := close():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges, strict=True)], ["a", "b"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, since the work in a block is no matter of its bytes
    edges = dealt.repartition(tasks, "deal").sortWithinPartitions(*_GROUP, "own", "fp").mapInArrow(compare, "a binary, b binary")
    pairs = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct()
    chosen = scratch.table(prints.select("fp", "row").join(wanted, "fp").groupBy("fp").agg(F.min("row").alias("row")), "chosen")
    texts = sifted(source.select("row", "text"), "row", chosen).join(chosen, "row").select("fp", "text")
    sets = scratch.table(texts.mapInArrow(hashed, "fp binary, hashes array<long>"), "sets")
    # The greater of a pair is seldom a hub, so its set goes along; the lesser's is joined last and read where it lies.
    both = pairs.join(sets.toDF("b", "two"), "b").join(sets.toDF("a", "one"), "a").select("a", "b", "one", "two")
    verdicts = scratch.table(both.mapInArrow(alike, "a binary, b binary, good boolean"), "verdicts")
    classes = scratch.table(stars(verdicts.where("good").select("a", "b"), scratch).toDF("node", "class"), "classes")

    # Pairs that are less similar, as pairs of classes; one within a class leaves nothing open.
    bad = verdicts.where("not good").select("a", "b")
    for end in ("a", "b"):
        bad = bad.join(classes.toDF(end, f"class_{end}"), end, "left").withColumn(f"class_{end}", F.coalesce(f"class_{end}", end))
    bad = scratch.table(bad.where("class_a != class_b").select("class_a", "class_b").distinct(), "bad")
    if bad.isEmpty():
        joined = classes.toDF("node", "root")
    else:
        groups = stars(bad, Scratch(spark, "groups", base=scratch.path("groups")), left="class_a", right="class_b")
        groups = groups.toDF("class", "group").unionAll(groups.select("root", "root").distinct().toDF("class", "group"))
        # A set counts as some hashes at least, which bounds the members of a part.
        sized = sets.select("fp", F.greatest(F.size("hashes"), F.lit(held // 2048)).alias("n")).join(classes, F.col("fp") == F.col("node"), "left")
        sized = sized.select("fp", "n", F.coalesce("class", "fp").alias("class")).join(groups, "class")
        sized = scratch.table(sized.select("fp", "n", "class", "group"), "sized")
        weights = sized.groupBy("group", "class").agg(F.sum("n").alias("weight"))
        weights = weights.groupBy("group").agg(F.max(F.struct("weight", "class")).alias("heaviest"), F.sum("weight").alias("weight"))
        weights = weights.select("group", F.col("heaviest.class").alias("answers"), (F.col("weight") - F.col("heaviest.weight")).alias("asking"))
        sized = sized.join(weights, "group").withColumns({"asks": F.col("class") != F.col("answers"), "wide": F.col("asking") > KEYS * held})
        member = ["fp", "n", "class", "group", "asks"]
        whole = sized.where("not wide").select(*member, F.lit(0).cast("long").alias("key"))
        by_key = out.select("key", "fp").distinct().join(sized.where("wide").select(*member), "fp").select(*member, "key")
        ways = scratch.table(whole.unionAll(by_key), "ways")
        filled = lambda side: F.ceil(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)) / held).cast("int")
        parts = ways.groupBy("group", "key").agg(filled(F.col("asks")).alias("askers"), filled(~F.col("asks")).alias("answerers"))
        ways = ways.join(parts.where("askers > 0"), ["group", "key"])
        # Parts of those that ask come first; a block is one of these and any from it on.
        own = F.when(F.col("asks"), F.pmod(F.xxhash64("fp"), F.col("askers"))).otherwise(F.col("askers") + F.pmod(F.xxhash64("fp"), F.col("answerers")))
        last = F.when(F.col("asks"), F.col("askers") + F.col("answerers")).otherwise(F.col("askers")) - 1
        ways = ways.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        ways = ways.select("group", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "fp")
        ways = scratch.table(ways.withColumn("deal", F.xxhash64("group", "key", "i", "j")), "blocks")
        blocks = ways.join(sets, "fp").select(*_BLOCK, "own", "class", "hashes").repartition(tasks, "deal").sortWithinPartitions(*_BLOCK)
        more = scratch.table(blocks.mapInArrow(meet, "a binary, b binary"), "links")
        more = stars(more, Scratch(spark, "links", base=scratch.path("linked"))).toDF("class", "root")
        ends = classes.unionAll(more.select("class", "class"))
        joined = ends.join(more, "class", "left").select("node", F.coalesce("root", "class").alias("root"))
    rooted = prints.select("row", "doc_id", "fp").join(joined, F.col("fp") == F.col("node"), "left")
    return rooted.select(F.col("row").alias(key), "doc_id", "fp", F.coalesce("root", "fp").alias("root")), key


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` of which one per component of :func:`similar` stays: that of the smallest id (nulls last), then of the first locator.

    Null, empty and very long texts, repeated rows and empty tables are as there; the columns are those of ``docs``.
    """
    scratch = settings.pop("scratch", None) or Scratch(docs.sparkSession, "similar")
    rows, key = keyed(docs, scratch)
    found, locator = similar(docs, doc_id=doc_id, scratch=scratch, **settings)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(locator).alias("row")))
    stay = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(key))
    kept = rows.join(stay, key, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
