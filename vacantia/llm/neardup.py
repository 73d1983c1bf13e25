"""Near-duplicate texts: one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

One pass over the texts makes word shingles, a parity mask of the set, and band keys; shingles
are not stored. Each shingle set falls once into BINS bins; empty bins borrow from bins chosen by
a hash of (bin, attempt), the same for all texts. Bands of ROWS bins make bucket keys. Each bucket
links its members to one of them only, chosen by hash, first among the rows of one batch, then
among what is left of all batches, so that a bucket shared by a third of all rows is collapsed
before it is shuffled: edges are bounded by texts times bands.

A pair whose masks differ in h bits has at least h shingles that only one side holds; that drops
edges that cannot reach the threshold. Of what is left, the ends of two edges with a common text
are candidates too, as two members of a bucket are both linked with its centre only. Shingles
are then made again for the texts of the candidates alone, and pairs are verified exactly.

A pair at similarity s meets in no bucket with probability (1 - s^ROWS)^BANDS: 3e-4 at 0.6, 2e-6
at 0.65, 4e-10 at 0.7. It is lost too if in all its buckets the centre is like neither, which
takes ROWS equal minima and a smaller hash each time. `brute_force` finds all links of some rows.

Defined results: texts with fewer than `width` words have no shingles and no links; null and
empty texts likewise; a text is never linked with itself; texts with the same set are one node.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.graph import components
from vacantia.session import settle

ROWS, BANDS = 6, 170
BINS = ROWS * BANDS
#: Bits of a set's parity mask, in words of 64.
MASK_BITS = 512
MASKS = [f"m{k}" for k in range(MASK_BITS // 64)]
#: Bytes of a key beside the number of its partition, and keys that one task links at once.
KEY_BYTES, KEYS_A_TASK = 5, 2_000_000
#: Attempts of all bins at once, before those still empty are followed one by one.
TOGETHER = 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_DOC, _KEYS, _EDGE = b"d", b"k", b"e"
#: Makes body what a reader sees.
Shown = Callable[[DataFrame], DataFrame]


def _as_is(texts: DataFrame) -> DataFrame:
    return texts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.frombuffer(bytes(chr(i).isalnum() for i in range(0x110000)), dtype=np.bool_)


def shingle_sets(heads: list[str | None], bodies: list[str | None], width: int, min_words: int, letters: np.ndarray) -> dict[int, np.ndarray]:
    """By place in the lists: sorted distinct 64-bit hashes of the sequences of `width` words of head and body together.

    Words are maximal sequences of letters and digits, in lower case. Texts whose body has fewer
    than min_words words are left out. All words of the lists are hashed at once.
    """
    tops = [(h or "").lower() + "\n" for h in heads]
    texts = [h + (b or "").lower() for h, b in zip(tops, bodies)]
    if not texts:
        return {}
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    inside = letters[codes]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, length = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    if len(start) < width:
        return {}
    flat = codes[inside].astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    power = np.cumprod(np.full(int(length.max()), _GOLDEN))
    words = _mix(np.add.reduceat(flat * power[np.arange(len(flat)) - np.repeat(at, length)], at) + length.astype(np.uint64))
    owner = np.searchsorted(first, start, side="right") - 1
    body_words = np.bincount(owner[start >= first[owner] + np.array([len(t) for t in tops])[owner]], minlength=len(texts))
    m = len(words) - width + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _GOLDEN + words[k : m + k])
    good = (owner[:m] == owner[width - 1 :]) & (body_words[owner[:m]] >= min_words)
    out, owner = out[good].view(np.int64), owner[:m][good]
    if not len(out):
        return {}
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return {int(i): np.unique(x) for i, x in zip(owner[np.concatenate(([0], cuts))], np.split(out, cuts))}


def _runs(pdf: pd.DataFrame, chars: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """Slices of about `chars` characters; a longer text is a slice by itself."""
    size = pdf["head"].str.len().fillna(0).to_numpy() + pdf["body"].str.len().fillna(0).to_numpy()
    run = (np.cumsum(size) // chars).astype(np.int64)
    for start, stop in zip(*(lambda c: (np.concatenate(([0], c)), np.concatenate((c, [len(pdf)]))))(np.flatnonzero(np.diff(run)) + 1)):
        yield pdf.iloc[int(start) : int(stop)]


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def parity_masks(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set and each of MASK_BITS bits whether an odd number of shingles falls on it, as sets x words of 64."""
    owner = np.repeat(np.arange(len(sizes)) * MASK_BITS, sizes)
    bits = np.bincount(owner + (_mix(flat.view(np.uint64)) % np.uint64(MASK_BITS)).astype(np.int64), minlength=len(sizes) * MASK_BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1, MASK_BITS), axis=1).view(np.int64)


def attempts(bins: int, count: int) -> np.ndarray:
    """The bins that an empty bin borrows from, attempts x bins."""
    own = np.arange(bins, dtype=np.uint64) * _GOLDEN
    return np.array([_mix(own + np.uint64(a + 1)) % np.uint64(bins) for a in range(count)]).astype(np.int16)


def sketches(flat: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation sketches, texts x bins, of flat shingle hashes. Every text has at least one shingle."""
    n = len(sizes)
    h = _mix(flat.view(np.uint64))
    place = np.repeat(np.arange(n) * bins, sizes) + ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
    down = np.argsort(h)[::-1]  # the smallest of a bin is written last
    out = np.full(n * bins, _EMPTY)
    out[place[down]] = h[down]
    out = np.ascontiguousarray(out.reshape(n, bins).T)  # bins x texts, so that an attempt moves whole rows
    full = out != _EMPTY
    empty = (~full).view(np.uint8)
    table = attempts(bins, TOGETHER)
    open_, failed = (~full).view(np.uint8), np.zeros((bins, n), dtype=np.uint8)  # failed: attempts without a hit
    for row in table:
        failed += open_
        open_ &= empty[row]
    own = np.arange(bins, dtype=np.int16)[None]
    source = np.concatenate([own, table])[failed, np.arange(bins)[:, None]]
    source[open_.view(np.bool_)] = -1
    bin_, rest = np.nonzero(source < 0)
    attempt = TOGETHER
    while len(rest):
        attempt += 1
        tried = (_mix(bin_.astype(np.uint64) * _GOLDEN + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[tried, rest]
        source[bin_[hit], rest[hit]] = tried[hit]
        rest, bin_ = rest[~hit], bin_[~hit]
    return np.take_along_axis(out, source.astype(np.int64), axis=0).T


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x100000001B3) + parts[:, :, r])
    return key


def star(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat keys with their ids: edges (centres, others), each once, and which places are the centre of their key.

    The centre is the member with the smallest hash of key and id, so that two texts do not have
    the same third one, like neither, between them in every bucket.
    """
    order = np.argsort(keys)
    k = keys[order]
    again = k[1:] == k[:-1]
    chosen = np.ones(len(keys), dtype=bool)
    held = order[np.concatenate(([False], again)) | np.concatenate((again, [False]))]  # keys that several rows have
    held = held[np.lexsort((_mix(ids[held].astype(np.uint64) * _GOLDEN ^ keys[held]), keys[held]))]
    k, own = keys[held], ids[held]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=bool)
    centre = own[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    edges = np.unique(np.stack([centre, own])[:, ~new & (centre != own)], axis=1)
    chosen[held[~new]] = False
    return edges[0], edges[1], chosen


def _sketched(width: int, min_words: int, tasks: int, letters):
    """Texts to rows (part, id, cell): one a text with the name, size and mask of its set, one an edge of the batch, and its keys by partition."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, names, sizes, masks, rows, known = [], [], [], [], [], set()
            for pdf in _runs(batch):
                found = shingle_sets(pdf["head"].tolist(), pdf["body"].tolist(), width, min_words, letters.value)
                own = pdf["id"].to_numpy()
                fresh = []
                if found:
                    held = list(found.values())
                    masks += map(bytes, parity_masks(np.concatenate(held), np.array([len(x) for x in held])))
                for i, x in found.items():
                    name = _name(x)
                    ids.append(own[i])
                    names.append(name)
                    sizes.append(len(x))
                    if name not in known:  # copies in one batch make keys once
                        known.add(name)
                        fresh.append((own[i], x))
                for k in range(0, len(fresh), 256):
                    part = fresh[k : k + 256]
                    keys = band_keys(sketches(np.concatenate([x for _, x in part]), np.array([len(x) for _, x in part])))
                    rows.append((np.array([i for i, _ in part], dtype=np.int64), keys))
            if not ids:
                continue
            cells = [_DOC + n + np.int32(s).tobytes() + m for n, s, m in zip(names, sizes, masks)]
            yield pd.DataFrame({"part": np.array(ids, dtype=np.int64) % tasks, "id": ids, "cell": cells})
            flat, who = np.concatenate([k for _, k in rows]).ravel(), np.repeat(np.concatenate([i for i, _ in rows]), BANDS)
            a, b, centres = star(flat, who)
            yield pd.DataFrame({"part": b % tasks, "id": b, "cell": [_EDGE + x.tobytes() for x in a]})
            flat, who = flat[centres], who[centres]
            part = (flat % np.uint64(tasks)).astype(np.int64)
            nth = np.cumsum(np.concatenate(([0], who[1:] != who[:-1])))
            order = np.argsort(nth * tasks + part, kind="stable")
            part, who, flat = part[order], who[order], (flat[order] // np.uint64(tasks)).astype("<u8")
            bytes_ = flat.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].copy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(who) != 0)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))
            data = bytes_.tobytes()
            yield pd.DataFrame({"part": part[begins], "id": who[begins], "cell": [_KEYS + data[s * KEY_BYTES : e * KEY_BYTES] for s, e in zip(begins, ends)]})

    return read


_LINKED = "a long, b long, s1 long, s2 long, size int, " + ", ".join(f"{m} long" for m in MASKS)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition's rows to its edges (a, b) and texts (b with name, size and mask). It holds KEYS_A_TASK keys or so."""
    columns = _LINKED.replace(" long", "").replace(" int", "").split(", ")
    keys, who, edges = [], [], []
    for pdf in batches:
        cells, ids = pdf["cell"].to_numpy(), pdf["id"].to_numpy()
        kind = np.fromiter((c[0] for c in cells), dtype=np.uint8, count=len(cells))
        docs, own, held = (np.flatnonzero(kind == k[0]) for k in (_DOC, _EDGE, _KEYS))
        if len(docs):
            raw = np.frombuffer(b"".join(cells[docs]), dtype=np.uint8).reshape(len(docs), -1)
            name = raw[:, 1:17].copy().view(np.int64)
            mask = raw[:, 21:].copy().view(np.int64)
            out = {"a": pd.array([None] * len(docs), dtype="Int64"), "b": ids[docs], "s1": name[:, 0], "s2": name[:, 1], "size": raw[:, 17:21].copy().view(np.int32)[:, 0]}
            yield pd.DataFrame(out | {m: mask[:, k] for k, m in enumerate(MASKS)})
        if len(own):
            edges.append(np.stack([np.frombuffer(b"".join(c[1:] for c in cells[own]), dtype=np.int64), ids[own]]))
        if len(held):
            sizes = np.fromiter(map(len, cells[held]), dtype=np.int64, count=len(held)) - 1
            raw = np.frombuffer(b"".join(c[1:] for c in cells[held]), dtype=np.uint8).reshape(-1, KEY_BYTES)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :KEY_BYTES] = raw
            keys.append(wide.view(np.uint64)[:, 0])
            who.append(np.repeat(ids[held], sizes // KEY_BYTES))
    if keys:
        edges.append(np.stack(star(np.concatenate(keys), np.concatenate(who))[:2]))
    if edges:
        both = np.unique(np.concatenate(edges, axis=1), axis=1)
        for k in range(0, both.shape[1], 1 << 16):
            part = both[:, k : k + (1 << 16)]
            yield pd.DataFrame({"a": part[0], "b": part[1]} | {c: pd.array([None] * part.shape[1], dtype="Int64") for c in columns[2:]})


def _may_reach(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of nodes to distinct (a, b) of their representatives, a < b, whose sizes and masks allow the threshold."""
    left, right = (nodes.select(F.col("id").alias(x), F.col("rep").alias(f"rep{x}"), F.col("size").alias(f"size{x}"), *[F.col(m).alias(f"{m}{x}") for m in MASKS]) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").filter("repa <> repb")
    total = F.col("sizea") + F.col("sizeb")
    apart = sum((F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in MASKS), F.lit(0))
    need = 2 * threshold / (1 + threshold)  # of the two sizes together, twice the shingles to be shared
    kept = both.filter((total - F.greatest(apart, F.abs(F.col("sizea") - F.col("sizeb")))) >= need * total - 1e-9)
    return kept.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b")).distinct()


def _wedges(edges: DataFrame) -> DataFrame:
    """Edges, and the ends of two edges with a common text, smaller first."""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = ends.select("a", F.col("b").alias("x")).join(ends.select("a", F.col("b").alias("y")), "a").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.distinct()


def shingled(texts: DataFrame, width: int, min_words: int, shown: Shown = _as_is) -> DataFrame:
    """(id, head, body) to (rep, shingles)."""

    letters = texts.sparkSession.sparkContext.broadcast(word_characters())  # 1.1 MB, fixed

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _runs(batch):
                found, own = shingle_sets(pdf["head"].tolist(), pdf["body"].tolist(), width, min_words, letters.value), pdf["id"].to_numpy()
                yield pd.DataFrame({"rep": own[list(found)] if found else np.empty(0, dtype=np.int64), "shingles": list(found.values())})

    return shown(texts.select("id", "head", "body")).mapInPandas(read, "rep long, shingles array<bigint>")


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, min_words: int, shown: Shown = _as_is) -> DataFrame:
    """(a, b) pairs whose exact similarity reaches the threshold, with the similarity."""
    used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = settle(shingled(texts.join(used, "id", "left_semi"), width, min_words, shown), "verified-shingles")
    left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", similarity(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def link(texts: DataFrame, threshold: float, width: int = 3, min_words: int = 1, shown: Shown = _as_is) -> tuple[DataFrame, DataFrame]:
    """(id, head, body) to members (id, rep) and links (a, b, similarity) between representatives, a < b.

    shown is applied where texts are read, so that it never runs
    on rows that a later step leaves out.
    """
    texts = texts.select("id", "head", "body")
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * BANDS // KEYS_A_TASK))
    letters = spark.sparkContext.broadcast(word_characters())  # 1.1 MB, fixed
    rows = shown(texts.select("id", "head", "body")).mapInPandas(_sketched(width, min_words, tasks, letters), "part int, id long, cell binary")
    found = settle(rows.repartition(tasks, "part").mapInPandas(_linked, _LINKED), "sketches")
    docs = found.filter("a is null").select(F.col("b").alias("id"), "s1", "s2", "size", *MASKS)
    names = docs.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    nodes = settle(docs.join(names, ["s1", "s2"]).drop("s1", "s2"), "nodes")
    near = settle(_may_reach(nodes, found.filter("a is not null").select("a", "b").distinct(), threshold), "near")
    more = _may_reach(nodes.filter("id = rep"), _wedges(near).join(near, ["a", "b"], "left_anti"), threshold)
    links = verify(settle(near.unionByName(more), "candidates"), texts, threshold, width, min_words, shown)
    return nodes.select("id", "rep"), links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of texts that are linked or have the same set of shingles, smaller id first."""
    shared = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    twins = members.join(shared, "rep", "left_semi")
    same = twins.select("rep", F.col("id").alias("x")).join(twins.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    one, two = (members.select(F.col("rep").alias(r), F.col("id").alias(i)) for r, i in (("a", "x"), ("b", "y")))
    cross = links.select("a", "b").join(one, "a").join(two, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return same.unionByName(cross)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per text with shingles: id, group_id (smallest id of its group) and its number of links."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(sizes.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    classes = components(links).select(F.col("node").alias("rep"), "component")
    out = members.join(sizes, "rep").join(near, "rep", "left").join(classes, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def brute_force(texts: DataFrame, queries: DataFrame, threshold: float, width: int = 3, min_words: int = 1, shown: Shown = _as_is, block: int = 2048) -> DataFrame:
    """(id, head, body) of the queries against all texts: every pair (x, y) with x a query that reaches the threshold.

    Exact. Queries go out in blocks of `block` rows, each block one pass over the texts, so that a
    broadcast never grows; a text is held against a whole block by masks, and by shingles where these allow it.
    """
    spark = texts.sparkSession
    asked, sets = settle(shingled(queries, width, min_words, shown), "queries"), settle(shingled(texts, width, min_words, shown), "all-shingles")
    out = spark.createDataFrame([], "x long, y long")
    blocks = max(1, -(-asked.count() // block))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == b).toArrow().to_pydict()
        if rows["rep"]:
            held = [np.array(x, dtype=np.int64) for x in rows["shingles"]]
            shared = spark.sparkContext.broadcast((np.array(rows["rep"]), held, parity_masks(np.concatenate(held), np.array([len(x) for x in held]))))
            out = out.unionByName(sets.mapInPandas(_against(shared, threshold), "x long, y long"))
    return out


def _against(shared, threshold: float):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, masks = shared.value
        sizes = np.array([len(x) for x in held])
        need = 2 * threshold / (1 + threshold)
        for pdf in batches:
            xs, ys = [], []
            for rep, own in zip(pdf["rep"], pdf["shingles"]):
                apart = np.bitwise_count((masks ^ parity_masks(own, np.array([len(own)]))).view(np.uint64)).sum(axis=1)
                total = sizes + len(own)
                for k in np.flatnonzero(total - np.maximum(apart, np.abs(sizes - len(own))) >= need * total - 1e-9):
                    both = len(np.intersect1d(held[k], own, assume_unique=True))
                    if ids[k] != rep and both >= threshold * (total[k] - both) - 1e-9:
                        xs.append(ids[k])
                        ys.append(rep)
            yield pd.DataFrame({"x": pd.Series(xs, dtype="int64"), "y": pd.Series(ys, dtype="int64")})

    return read
