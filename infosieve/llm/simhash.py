"""SimHash near-dedup (operator 4).

Fingerprints of distinct documents are embedded as bit counts of short segments.  The
Manhattan distance of two embeddings is a lower bound of the Hamming distance, so a grid
range-join over the embeddings proposes candidates and the exact distance verifies them.
With at most 4 differing bits spread over three blocks, one block differs in at most one
bit; its embeddings lie in the same grid cell or in cells one step apart.  Verified links
become components by large-star/small-star rounds.

Hot cells are tiled: a cell with more members than ``tile`` is cut into slots and every
pair of slots meets in a group of its own.  A task emits a spanning forest of the links it
verified, never all pairs, so copies and groups of near copies stay linear in the output.

Defined results: a null or empty text has fingerprint zero and links like any other; texts
shorter than a shingle hash their whole word sequence; repeated rows share a fingerprint; a
component's id is its smallest non-null ``doc_id``; a bit that is set in exactly half the shingles is 0;
fingerprints at exactly the maximum distance link; a text of any length is read whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, in_arrow, stored

#: Bits per block of the pigeonhole; three blocks suffice for distances up to 5.
BLOCKS = ((0, 22), (22, 21), (43, 21))
SEGMENT = 2
#: Members of a grid cell that meet in one group; larger cells are tiled.
TILE = 2048
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 16


def text_fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:n]
    ends = ends[len(words) - n:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in
                      zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist(), strict=True)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t, width, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {ids}, fp long")


def grid_entries(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cell, home, row`` of unsigned fingerprints: the own cell of each block and the cells one step up.

    A cell's number holds the bit counts of the block's segments.  Of two cells one step
    apart, the upper one is the lower one's neighbour by a step up, so steps up alone bring
    every such pair together once.
    """
    cells, home, rows = [], [], []
    every = np.arange(len(fp))
    for k, (first, bits) in enumerate(BLOCKS):
        own, steps, place = np.full(len(fp), k, np.int64), [], len(BLOCKS)
        for off in range(first, first + bits, SEGMENT):
            top = min(SEGMENT, first + bits - off)
            count = np.bitwise_count((fp >> np.uint64(off)) & np.uint64((1 << top) - 1)).astype(np.int64)
            own += count * place
            steps.append((np.flatnonzero(count < top), place))
            place *= SEGMENT + 1
        cells.append(own)
        home.append(np.ones(len(fp), bool))
        rows.append(every)
        for at, p in steps:
            cells.append(own[at] + p)
            home.append(np.zeros(len(at), bool))
            rows.append(at)
    return np.concatenate(cells), np.concatenate(home), np.concatenate(rows)


def _cells(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            cell, home, row = grid_entries(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), pa.array(fp[row])],
                                             names=["cell", "home", "fp"])

    return distinct.select("fp").mapInArrow(run, "cell long, home boolean, fp long")


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable by links (a, b) among n nodes."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
    return label


def _links(group: np.ndarray, left: np.ndarray, right: np.ndarray, fp: np.ndarray, max_bits: int,
           pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole groups; rows are sorted by group."""
    nodes, node = np.unique(fp, return_inverse=True)
    cut = np.r_[0, np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1, len(group)]
    gid = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    li, ri = np.flatnonzero(left), np.flatnonzero(right)
    lcount = np.bincount(gid[li], minlength=len(cut) - 1)
    lstart = np.cumsum(lcount) - lcount
    each = lcount[gid[ri]]
    label = np.arange(len(nodes))
    ends = np.cumsum(each)
    at = 0
    while at < len(ri):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + pairs, "right")))
        r, n = ri[at:upto], each[at:upto]
        x = np.repeat(r, n)
        first = np.repeat(np.cumsum(n) - n, n)
        y = li[np.repeat(lstart[gid[r]], n) + np.arange(len(x)) - first]
        d = np.bitwise_count(fp[x] ^ fp[y])
        ok = (d <= max_bits) & (d > 0)
        if ok.any():
            a, b = label[node[x[ok]]], label[node[y[ok]]]
            label = spanning(len(nodes), a, b)[label]
        at = upto
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_links(distinct: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` whose closure equals that of all pairs within ``max_bits`` bits."""
    if max_bits > 5:
        raise ValueError("three blocks cover at most 5 differing bits")
    cells = _cells(distinct)
    slots = F.ceil(F.col("members") / F.lit(tile)).cast("int")
    hot = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile)
    sized = cells.join(hot.select("cell", slots.alias("slots")), "cell", "left")
    slot = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
    every = F.sequence(F.lit(0), F.col("slots") - 1)
    as_right = F.transform(every, lambda i: F.struct((i * F.col("slots") + slot).alias("tile"), F.lit(False).alias("l"),
                                                     F.lit(True).alias("r")))
    as_left = F.transform(every, lambda i: F.struct((slot * F.col("slots") + i).alias("tile"), F.lit(True).alias("l"),
                                                    F.lit(False).alias("r")))
    plain = F.array(F.struct(F.lit(0).alias("tile"), F.col("home").alias("l"), F.lit(True).alias("r")))
    parts = (F.when(F.col("slots").isNull(), plain).when(F.col("home"), F.concat(as_left, as_right))
             .otherwise(as_right))
    tiled = sized.select("cell", "fp", F.explode(parts).alias("p")).select("cell", "p.tile", "fp", "p.l", "p.r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def linked(parts: list[list[np.ndarray]], keep_last: bool):
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            group = np.stack([cols[0], cols[1].astype(np.int64)], axis=1)
            end = len(group)
            if keep_last:
                other = np.flatnonzero(np.any(group != group[-1], axis=1))
                end = other[-1] + 1 if len(other) else 0
            u, v = (_links(group[:end], cols[3][:end], cols[4][:end], cols[2][:end].view(np.uint64), max_bits)
                    if end else (np.empty(0, np.uint64),) * 2)
            return u, v, [c[end:] for c in cols]

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows >= 200_000:
                u, v, rest = linked(held, True)
                held, rows = [rest], 0
                yield out(u, v)
        if held:
            u, v, _ = linked(held, False)
            yield out(u, v)

    return (tiled.repartition("cell", "tile").sortWithinPartitions("cell", "tile")
            .mapInArrow(run, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, seed: int = 42,
                    tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document."""
    prints = stored(fingerprints(docs, width, seed), "simhash-fp")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = stored(near_links(distinct.select("fp"), max_bits, tile), "simhash-links")
    comps = stored(connected_components(links, "simhash-cc"), "simhash-comps")
    rooted = (distinct.join(comps, distinct["fp"] == comps["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return (prints.join(named, prints["fp"] == named["_fp"])
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, width: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is the smallest of its component.

    Rows that share that smallest id stay if their texts differ; equal texts under one id
    stay once.  Rows without an id stay, as no other row can name them.
    """
    near = near_duplicates(docs, width, max_bits, seed)
    marked = stored(near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("c"))
                    .where("doc_id is not null and (n > 1 or c != doc_id)"), "simhash-marked")
    drop = marked.where("c != doc_id").select(F.col("doc_id").alias("_id"))
    kept = docs.join(drop, docs["doc_id"] == drop["_id"], "left_anti")
    again = marked.where("c = doc_id").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["_id"], "left_anti")
    repeated = kept.join(again, kept["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)
