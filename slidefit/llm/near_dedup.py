"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are what stands between white space in the lower-cased text; k-mers are five words in a row, labelled with their
occurrence (first, second, ...), so all labelled k-mers of a text differ. A sketch holds the four smallest of them under one
of 20 hash functions, in the order in which they stand in the text: texts that share the k-mers in another order don't
share the sketch. Texts with a sketch in common are candidates.

Exact copies are one node. Every bucket first compares its nodes with one centre (round 1: the smallest id; later rounds:
one drawn by a hash, among nodes of buckets that still hold several components), which is linear in the rows. What buckets
with several components then hold is joined exactly: of the k-mers in one order for all texts, rare ones first, the first
n - 0.8 n + 1 of a text must meet those of any text at 0.8 or more, at places within the band and with enough k-mers after
them. All pairs of different components that meet so are verified, so no pair that shares a sketch is left out.

Verification aligns the two k-mer sequences: matches outside the band that the threshold allows are left out, the longest
chain of the others that keeps both orders (labelled k-mers are distinct, so it is a longest increasing subsequence) has m
matches, and the similarity m / (n1 + n2 - m) must reach 0.8. Verified links are joined into components by label
propagation over written tables; a component's smallest id is its class.

Null texts count as empty. Texts of fewer than five words have one k-mer of all their words; texts without words are alike
only as exact copies. Equal texts always share a class, so do rows that share an id; a row without an id has the
class of an equal text that has one, or none. An empty table gives an empty result. Very long texts are taken whole; further
columns, whatever their names, are left behind.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, slices, texts, write_table

WORDS, SKETCHES, SIZE, SIMILARITY = 5, 20, 4, 0.8
BLOCK = 1 << 18
SLOTS = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = np.array([0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(31)
    return h


def _seeds() -> np.ndarray:
    return _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _U(_BASE))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK * 2)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def kmers(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of several texts one after another, and how many each text has."""
    sizes = np.array([len(t) + 1 for t in block])
    raw = np.frombuffer(b" ".join(block) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    up, down = _powers_to(len(raw) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)])])
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    words = _mix((sums[end] - sums[begin]) * down[begin])
    ends = np.cumsum(sizes)
    per = np.diff(np.searchsorted(begin, ends), prepend=0)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    grams = sum(padded[k : k + len(words)] * _WEIGHTS[k] for k in range(WORDS))
    owner = np.repeat(np.arange(len(block)), per)
    last = np.repeat(np.cumsum(per), per)
    at = np.arange(len(words))
    keep = at + WORDS <= last
    few = np.flatnonzero((per > 0) & (per < WORDS))
    if len(few):  # one k-mer of all words
        first = (np.cumsum(per) - per)[few]
        keep[first] = True
        grams[first] = [np.bitwise_xor.reduce(words[a : a + n] * _WEIGHTS[:n]) for a, n in zip(first, per[few], strict=True)]
    grams, owner = _mix(grams[keep]), owner[keep]
    counts = np.bincount(owner, minlength=len(block))
    # the n-th occurrence within a text gets label n
    own = grams ^ (owner.astype(np.uint64) * _U(_BASE))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    if not new.all():
        place = np.arange(len(ranked))
        label = place - np.maximum.accumulate(np.where(new, place, 0))
        more = np.flatnonzero(label)
        grams[order[more]] = _mix(grams[order[more]] + label[more].astype(np.uint64) * _U(_BASE))
    return grams, counts


def sketches(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One number per hash function: the smallest labelled k-mers in the order of the text."""
    out = np.empty(len(seeds), np.uint64)
    for s, seed in enumerate(seeds):
        h = _mix(grams ^ seed)
        at = np.sort(np.argpartition(h, SIZE - 1)[:SIZE]) if len(h) > SIZE else slice(None)
        v = seed
        for x in h[at]:
            v = _U((int(v) * _BASE + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[s] = v
    return out


def _sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (k-mers), buckets (empty for a text without words)."""
    schema = "doc_id long, digest binary, n int, buckets array<long>"

    def run(batches):
        seeds = _seeds()
        for b in batches:
            for part in slices(b, 2, BLOCK):
                grams, counts = kmers(part.column(2).to_pylist())
                ends = np.cumsum(counts)
                rows = [sketches(grams[e - n : e], seeds).view(np.int64).tolist() if n else [] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "buckets"])

    own = docs.select("doc_id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("digest"), F.lower("text").cast("binary").alias("words"))
    return own.mapInArrow(run, schema)


def chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest chain of equal k-mers in both orders whose places differ by the band at most."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= band]
    if (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity m / (n1 + n2 - m) of two k-mer sequences by banded alignment."""
    n = len(a) + len(b)
    # at the threshold m = least * n / (1 + least); what is not matched bounds how far a match may be off the diagonal
    band = int(np.ceil(n - 2 * least * n / (1 + least))) + 1
    m = chain(a, b, band)
    return m / (n - m) if n > m else 1.0


def _sequences(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, seq): 32-bit labelled k-mers of the candidates' texts."""

    def run(batches):
        for b in batches:
            for part in slices(b, 1, BLOCK):
                grams, counts = kmers(part.column(1).to_pylist())
                rows = np.split(grams.astype(np.uint32), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["node", "seq"])

    asked = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").dropDuplicates(["doc_id"])
    return asked.select("doc_id", F.lower("text").cast("binary")).mapInArrow(run, "node long, seq binary")


def _distinct(seq: bytes) -> np.ndarray:
    """Distinct 32-bit k-mers in the order of the text."""
    grams, first = np.unique(np.frombuffer(seq, np.uint32), return_index=True)
    return grams[np.argsort(first)]


def _frequencies(sequences: DataFrame) -> np.ndarray:
    """How often k-mers of each slot occur; a table of fixed size. It only orders the k-mers, so shared slots do no harm."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for part in slices(b, 0, 4 * BLOCK):
                seqs = part.column(0).to_pylist()
                total += np.bincount(np.frombuffer(b"".join(seqs), np.uint32) & np.uint32(SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    t = sequences.select("seq").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[t["slot"].to_numpy()] = np.minimum(t["n"].to_numpy(), 2**31 - 1)
    return out


def _prefixes(nodes: DataFrame, least: float) -> DataFrame:
    """(node, label, n, gram, rank, at): of each text with n k-mers the rarest ones, their ranks and places. One of them is the
    first of the chain, in this order, of any pair that reaches the threshold."""
    shared = nodes.sparkSession.sparkContext.broadcast(_frequencies(nodes))
    types = {"node": pa.int64(), "label": pa.int64(), "n": pa.int32(), "gram": pa.int32(), "rank": pa.int32(), "at": pa.int32()}

    def run(batches):
        often = shared.value
        for b in batches:
            for part in slices(b, 2, 4 * BLOCK):
                kept = []
                for node, label, seq in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    v = _distinct(seq)
                    n = len(v)
                    at = np.lexsort((v, often[v & np.uint32(SLOTS - 1)]))[: n - int(np.ceil(least * n - 1e-9)) + 1]
                    m = len(at)
                    kept.append((np.full(m, node), np.full(m, label), np.full(m, n), v[at].view(np.int32), np.arange(m), at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*kept, strict=True), types.values(), strict=True)], names=list(types))

    return nodes.select("node", "label", "seq").mapInArrow(run, "node long, label long, n int, gram int, rank int, at int")


def _meeting(prefixes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that may reach the threshold: none that does is left out."""
    mixed = prefixes.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gram")
    own = prefixes.join(mixed, "gram", "left_semi")
    x, y = (own.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "n", "rank", "at")]) for side in "ab")
    # of the shorter text fewer k-mers are needed: even a partner of the same length must match 2 least / (1 + least) of it
    x = x.where(F.col("rank_a") <= F.col("n_a") - F.ceil(F.col("n_a") * (2 * least / (1 + least)) - 1e-6))
    n = F.col("n_a") + F.col("n_b")
    enough = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) >= n * (least / (1 + least)) - 1e-6
    band = F.ceil(n - n * (2 * least / (1 + least)) + 1e-6) + 1
    turned = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    meet = x.join(y, "gram").where(turned & (F.col("label_a") != F.col("label_b")) & enough & (F.abs(F.col("at_a") - F.col("at_b")) <= band))
    return meet.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of nodes, with the labels they have so far, and their similarity."""

    def run(batches):
        for b in batches:
            for part in slices(b, 4, 4 * BLOCK):
                s = [alike(_distinct(x), _distinct(y), least) for x, y in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(s, pa.float64())], names=["a", "b", "la", "lb", "similarity"])

    both = pairs.join(sequences.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")), "a").join(sequences.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")), "b")
    return both.select("a", "b", "la", "lb", "seq_a", "seq_b").mapInArrow(run, "a long, b long, la long, lb long, similarity double")


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) as a written table, and its path: the smallest node of each connected component. Labels spread over edges
    and jump to their label's label."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, path = write_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after, new_path = write_table(spread.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = after.where("label < old").limit(1).count()
        drop_table(spark, path)
        labels, path = after.select("node", "label"), new_path
        if not changed:
            return labels, path


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, rounds: int = 2) -> DataFrame:
    """Per document: doc_id, class_id (the smallest id of its class), kept (the first of its class)."""
    own = texts(docs, id_col, text_col)
    table, _ = write_table(_sketch_table(own), "sketches")
    flat = table.select(F.posexplode("buckets").alias("s", "bucket"), "digest", "doc_id", "n").groupBy("bucket", "digest").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("s").alias("s"))
    held = F.sum(F.lit(1)).alias("nodes")
    several = flat.groupBy("bucket").agg(held).where("nodes > 1").select("bucket")
    members, members_path = write_table(flat.join(several, "bucket", "left_semi").select("bucket", "node", "n"), "members")
    fits = (F.col("n") >= F.col("cn") * least) & (F.col("cn") >= F.col("n") * least)
    sequences, sequences_path = write_table(_sequences(own, members.select("node").distinct()), "sequences")
    tested, passing = None, [members_path, sequences_path]
    labels, labels_path = write_table(members.select("node").distinct().withColumn("label", F.col("node")), "labels")

    def settle(found: DataFrame) -> None:
        """Verify pairs (a, b, la, lb) and join the labels of those that are alike."""
        nonlocal tested, labels, labels_path
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        checked, path = write_table(_verified(found, sequences, least), "checked")
        passing.append(path)
        tested = checked.select("a", "b") if tested is None else tested.union(checked.select("a", "b"))
        links = checked.where(F.col("similarity") >= least).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        if not links.limit(1).count():
            return
        # components of what the round before left apart
        joined, joined_path = components(links)
        after, after_path = write_table(labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        for path in (joined_path, labels_path):
            drop_table(own.sparkSession, path)
        labels, labels_path = after, after_path

    for r in range(rounds):
        rows = members.join(labels, "node")
        draw = F.xxhash64("node", "bucket", F.lit(r)) if r else F.col("node")
        centre = F.min(F.struct(draw.alias("draw"), F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("label").alias("clabel")))
        centres = rows.groupBy("bucket").agg(centre.alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket", "c.*")
        near = rows.join(centres, "bucket").where(fits & (F.col("label") != F.col("clabel")))
        settle(near.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), F.least("label", "clabel").alias("la"), F.greatest("label", "clabel").alias("lb")).distinct())
    # the rest exactly: all nodes of buckets that still hold several components
    rows = members.join(labels, "node")
    several = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    apart = labels.join(rows.join(several, "bucket", "left_semi").select("node").distinct(), "node").join(sequences, "node")
    prefixes, path = write_table(_prefixes(apart, least), "prefixes")
    passing.append(path)
    left, path = write_table(_meeting(prefixes, least), "meeting")
    passing.append(path)
    few = 32  # pairs a label verifies before labels are joined, so that large classes don't verify all of theirs
    while True:
        a, b = (labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
        open_ = left.join(a, "a").join(b, "b").where("label_a <> label_b")
        if tested is not None:
            open_ = open_.join(tested, ["a", "b"], "left_anti")
        left, path = write_table(open_.select("a", "b", F.least("label_a", "label_b").alias("la"), F.greatest("label_a", "label_b").alias("lb")), "open")
        passing.append(path)
        if not left.limit(1).count():
            break
        # some few pairs of each label, drawn by a hash: a label's pairs needn't meet, and in the end all are drawn
        parts = F.greatest(F.ceil(F.col("pairs") / few), F.lit(1))
        some = left.join(left.groupBy("la").agg(F.count("*").alias("pairs")), "la").where(F.pmod(F.xxhash64("a", "b", F.lit(few)), parts) == 0)
        settle(some.select("a", "b", "la", "lb"))
        left, few = left.select("a", "b"), few * 8
    for path in passing:  # what is returned reads the sketches and labels only
        drop_table(own.sparkSession, path)
    nodes = table.groupBy("digest").agg(F.min("doc_id").alias("node")).join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("class_id"))
    # a table of its own, so that the many copies of one text are a side of the join that can be split
    nodes, _ = write_table(nodes, "classes")
    drop_table(own.sparkSession, labels_path)
    return table.select("doc_id", "digest").join(nodes, "digest").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
