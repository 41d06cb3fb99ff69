"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct shingles of five words. Equal sets are one node from the start. Two
nodes link when the Jaccard similarity of their sets is MIN_SIMILARITY or more.

Candidates. A sketch counts all shingles of all documents in a fixed number of slots; shingles in slots far
above the mean form the frequent class, all others the rare one. A set is ordered rare class first, then by hash.
As a linked set misses at most `slack` = n - ceil(0.8 n) of its n shingles, two linked sets share a
signature out of their prefixes, if a prefix holds slack + 1 rare shingles, each of them a signature; where a
set has fewer, the prefix is extended by frequent shingles, which only count in combination: they are dealt to
groups by hash, and each pair within a group is a signature. A group's first shingle adds nothing to the
prefix and each further one counts as one, so that a shared signature remains whichever `slack` shingles
are missing. The number of groups follows the class of the set's size (classes grow by SIZE_STEP, so linked
sets are in the same class or in neighbours; a set gives the pairs of its own class and of the next one).

The sketch only guesses: in a large corpus a slot's mean hides shingles that thousands of sets share. So the rare signatures
are counted exactly. Those of more than HEAVY sets are made frequent, and the sets that have one in their prefix get new
signatures, with prefixes extended accordingly; they learn which of their shingles are heavy by a join. That is repeated, at
most ROUNDS times, while it finds heavy signatures. Any division into classes gives right results, if it is the same for all sets.

A set is named by 128 bits of a hash, a shingle by 64; sets are compared by all of these.

A pair is only compared if the places of the signature in both sets leave room for enough shared shingles.

Verification. Within a signature every node is compared with the most central one; the links found join
nodes to components, and then the pairs of a signature whose nodes are still in different components are
compared as well. Pairs within a component need no comparison: more links don't change it. So no pairs of
a large group of copies are listed, yet no component is missed.

Defined results: null text, or text without words, has an empty set and is its own component; documents of
fewer than five words have their whole sequence as one shingle; equal texts are linked; rows with one doc_id are
one member of each of their texts' components; null ids don't count as the smallest one; a very long text is one
set like any other, its signatures grow with a fifth of its length; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, marked, read_table, written
from .components import components

SHINGLE_WORDS = 5
#: The least similarity, in hundredths.
MIN_SIMILARITY = 80
#: Slots of the sketch of shingle counts (2 to this power).
SKETCH_BITS = 18
SIZE_STEP = 1.26
#: Groups of frequent shingles as a share of the smallest set of a size class.
GROUP_SHARE = 0.1
#: Sets that may share a rare signature before it is made frequent, and how often signatures are made anew for that.
HEAVY = 1000
ROUNDS = 3
#: Names of sets that a task remembers, so as not to give a copy's signatures again.
SEEN = 1_000_000

_U = np.uint64
_SHIFT = _U(64 - SKETCH_BITS)
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_EMPTY = np.empty(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64) if n else _EMPTY
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = n - SHINGLE_WORDS + 1
    total = h[:m] * _ODD[0]
    for i in range(1, SHINGLE_WORDS):
        total = total + h[i : i + m] * _ODD[i]
    return np.unique(_mix(total))


def slack(n: int) -> int:
    """Shingles of a set of n that a linked set may miss."""
    return n - (MIN_SIMILARITY * n + 99) // 100


_BOUNDS = SIZE_STEP ** np.arange(200)


def size_class(n: int) -> int:
    return int(np.searchsorted(_BOUNDS, n, side="right"))


def signatures(s: np.ndarray, frequent: np.ndarray, heavy: np.ndarray = _EMPTY) -> tuple[np.ndarray, np.ndarray, int]:
    """The signatures of a set (sorted hashes), given the sketch's slots of the frequent class and its heavy shingles (sorted), and their places.

    The place of a rare shingle is the number of shingles before it, that of a combination the number of the set's rare
    shingles: if no signature with an earlier place is shared, the linked set misses that many. Last, the
    number of rare shingles among the signatures; they come first.
    """
    n = len(s)
    if n <= 1 or slack(n) == 0 and slack(n + 1) == 0:
        return _EMPTY, _EMPTY, 0  # too small to be linked with a different set
    need = slack(n) + 1
    often = frequent[s >> _SHIFT]
    if len(heavy):
        often = often | np.isin(s, heavy, assume_unique=True)
    rare = s[~often][:need]
    places = np.arange(len(rare), dtype=np.uint64)
    if len(rare) == need:
        return rare, places, need
    out, freq, more = [], s[often], need - len(rare)
    own = size_class(n)
    for c in (own, own + 1):
        groups = max(1, int(GROUP_SHARE * SIZE_STEP ** (c - 2)))
        g = (freq % _U(groups)).astype(np.int64)
        counts = np.ones(len(freq), np.int64)
        counts[np.unique(g, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(counts), more)) + 1
        order = np.argsort(g[:end], kind="stable")
        p, g = freq[:end][order], g[:end][order]
        salt = _U(c * int(_ODD[2]) & 0xFFFFFFFFFFFFFFFF)
        lag = 1
        while lag < len(p) and (same := g[lag:] == g[:-lag]).any():
            out.append(_mix(p[:-lag][same] * _ODD[0] + p[lag:][same] * _ODD[1] + salt))
            lag += 1
    pairs = np.unique(np.concatenate(out))
    return np.concatenate([rare, pairs]), np.concatenate([places, np.full(len(pairs), len(rare), np.uint64)]), len(rare)


def set_id(s: np.ndarray) -> bytes:
    """The name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


class _Seen:
    """Names that a task has met; forgets them when they become too many."""

    def __init__(self):
        self.names: set[bytes] = set()

    def new(self, name: bytes) -> bool:
        if name in self.names:
            return False
        if len(self.names) >= SEEN:
            self.names.clear()
        self.names.add(name)
        return True


_NODES = "text_hash long, n long, node binary, chunk int, counts array<int>"
_CHUNK = 4096


def nodes_and_sketch(docs: DataFrame) -> DataFrame:
    """A row (doc_id, text_hash, n, node) for every document; rows (chunk, counts) with each task's part of the sketch.

    A task counts a set once, however many copies it meets.
    """
    schema = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        seen = _Seen()
        names = ["doc_id", "text_hash", "n", "node", "chunk", "counts"]
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            ns, ids = [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                ns.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                if len(s) and seen.new(ids[-1]):
                    slots, times = np.unique(s >> _SHIFT, return_counts=True)
                    sketch[slots.astype(np.int64)] += times
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int32()))], names=names)
        if kind is not None:
            parts = np.minimum(sketch, 2**31 - 1).astype(np.int32).reshape(-1, _CHUNK)
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), *[pa.nulls(k, pa.int64())] * 2, pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(list(parts), pa.list_(pa.int32()))], names=names)

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, f"doc_id {schema}, {_NODES}")


def frequent_slots(sketch: DataFrame) -> np.ndarray:
    """Slots whose count is far above what chance gives a slot: the frequent class, as a fixed number of flags."""
    slots = sketch.select("chunk", F.posexplode("counts").alias("i", "c")).filter(F.col("c") > 0)
    slots = written(slots.groupBy((F.col("chunk") * _CHUNK + F.col("i")).alias("slot")).agg(F.sum("c").alias("c")), "sketch")
    mean = (slots.agg(F.sum("c")).first()[0] or 0) / (1 << SKETCH_BITS)
    flags = np.zeros(1 << SKETCH_BITS, bool)
    for r in slots.filter(F.col("c") > mean + 6 * mean**0.5 + 30).select("slot").collect():
        flags[r["slot"]] = True
    discard(slots)
    return flags


_SIGNATURES = "sig long, node binary, n int, p int, k int"


def _signature_rows(found: list[tuple[bytes, int, tuple[np.ndarray, np.ndarray, int]]]) -> pa.RecordBatch:
    """Rows of _SIGNATURES for (name, size, signatures) of sets."""
    times = [len(x[2][0]) for x in found]
    at = np.repeat(np.arange(len(found)), times)
    sizes, rare = np.array([x[1] for x in found], np.int32), np.array([x[2][2] for x in found], np.int32)
    names = pa.array([x[0] for x in found], pa.binary()).take(pa.array(at))
    sigs = np.concatenate([_EMPTY, *(x[2][0] for x in found)]).view(np.int64)
    places = np.concatenate([_EMPTY, *(x[2][1] for x in found)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(sigs), names, pa.array(sizes[at]), pa.array(places), pa.array(rare[at])], names=["sig", "node", "n", "p", "k"])


def all_signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, node, n, p, k) of every set; a task gives a set's signatures once.

    p is the signature's place, k the number of rare shingles among the set's signatures: p < k tells a shingle from a combination.
    """
    packed = np.packbits(frequent).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        seen = _Seen()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                if len(s) and seen.new(name := set_id(s)):
                    found.append((name, len(s), signatures(s, flags)))
            yield _signature_rows(found)

    return arrow_map(docs.select("text"), run, _SIGNATURES)


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, shingles) of the documents named in reps (doc_id); others may be among them, and a set may come twice."""
    rows, choose = marked(docs.select("doc_id", "text"), reps.select("doc_id"), ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, blobs = [], []
            for text in batch.column("text").take(pa.array(choose(batch))):
                s = shingles(text.as_py())
                if len(s) and seen.new(name := set_id(s)):
                    ids.append(name)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    return arrow_map(rows.select("text", "slot"), run, "node binary, shingles binary")


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def shared_of(sigs: DataFrame) -> DataFrame:
    """(sig, c, rare) of the signatures that come more than once. Copies of a set count as often as tasks met them: for cost, not for results."""
    counts = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("p") < F.col("k")).alias("rare"))
    return written(counts.filter("c > 1"), "shared")


def without_heavy(sigs: DataFrame, docs: DataFrame, reps: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """sigs, with the signatures made anew for the sets that have a rare signature of more than HEAVY sets, and the shared ones."""
    packed = np.packbits(frequent).tobytes()
    shared, heavy = shared_of(sigs), None
    for _ in range(ROUNDS):
        more = written(shared.filter(F.col("rare") & (F.col("c") > HEAVY)).select("sig"), "heavy")
        if more.isEmpty():
            discard(more)
            break
        heavy = more if heavy is None else written(heavy.union(more).distinct(), "heavy")
        nodes = written(sigs.filter(F.col("p") < F.col("k")).join(more, "sig", "left_semi").select("node").distinct(), "wanted")
        # A set may come twice, and sets that nobody asked for may come along.
        sets = written(sets_of(docs, reps.join(nodes, "node")).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, blob in zip(batch.column("node"), batch.column("shingles")):
                    s = _unpack(blob.as_py()).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([name.as_py()] * len(s), pa.binary())], names=["sig", "node"])

        def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            for batch in batches:
                found = []
                for name, blob, own in zip(batch.column("node"), batch.column("shingles"), batch.column("own")):
                    s, h = _unpack(blob.as_py()), np.sort(np.array(own.as_py() or [], np.int64).view(np.uint64))
                    found.append((name.as_py(), len(s), signatures(s, flags, h)))
                yield _signature_rows(found)

        # At most a set's own shingles are collected.
        own = arrow_map(sets, split, "sig long, node binary").join(heavy, "sig", "left_semi").groupBy("node").agg(F.collect_list("sig").alias("own"))
        new = arrow_map(sets.join(own, "node", "left").select("node", "shingles", "own"), anew, _SIGNATURES)
        rest = sigs.join(nodes, "node", "left_anti").select("sig", "node", "n", "p", "k")
        fresh = written(rest.union(new), "signatures")
        discard(sigs, shared, sets, nodes)
        sigs, shared = fresh, shared_of(fresh)
    return sigs, shared


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    at = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    to = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(at, "a").join(to, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = b"", _EMPTY
        for batch in batches:
            keep = []
            for i, (sa, sb) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
                if sb != last:
                    last, y = sb, _unpack(sb)
                x = _unpack(sa)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= MIN_SIMILARITY * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return arrow_map(both, run, "a binary, b binary")


def _close(n: str, p: str, m: str, q: str):
    """Whether sets of n and m that share a signature at places p and q, and none before, may be linked."""
    most = F.least(F.col(n) - F.col(p), F.col(m) - F.col(q))
    return 100 * most >= MIN_SIMILARITY * (F.col(n) + F.col(m) - most)


def _need(n: str):
    """The number of rare shingles that make a prefix, as `signatures` has it."""
    return F.col(n) - F.floor((MIN_SIMILARITY * F.col(n) + 99) / 100) + 1


def links(docs: DataFrame, nodes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(node, root) of all nodes that are linked with another one."""
    reps = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sigs, shared = without_heavy(written(all_signatures(docs, frequent), "signatures"), docs, reps, frequent)
    # A set that several tasks met comes with each of them: its copies alone don't make a signature shared.
    index = written(sigs.join(shared.select("sig"), "sig").distinct(), "index")
    discard(sigs, shared)

    central = index.groupBy("node").agg((-F.count(F.lit(1)) / F.first("n")).alias("rank"))
    ranked = index.join(central, "node")
    pivots = ranked.groupBy("sig").agg(F.min(F.struct("rank", "node", "n", "p")).alias("x"))
    pivots = pivots.select("sig", F.col("x.node").alias("b"), F.col("x.n").alias("m"), F.col("x.p").alias("q"))
    stars = index.join(pivots, "sig").filter((F.col("node") != F.col("b")) & _close("n", "p", "m", "q")).select(F.col("node").alias("a"), "b")
    tried = written(stars.select("a", "b").distinct(), "pairs")

    def check(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = written(reps.join(named, "node"), "wanted")
        # A set may come twice, where the bitmap marks a copy by chance: its links then come twice too.
        sets = written(sets_of(docs, wanted), "sets")
        found = written(verified(pairs, sets), "links")
        discard(sets, wanted)
        return found

    found = check(tried)
    roots = components(found)

    # Pairs of a signature that are still in different components.
    labelled = index.join(roots.withColumnRenamed("root", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    labelled = written(labelled, "labelled")
    # Of the combinations, first those nodes go that can't be linked even with the signature's smallest set: they may be very many.
    smallest = labelled.groupBy("sig").agg(F.min("n").alias("least"))
    room = 100 * (F.col("n") - F.col("p")) >= MIN_SIMILARITY * (F.col("least") + F.col("p"))
    alive = written(labelled.join(smallest, "sig").filter((F.col("p") < F.col("k")) | room).drop("least"), "alive")
    label = F.xxhash64("c")
    split = alive.groupBy("sig").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi").select("sig")
    rest = alive.join(split, "sig")
    x = rest.select("sig", F.col("node").alias("a"), "n", "p", "k", "c")
    y = rest.select("sig", F.col("node").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("k").alias("l"), F.col("c").alias("d"))
    sizes = 100 * F.least("n", "m") >= MIN_SIMILARITY * F.greatest("n", "m")
    pairs = x.join(y, (x["sig"] == y["sig"]) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & sizes & ((F.col("p") < F.col("k")) | _close("n", "p", "m", "q")))
    # Shared shingles: the shared rare signatures, and of the others at most those after the rare ones in one of the sets, or
    # in both if both sets gave all their rare shingles.
    pairs = pairs.groupBy("a", "b", "n", "m", "k", "l").agg(F.count_if(F.col("p") < F.col("k")).alias("shared"))
    all_rare = (F.col("k") < _need("n")) & (F.col("l") < _need("m"))
    rest_of = [F.col("n") - F.col("k"), F.col("m") - F.col("l")]
    most = F.least("n", "m", F.col("shared") + F.when(all_rare, F.least(*rest_of)).otherwise(F.greatest(*rest_of)))
    pairs = pairs.filter(100 * most >= MIN_SIMILARITY * (F.col("n") + F.col("m") - most)).select("a", "b")
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(index, labelled, alive)
    if pairs.isEmpty():
        discard(tried, pairs, found)
        return roots
    more = check(pairs)
    out = components(found.union(more))
    discard(tried, pairs, found, more, roots)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, class (the same for linked sets, null for an empty one), component_id of every document."""
    base = docs.select("doc_id", "text")
    first = written(nodes_and_sketch(base), "nodes")
    nodes = first.filter(F.col("chunk").isNull()).select("doc_id", "text_hash", "n", "node")
    frequent = frequent_slots(first.filter(F.col("chunk").isNotNull()).select("chunk", "counts"))
    roots = links(base, nodes, frequent)
    least = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    by_root = written(least.join(roots, "node").groupBy("root").agg(F.min("least").alias("c")), "classes")
    named = least.join(roots.join(by_root, "root"), "node", "left")
    named = named.select("node", F.coalesce("root", "node").alias("class"), F.coalesce("c", "least").alias("c"))
    # Tables of their own: only a join of two plain inputs is split where many rows share a root or a node.
    named = written(named, "named")
    discard(by_root, roots)
    return nodes.join(named, "node", "left").select("doc_id", "text_hash", "n", "class", F.coalesce("c", "doc_id").alias("component_id"))


def _row_key(doc_id: str, text_hash) -> list:
    """What tells documents apart, as columns that equal each other where the documents do: a null id is one of them."""
    return [F.col(doc_id).isNull().alias("_null"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), text_hash.alias("_hash")]


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the smallest doc_id's (null ids last), then by text. Rows without words all stay.

    Rows that are equal in id and text are copies too. They are combined before they are shuffled, by the key of the join that
    follows, so a row's text is shuffled once, and however many equal rows there are, a task sends one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("r")
    reps = classes(docs).filter(F.col("class").isNotNull()).groupBy("class").agg(first)
    kept = reps.select("r.*").select(*_row_key("doc_id", F.col("text_hash")))
    has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(has_words).select(*_row_key("doc_id", F.xxhash64("text")), F.struct(*docs.columns).alias("_row"))
    one = rows.groupBy("_null", "_id", "_hash").agg(F.first("_row").alias("_row"))
    out = one.join(kept, ["_null", "_id", "_hash"]).select("_row.*")
    return out.union(docs.filter(~has_words))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return classes(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))
