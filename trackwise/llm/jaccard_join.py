"""N-gram Jaccard join by vertical partitioning.

Shingles are ordered globally: rare ones first, by 64-bit fingerprint, then the
corpus's common ones by ascending frequency. (Any order gives the same result;
this one keeps groups small. The counts that order the common ones are near enough
for that, not exact: shingles that a task sees once in two million aren't counted,
and the table of common ones is bounded by ``COMMON``; what they leave out is
merely ordered as rare.) Cutting an order into fragments cuts every document's set.

1. Documents with equal sets become one node, numbered by 64 bits; sets that share
   a number but not 64 bits more get numbers of their own.
2. Candidates. The symmetric difference of two linked sets has at most
   (1-t)/(1+t) * (|a|+|b|) shingles, so cut into one fragment more than that, one
   fragment at least is equal in both. Where that leaves fragments of
   ``LONG`` shingles or more (thresholds from 0.87 on), equal fragments of the
   fingerprint range are the keys; size classes a factor t apart fix the number of
   fragments, and a node has keys for its own class and the next larger one. They are
   made with the nodes, in one reading of the texts. For lower thresholds, keys are
   the shingles of the first fragment of the global order, the first
   ``n - ceil(t*n) + 1``, of which linked sets share one. Nodes with a key in common
   are a group, and are tied to its smallest node. Keys that a sketch of frequent
   items finds to be frequent (a bounded list) are grouped by partial aggregates,
   the others in sorted partitions, so no key is a task of its own.
3. Each tied pair is tested by sizes and by a parity sketch of both sets, whose
   differing bits never exceed the sets' symmetric difference; for pairs that
   may link, partial overlaps are counted for each fragment of the fingerprint
   range separately, summed per pair and tested in integers.
4. Groups of three and more nodes that aren't in one component yet are open. In
   those of up to ``BLOCK`` nodes, pairs across components are compared by size and
   sketch, and the rest by step 3: first only the most alike pairs, a forest over the
   group's components, which joins what belongs together, then all pairs that are
   left. In larger ones, each time the nodes outside the component of the smallest
   node get a hub of their own, and are tied to it as in 3.
5. Large groups that are open then are narrowed: shingles are counted over their
   nodes, in ``BUCKETS`` buckets of a hash (a table of fixed size), and a node is
   listed under the first ``n - ceil(t*n) + 1`` shingles of its own in ascending
   order of these counts. Nodes that could link share one. Near copies that differ
   too much come under words of their own, and have nothing in common any more; the
   more shingles there are to a bucket, the larger a family must be for that. The
   groups of that list are compared as in 4, the nodes outside the largest component
   with all, in pairs of blocks of ``BLOCK`` nodes.
6. Components are contracted in a distributed way.

No link is lost: both ends of a link are in one group, and if they aren't in one
component they are in one group of the list of step 5, where each such pair is
tested. That step's work is the product of a group's size and of its nodes outside
the largest component, which is no bound for a group of many small components.

Defined cases: null, empty or blank text has an empty set and links with
nothing; with fewer words than ``k`` the whole sequence is the one shingle;
repeated doc_ids are judged as separate rows of one identifier; rows with a null
doc_id don't take part and get a null component; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, connected_components
from .textkernel import WordHashes, blank_words, mix, shingle_hashes, signed

#: fragments in which the overlaps of a pair are counted separately
FRAGMENTS = 4
#: shingles in a fragment from which equal fragments are the keys
LONG = 7
#: nodes in a block of a large group
BLOCK = 512
#: most nodes whose documents are found by a shipped list (4 MB) instead of a join of the texts
LISTED = 1 << 19
#: buckets in which the shingles of open groups are counted
BUCKETS = 1 << 20
#: shingles counted at once in a task, and most entries of the table of common shingles
COUNTED, COMMON = 1 << 21, 1 << 20


def _set_of(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    return shingle_hashes(cache.of(blank_words(text, lower=True)), k)


_SALT = np.uint64(0x5851F42D4C957F2D)


def _node(s: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Identity of a set: two order-free sums of mixed fingerprints, with its size."""
    if len(s) == 0:
        return None, None
    with np.errstate(over="ignore"):
        mixed = mix(s)
        sums = np.array([mixed.sum(dtype=np.uint64), mix(mixed ^ _SALT).sum(dtype=np.uint64)]) + np.uint64(len(s))
        node, check = signed(mix(sums)).tolist()
    return node, check


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """64-bit words of at least four bits for each shingle; a bit is the parity of the shingles that fall on it."""
    bits = 64
    while bits < 4 * len(s):
        bits *= 2
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer words: positions modulo the smaller size."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0) if len(sketch) > words else sketch


READ = ["doc_id", "n_shingles", "node", "check", "sketch", "keys", "gram", "times"]


def _identify(k: int, keys_of):
    """A row for each document; the sketch and keys with a node's first row in the task. Without keys_of, rows of shingles seen twice as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, held, size = WordHashes(), set(), [], 0

        def counted(ids: pa.DataType) -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            grams, times = grams[times > 1], times[times > 1]
            none = [pa.nulls(len(grams), t) for t in (ids, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*none, pa.array(signed(grams)), pa.array(times.astype(np.int64))], READ)

        for batch in batches:
            sizes, nodes, checks, sketches, keys = [], [], [], [], []
            for text in batch["text"].to_pylist():
                s = _set_of(text, k, cache)
                node, check = _node(s)
                sketch = own = None
                if node is not None and (node, check) not in seen:
                    seen.add((node, check))
                    sketch = parity_sketch(s).tobytes()
                    if keys_of is not None:
                        own = keys_of(s)
                    else:
                        held.append(s)
                        size += len(s)
                sizes.append(len(s))
                nodes.append(node)
                checks.append(check)
                sketches.append(sketch)
                keys.append(own)
                if size >= COUNTED:
                    yield counted(batch["doc_id"].type)
                    held, size = [], 0
            n = len(sizes)
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, READ)
            ids = batch["doc_id"].type
        if held:
            yield counted(ids)

    return run


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1


def size_classes(num: int, den: int, most: int = 1 << 40) -> list[int]:
    """Upper sizes of the classes, each at least 1/t of the one before: partners are at most one class apart."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, -(-tops[-1] * den // num)))
    return tops


def _equal_fragments(num: int, den: int):
    """Keys of a set: hashes of its fragments, for its size class and the next one."""
    tops = np.array(size_classes(num, den), np.int64)

    def keys(s: np.ndarray) -> np.ndarray:
        mine, out = int(np.searchsorted(tops, len(s))), []
        with np.errstate(over="ignore"):
            sums = np.zeros(len(s) + 1, np.uint64)
            np.cumsum(mix(s), out=sums[1:])
            for c in (mine, mine + 1):
                parts = (den - num) * 2 * int(tops[c]) // (den + num) + 1
                width = np.uint64(min((1 << 64) // parts, (1 << 64) - 1))
                edge = np.append(np.searchsorted(s, np.arange(parts, dtype=np.uint64) * width), len(s))
                inside = sums[edge[1:]] - sums[edge[:-1]] + np.diff(edge).astype(np.uint64)
                out.append(signed(mix(mix(np.arange(parts, dtype=np.uint64) + np.uint64(c << 40)) + inside)))
        return np.concatenate(out)

    return keys


def _prefixes(k: int, num: int, den: int, shipped):
    """(node, check, keys): the first fragment of the global order, with a node's first row in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = shipped.value
        cache, seen = WordHashes(), set()
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                s = _set_of(text, k, cache)
                node = _node(s)
                if node[0] is None or node in seen:
                    continue
                seen.add(node)
                first = prefix_length(len(s), num, den)
                if len(common):
                    where = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    frequent = common[where] == s
                    rare = s[~frequent]
                    if len(rare) < first:
                        own = where[frequent]
                        rare = np.concatenate([rare, s[frequent][np.argsort(place[own])]])
                    s = rare
                out.append((*node, signed(s[:first])))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["node", "check", "keys"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, node) in; distinct rows of grams with several nodes out, with their smallest node."""
    carry: tuple[int, int] | None = None  # gram and smallest node of the group at the end of the last batch
    sent, last = False, None
    for batch in batches:
        gram, node = batch["gram"].to_numpy(), batch["node"].to_numpy()
        if not len(gram):
            continue
        before_gram = np.append(gram[0] if carry is None else carry[0], gram[:-1])
        before_node = np.append(node[0] if last is None else last, node[:-1])
        new = gram != before_gram
        if carry is None:
            new[0] = True
        again = ~new & (node == before_node)
        at = np.maximum.accumulate(np.where(new, np.arange(len(gram)), -1))
        hub = np.where(at >= 0, node[np.maximum(at, 0)], carry[1] if carry else 0)
        other = ~again & (hub != node)
        # a group's hub is sent with its first other node
        first = other.copy()
        key = np.where(at >= 0, at, -1)[other]
        first[other] = np.append(True, key[1:] != key[:-1]) if len(key) else []
        if len(key) and key[0] == -1 and sent:
            first[np.flatnonzero(other)[0]] = False
        if at[-1] >= 0:
            sent = bool(other[at[-1] :].any())
        else:
            sent = sent or bool(other.any())
        carry, last = (int(gram[-1]), int(hub[-1])), int(node[-1])
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])) for x, y in ((gram[first], gram[other]), (hub[first], hub[other]), (hub[first], node[other]))], ["gram", "hub", "node"])


def _possible(num: int, den: int):
    """Pairs that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch["size_a"].to_numpy(), batch["size_b"].to_numpy()
            most = (den - num) * (na + nb) // (den + num)
            keep = np.abs(na - nb) <= most
            sa, sb = batch["sketch_a"], batch["sketch_b"]
            for i in np.flatnonzero(keep).tolist():
                a, b = (np.frombuffer(x[i].as_py(), np.uint64) for x in (sa, sb))
                words = min(len(a), len(b))
                keep[i] = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    return run


def _forest(a: np.ndarray, b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The pairs, from the least differing on, that join components not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = []
    for i in np.lexsort((np.maximum(a, b), np.minimum(a, b), differ)).tolist():
        x, y = find(int(comp_a[i])), find(int(comp_b[i]))
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def _across(num: int, den: int, forest: bool):
    """Pairs across components that may link, of groups (gram, x, y) that come one after another; forest: only those that join components.

    side 0 stands left, 1 right, 2 on both sides.
    """

    def pairs(node, comp, size, side, sketch) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        raw = [np.frombuffer(x, np.uint64) for x in sketch]
        out_a, out_b, out_d = [], [], []
        for words in sorted({len(x) for x in raw}):
            # each pair once, at the smaller width of the two
            li = np.array([i for i in left if len(raw[i]) >= words], np.int64)
            ri = np.array([i for i in right if len(raw[i]) >= words], np.int64)
            if not len(li) or not len(ri):
                continue
            fl, fr = np.stack([folded(raw[i], words) for i in li]), np.stack([folded(raw[i], words) for i in ri])
            thin_l, thin_r = np.array([len(raw[i]) == words for i in li]), np.array([len(raw[i]) == words for i in ri])
            for i, row in zip(li.tolist(), range(len(li)), strict=True):
                ok = (comp[ri] != comp[i]) & (thin_r | thin_l[row])
                most = (den - num) * (size[ri] + size[i]) // (den + num)
                ok &= np.abs(size[ri] - size[i]) <= most
                at = np.flatnonzero(ok)
                if len(at):
                    differ = np.bitwise_count(fr[at] ^ fl[row]).sum(axis=1)
                    at, differ = at[differ <= most[at]], differ[differ <= most[at]]
                    out_a.append(np.full(len(at), i))
                    out_b.append(ri[at])
                    out_d.append(differ)
        if not out_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if forest:
            keep = _forest(node[a], node[b], comp[a], comp[b], np.concatenate(out_d))
            a, b = a[keep], b[keep]
        a, b = node[a], node[b]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ("gram", "x", "y", "node", "comp", "size", "side")
        rest = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def chunks():
            for batch in batches:
                yield [batch[c].to_numpy() for c in cols] + [np.array([*batch["sketch"].to_pylist(), None], object)[:-1]]
            yield None

        for chunk in chunks():
            if chunk is None:
                done, rest = rest, None
            else:
                if rest is not None:
                    chunk = [np.concatenate([r, c]) for r, c in zip(rest, chunk, strict=True)]
                if not len(chunk[0]):
                    continue
                tail = np.flatnonzero(np.any([c[:-1] != c[1:] for c in chunk[:3]], axis=0))
                cut = int(tail[-1]) + 1 if len(tail) else 0
                done, rest = [c[:cut] for c in chunk], [c[cut:] for c in chunk]
            if done is None or not len(done[0]):
                continue
            edge = np.concatenate([[0], np.flatnonzero(np.any([c[:-1] != c[1:] for c in done[:3]], axis=0)) + 1, [len(done[0])]])
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                found = pairs(*(c[low:high] for c in done[3:]))
                if len(found[0]):
                    held.append(found)
                if sum(len(h[0]) for h in held) > 50_000:
                    yield flush()
        if held:
            yield flush()

    return run


def _cut(s: np.ndarray, fragments: int) -> list[np.ndarray]:
    """A set by fragment of the fingerprint range."""
    starts = np.arange(fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments if fragments > 1 else 0)
    edge = np.append(np.searchsorted(s, starts), len(s))
    return [signed(s[edge[f] : edge[f + 1]]) for f in range(fragments)]


def _sets(k: int, fragments: int, shipped=None):
    """(doc_id, check, frag, part): the sets of rows (h, doc_id, text) by fragment; with a list, of the rows whose h is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            at = np.arange(batch.num_rows)
            if shipped is not None:
                listed, h = shipped.value, batch["h"].to_numpy()
                at = np.flatnonzero(listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h) if len(listed) else at[:0]
            checks, parts = [], []
            for text in batch["text"].take(pa.array(at)).to_pylist():
                s = _set_of(text, k, cache)
                checks += [_node(s)[1]] * fragments
                parts += _cut(s, fragments)
            rows = pa.array(np.repeat(at, fragments))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(rows), pa.array(checks, pa.int64()), pa.array(np.tile(np.arange(fragments), len(at)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "check", "frag", "part"])

    return run


def _bucket(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(shingles.view(np.uint64) ^ _SALT) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flat = batch["part"].flatten().to_numpy()
        times += np.bincount(_bucket(flat), minlength=BUCKETS)
    at = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(times[at])], ["bucket", "times"])


def _rarest(num: int, den: int, shipped):
    """(gram, node): the first fragment of each set in ascending order of the buckets' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = shipped.value
        for batch in batches:
            grams, nodes = [], []
            for node, part in zip(batch["node"].to_pylist(), batch["part"], strict=True):
                s = part.values.to_numpy()
                n = prefix_length(len(s), num, den)
                grams.append(s[np.lexsort((s, times[_bucket(s)]))[:n]])
                nodes.append(np.full(len(grams[-1]), node, np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(nodes))], ["gram", "node"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_type: str):
        self.spark, self.k, self.num, self.den, self.id_type = docs.sparkSession, k, num, den, id_type
        self.scratch = Scratch(self.spark, "jaccard-join")
        self.docs = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.known = self.docs.where("doc_id is not null")
        self.equal = den + num >= 2 * LONG * (den - num)
        keys_of = _equal_fragments(num, den) if self.equal else None
        shape = f"doc_id {id_type}, n_shingles long, node long, check long, sketch binary, keys array<long>, gram long, times long"
        read = self.scratch.write(self.docs.mapInArrow(_identify(k, keys_of), shape), "read")
        self.common = read.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where("times > 7")
        sets = read.where("node is not null")
        clashes = sets.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most")
        self.clashes = self.scratch.write(clashes.select("node", "least"), "clashes")
        self.renamed = not self.clashes.isEmpty()
        sets = self.numbered(sets)
        self.rows = sets.select("doc_id", "n_shingles", "node").unionByName(read.where("node is null and gram is null").select("doc_id", "n_shingles", "node"))
        sets = sets.where("doc_id is not null")
        self.owner = self.scratch.write(sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("check")), "owner")
        first = sets.where("sketch is not null").select("node", F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["node"])
        self.sketches = self.scratch.write(first, "sketches")
        self.keys = sets.where("keys is not null").select("node", "keys") if self.equal else None

    def numbered(self, sets: DataFrame) -> DataFrame:
        """sets (node, check, ...) with other numbers for all but one of the sets that share one."""
        if not self.renamed:
            return sets
        other = F.col("least").isNotNull() & (F.col("check") != F.col("least"))
        return sets.join(self.clashes, "node", "left").withColumn("node", F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("least")

    def frequent(self, rows: DataFrame, parts: int) -> DataFrame | None:
        """Keys (at most a thousand) that have more rows than half of what is due to a partition."""
        found = rows.agg(F.expr("approx_top_k(gram, 1000, 10000)").alias("top"), F.count("*").alias("n")).first()
        least = max(1000, found["n"] // (2 * min(parts, 1000)))
        top = [(x["item"],) for x in found["top"] or () if x["count"] > least]
        return self.spark.createDataFrame(top, "gram long") if top else None

    def groups(self) -> DataFrame:
        """(gram, hub, node) of keys of several nodes; hub is the smallest."""
        keys = self.keys
        if keys is None:
            top = self.common.orderBy(F.desc("times"), "gram").limit(COMMON).collect()
            grams = np.array([r["gram"] for r in top], np.int64).view(np.uint64)
            order = np.argsort(grams)
            shipped = self.spark.sparkContext.broadcast((grams[order], -order))  # ascending frequency
            keys = self.scratch.write(self.known.select("text").mapInArrow(_prefixes(self.k, self.num, self.den, shipped), "node long, check long, keys array<long>"), "keys")
            keys = self.numbered(keys).select("node", "keys")
        rows = keys.select(F.explode("keys").alias("gram"), "node")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        frequent = self.frequent(rows, parts)
        others = rows if frequent is None else rows.join(F.broadcast(frequent), "gram", "left_anti")
        found = others.repartition(parts, "gram").sortWithinPartitions("gram", "node").mapInArrow(_groups, "gram long, hub long, node long")
        if frequent is not None:
            many = rows.join(F.broadcast(frequent), "gram").select("gram", "node")
            hubs = many.groupBy("gram").agg(F.min("node").alias("hub"))
            found = found.unionByName(many.distinct().join(F.broadcast(hubs), "gram").select("gram", "hub", "node"))
        return self.scratch.write(found, "groups")

    def possible(self, pairs: DataFrame, name: str) -> DataFrame:
        side = lambda c: self.sketches.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return self.scratch.write(both.mapInArrow(_possible(self.num, self.den), "a long, b long"), name)

    def sets_of(self, nodes: DataFrame, fragments: int, name: str) -> DataFrame:
        """(node, frag, part) of nodes, from the texts of their first documents; few of them are found by a list, without a shuffle of texts."""
        wanted = self.scratch.write(nodes.join(self.owner, "node"), f"{name}-wanted")
        texts, shape = self.known.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text"), f"doc_id {self.id_type}, check long, frag int, part array<long>"
        if wanted.count() <= LISTED:
            listed = np.unique(wanted.select(F.xxhash64("doc_id").alias("h")).toArrow()["h"].to_numpy())
            sets, wanted = texts.mapInArrow(_sets(self.k, fragments, self.spark.sparkContext.broadcast(listed)), shape), F.broadcast(wanted)
        else:
            sets = texts.join(wanted.select("doc_id").distinct(), "doc_id").select("h", "doc_id", "text").mapInArrow(_sets(self.k, fragments), shape)
        out = self.scratch.write(sets.join(wanted, ["doc_id", "check"]).select("node", "frag", "part").dropDuplicates(["node", "frag"]), name)
        self.scratch.drop(f"{name}-wanted")
        return out

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose partial overlaps, summed over the fragments, reach the threshold."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = self.sets_of(wanted, FRAGMENTS, f"{name}-sets")
        side = lambda c: sets.select(F.col("node").alias(c), "frag", F.col("part").alias(f"part_{c}"))
        size = lambda c: self.sketches.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"))
        overlaps = pairs.join(side("a"), "a").join(side("b"), ["b", "frag"]).groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("part_a", "part_b"))).alias("same"))
        linked = overlaps.join(size("a"), "a").join(size("b"), "b").where(F.lit(self.den) * F.col("same") >= F.lit(self.num) * (F.col("size_a") + F.col("size_b") - F.col("same")))
        out = self.scratch.write(linked.select("a", "b"), f"{name}-links")
        self.scratch.drop(f"{name}-sets")
        return out

    def open(self, groups: DataFrame, comps: DataFrame, name: str, least: int) -> DataFrame:
        """(gram, node, comp, n) of groups of n nodes, at least so many, in several components; of groups with equal nodes one."""
        placed = groups.select("gram", "node").join(comps, "node", "left").select("gram", "node", F.coalesce("component", "node").alias("comp"))
        shape = placed.groupBy("gram").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("least"), F.expr("bit_xor(xxhash64(node))").alias("print"))
        chosen = shape.where(f"n >= {least} and low < high").groupBy("n", "least", "print").agg(F.min("gram").alias("gram"))
        chosen = self.scratch.write(chosen.select("gram", "n"), f"{name}-grams")
        return self.scratch.write(placed.join(chosen, "gram").select("gram", "node", "comp", "n"), f"{name}-open")

    def tied_again(self, open_: DataFrame) -> DataFrame:
        """Pairs of each group's nodes outside the component of its smallest node with the smallest of them."""
        base = open_.groupBy("gram").agg(F.min_by("comp", "node").alias("base"))
        rest = open_.join(base, "gram").where("comp <> base")
        hubs = rest.groupBy("gram").agg(F.min("node").alias("hub"), F.min_by("comp", "node").alias("hub_comp"))
        pairs = open_.join(hubs, "gram").where("comp <> hub_comp")
        return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    def narrowed(self, open_: DataFrame) -> DataFrame:
        """(gram, node): of the open nodes, the shingles of their first fragment in ascending order of their counts among these nodes."""
        sets = self.sets_of(open_.select("node").distinct(), 1, "open-sets")
        counts = sets.select("part").mapInArrow(_bucket_counts, "bucket int, times long").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
        times = np.zeros(BUCKETS, np.int64)
        times[counts["bucket"].to_numpy()] = counts["times"].to_numpy()
        shipped = self.spark.sparkContext.broadcast(times)
        out = self.scratch.write(sets.select("node", "part").mapInArrow(_rarest(self.num, self.den, shipped), "gram long, node long"), "narrowed")
        self.scratch.drop("open-sets")
        return out

    def across(self, open_: DataFrame, forest: bool) -> DataFrame:
        """Pairs, of each group's nodes outside its largest component with all, that sizes and sketches don't rule out."""
        open_ = open_.select("gram", "node", "comp")
        shape = open_.groupBy("gram", "comp").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max_by("comp", F.struct("n", "comp")).alias("base"), F.sum("n").alias("n"), F.max("n").alias("most"))
        shape = shape.select("gram", "base", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("lefts"), F.ceil(F.col("n") / BLOCK).alias("rights"))
        rows = open_.join(shape, "gram").withColumns({"hash": F.xxhash64("node"), "rest": F.col("comp") != F.col("base")})
        left = "if(rest, transform(sequence(0L, rights - 1), y -> struct(pmod(hash, lefts) as x, y as y, 0L as side)), array())"
        right = "transform(sequence(0L, lefts - 1), x -> struct(x as x, pmod(hash, rights) as y, 1L as side))"
        deal = f"if(lefts = 1 and rights = 1, array(struct(0L as x, 0L as y, if(rest, 2L, 1L) as side)), concat({left}, {right}))"
        rows = rows.join(self.sketches, "node").select("gram", F.inline(F.expr(deal)), "node", "comp", "size", "sketch")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, "gram", "x", "y").sortWithinPartitions("gram", "x", "y")
        return dealt.mapInArrow(_across(self.num, self.den, forest), "a long, b long").distinct()

    def merged(self, comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components after more links."""
        side = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
        joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
        upper = connected_components(joined, self.scratch, name)
        up = upper.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        old = comps.join(up, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
        new = upper.join(comps.select("node"), "node", "left_anti").select("node", "component")
        return self.scratch.write(old.unionByName(new), f"{name}-merged")

    def components(self) -> DataFrame:
        """(node, component) of all nodes with links."""
        scratch, groups = self.scratch, self.groups()
        ties = self.possible(groups.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "ties")
        comps, tested = connected_components(self.verified(ties, "tied"), scratch, "tied"), ties

        def joined(pairs: DataFrame, name: str) -> None:
            nonlocal comps, tested
            more = scratch.write(pairs.join(tested, ["a", "b"], "left_anti"), f"{name}-pairs")
            comps = self.merged(comps, self.verified(more, name), name)
            tested = tested.unionByName(more)

        for name, forest in (("second", True), ("third", False)):
            open_ = self.open(groups, comps, name, 3)  # the pairs of groups of two are ties
            if open_.isEmpty():
                return comps
            large = self.possible(self.tied_again(open_.where(F.col("n") > BLOCK)), f"{name}-tied")
            joined(self.across(open_.where(F.col("n") <= BLOCK), forest).unionByName(large).distinct(), name)
        large = self.open(groups, comps, "large", BLOCK + 1)
        if not large.isEmpty():
            groups = self.narrowed(large)
            for name, forest in (("alike", True), ("left", False)):
                joined(self.across(self.open(groups, comps, name, 2), forest), name)
        return comps


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_type: str = "long") -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * |a & b| >= num * |a | b|. id_type: "long" or "string", to which doc_id is cast."""
    join = _Join(docs, k, num, den, id_type)
    comps = join.components()
    placed = join.owner.join(comps, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    placed = join.scratch.write(placed, "placed")
    named = placed.join(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id")
    rows = join.rows
    linked = rows.where("node is not null").join(named, "node", "left")
    linked = linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    join.scratch.keep("read", "clashes", "placed")
    return linked.unionByName(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
