"""MinHash near-deduplication by a chosen-path set similarity join.

Documents of equal shingle sets fall together first. The distinct sets then descend several independent trees: a
node selects coordinates of the minwise signature by a hash of its own path, and sends each set to the child named
by its minwise token there, 1 / similarity children on average. Nodes of few sets are compared exhaustively by
their signatures. In others all sets are compared with some of them: those that agree are tied to these, and
those that agree well with one go no further; the others branch on. So a node's links are linear in its sets.
A node that is not large goes all the way down in one task; only large ones take a round of joins for each level.
Components of these candidate links are groups; trees are repeated until a pair at the threshold meets in one with
the probability RECALL.

Full sets decide every link of a group. A small group is one block: few sets are compared exhaustively, and of more
each set outside one class is looked up in an index of the block. In a large group every
set is compared with a few pivots, which settles the sets that a pivot is linked to. A link between others takes
words in common that the first pivot lacks, or lacks in common that it has: sets are written as deviations from
it, and prefixes of these, rarest first, find all pairs that can reach the similarity, without comparing the rest.
Components of the exact links are the classes.

Nodes are sized by counts that Spark combines before shuffling; no task gathers more than a small node or a small
group, no pairs are written but links and candidates, and nothing about all documents comes to the driver.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import KEY, LOWER_BYTES, counted, few, keyed, released, small_batches, text_blocks, text_mark, without, word_spans, words_of, written

#: Coordinates of the minwise signature, levels of a tree, sets of a node that one task takes down, sets that all of a node are compared with.
SIGNATURE, LEVELS, SMALL, ASKED = 64, 8, 8192, 4
#: Sets of a node or group that are compared exhaustively.
PAIRED = 256
#: Links that one task joins to stars.
PIECE = 1 << 20
#: Sets of a small group, shingles of all its sets together, and the product of both: what looking up every set may read.
BLOCK, BLOCK_SHINGLES, BLOCK_WORK = 4096, 1 << 21, 1 << 30
#: Sets that are looked up before a class is chosen whose sets need not be.
TRIED = 8
#: Signature coordinates in common from which sets are candidates: 4.4 standard deviations below a similarity of 0.8;
#: and from which one that is tied to a pivot of a large node goes no further.
AGREE, CLOSE = 37, 45
#: Part of the pairs at the threshold that meet in some tree, and levels that they need for it.
RECALL, DEPTH = 0.999, 5
#: Sets of a large group from which its pivots are chosen, pivots, and coordinates in common that a pivot stands for.
SAMPLE, PIVOTS, STANDS = 64, 6, 47
#: Classes of deviation: lower ends, as shares of what a set at the threshold deviates.
STEPS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
#: Sets that one of a large group is compared with for each deviation that it has in common; the label of the first pivot's class.
PROBES, MAIN = 2, -(1 << 63)
SHINGLE, SIMILARITY = 5, 80

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_RNG = np.random.default_rng(20)
_MULTIPLY = (_RNG.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raw: bytes, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each document of a block the sorted 64-bit hashes of its distinct shingles of ``size`` words.

    Words are runs of other than ASCII white space, with A-Z lowered; fewer words than ``size`` are one shingle.
    """
    shown = np.frombuffer(raw.translate(LOWER_BYTES), np.uint8)
    starts, ends, first = word_spans(shown, offsets, _SPACE)
    coded = words_of(shown, starts, ends).dictionary_encode()
    kinds = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = kinds[coded.indices.to_numpy(zero_copy_only=False)] if len(kinds) else np.zeros(0, np.uint64)
    rolled = np.full(len(words), size, np.uint64)
    for k in range(min(size, len(words))):
        left = len(words) - k
        rolled[:left] = _mixed(rolled[:left] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=int(b - a))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(found: np.ndarray) -> np.ndarray:
    low = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, ((found[at : at + 4096, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32).view(np.int32)


def features(docs: DataFrame, size: int) -> DataFrame:
    """key, n_shingles, hi and lo (128 bits of the set), mins (array of ints) and sketch (their low bytes) of every row."""
    small_batches(docs.sparkSession)

    def scan(batches):
        for ids, raw, offsets in text_blocks(batches):
            sets = shingle_sets(raw, offsets, size)
            keys = np.array([_digest(s) for s in sets])
            mins = np.concatenate([_signature(s) for s in sets])
            rows = pa.array(np.arange(0, len(mins) + 1, SIGNATURE), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.ascontiguousarray(keys[:, 0])),
                    pa.array(np.ascontiguousarray(keys[:, 1])),
                    pa.ListArray.from_arrays(rows, pa.array(mins, pa.int32())),
                    pa.array([x.tobytes() for x in mins.astype(np.uint8).reshape(-1, SIGNATURE)], pa.binary()),
                ],
                ["key", "n_shingles", "hi", "lo", "mins", "sketch"],
            )

    return keyed(docs).mapInArrow(scan, f"key {KEY}, n_shingles long, hi long, lo long, mins array<int>, sketch binary")


def _digest(found: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of ``edges`` (u, v) has one edge and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").isEmpty()


def _star_rounds(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v of the same components, until every u has one edge, to its component's smallest id.

    Minima are written before they are joined: only then Spark splits the partition of a hub.
    """
    edges = written(edges.distinct(), "links")
    while not _are_stars(edges):
        old = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "low")
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = least.select("u", F.col("m").alias("v"))
        again = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(again).distinct(), "links")
        released(old, low, large, least)
    return edges


def _stars(batches):
    """Stars (u, v: the smallest id) that join what the links (a, b) of a task join, by PIECE links at a time."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= PIECE:
            yield _starred(kept)
            kept, size = [], 0
    if size:
        yield _starred(kept)


def _starred(batches: list) -> pa.RecordBatch:
    ends = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1) for batch in batches])
    ids, row = np.unique(ends, return_inverse=True)
    root = _joined(row[: len(row) // 2], row[len(row) // 2 :], len(ids))
    up = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[up]), pa.array(ids[root[up]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every end of ``edges`` (a, b: long).

    Tasks join up to PIECE links each to stars. Where there are more, alternating large and small stars join the rest.
    """
    ends = written(edges.where("a <> b").select("a", "b"), "ends")
    pieces = -(-counted(ends) // PIECE)
    stars = written(ends.coalesce(max(1, pieces)).mapInArrow(_stars, "u long, v long"), "stars")
    released(ends)
    if pieces > 1:
        stars = _star_rounds(stars)
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row of the component of each of ``n`` rows under links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _whole_groups(batches):
    """Arrow batches cut where the first column changes; rows come sorted by it."""
    kept = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if kept is not None:
            batch = pa.concat_batches([kept, batch])
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield batch.slice(0, cut)
        kept = batch.slice(cut)
    if kept is not None:
        yield kept


def _similar_by_signature(levels: int):
    def scan(batches):
        """Forests of the candidate links inside nodes and the levels below; rows: node, id, n_shingles, sketch; sorted by node."""
        for batch in _whole_groups(batches):
            node, ids, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            root = _joined(*_descended(node, ids, size, _bytes(batch.column(3)), levels), len(ids))
            row = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[root[row]])], ["a", "b"])

    return scan


def _descended(node: np.ndarray, ids: np.ndarray, size: np.ndarray, sketch: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (rows a, b) of whole nodes on so many levels: all pairs of PAIRED sets at most, of more those with ASKED of them."""
    rows, links = np.arange(len(ids)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for _ in range(levels):
        by = np.lexsort((_mixed(ids[rows].view(np.uint64) ^ _mixed(node.view(np.uint64))), node))
        node, rows = node[by], rows[by]
        _, begins, counts = np.unique(node, return_index=True, return_counts=True)
        first, paired = np.repeat(begins, counts), np.repeat(counts <= PAIRED, counts)
        links += _paired(node[paired], rows[paired], ids, size, sketch)
        on = np.flatnonzero(~paired)
        if not len(on):
            break
        own = sketch[rows[on]]
        asked = rows[first[on][:, None] + np.arange(ASKED)]
        same = np.stack([(own == sketch[asked[:, k]]).sum(axis=1) for k in range(ASKED)], axis=1)
        row, turn = np.nonzero((same >= AGREE) & (asked != rows[on][:, None]))
        links.append((rows[on][row], asked[row, turn]))
        on = on[(same < CLOSE).all(axis=1)]
        child, node = _children(node[on].view(np.uint64), sketch[rows[on]])
        rows = rows[on][child]
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    return a, b


def _paired(node: np.ndarray, rows: np.ndarray, ids: np.ndarray, size: np.ndarray, sketch: np.ndarray):
    """Links (rows a, b) of all pairs inside each node that agree; ``node`` is sorted."""
    ids, size, sketch = ids[rows], size[rows], sketch[rows]
    for step in range(1, min(PAIRED, len(node))):
        same = np.flatnonzero(node[step:] == node[:-step])
        if not len(same):
            break
        other = same + step
        near = (10 * np.minimum(size[same], size[other]) >= 8 * np.maximum(size[same], size[other])) & (ids[same] != ids[other])
        same, other = same[near], other[near]
        close = (sketch[same] == sketch[other]).sum(axis=1) >= AGREE
        yield rows[same[close]], rows[other[close]]


@cache
def trees(similarity: int) -> int:
    """Trees in one of which a pair at the threshold stays together for DEPTH levels with the probability RECALL.

    A node has one child always and another in a quarter of the cases; a pair shares a child if it agrees there.
    """
    agree, apart = similarity / 100, 0.0
    for _ in range(DEPTH):
        lost = 1 - agree + agree * apart
        apart = 0.75 * lost + 0.25 * lost**2
    return int(np.ceil(np.log(1 - RECALL) / np.log(apart)))


def _bytes(column) -> np.ndarray:
    """The bytes of an Arrow array of sketches, a row of the result each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _children(nodes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes of sets: a node selects one coordinate always and another so that 1.25 are expected, by hash of its own."""
    draw = lambda k: _mixed(nodes + np.uint64(k)) % np.uint64(SIGNATURE)
    first, second = draw(1), draw(2)
    both = (_mixed(nodes + np.uint64(3)) % np.uint64(4) == 0) & (first != second)
    rows = np.concatenate([np.arange(len(nodes)), np.flatnonzero(both)])
    at = np.concatenate([first, second[both]])
    token = at * np.uint64(256) + sketch[rows, at.astype(np.int64)]
    return rows, _mixed(_mixed(nodes[rows]) + (token + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _near_pivots(batches):
    """Links of sets of large nodes with the node's pivots (link: true), and children of the sets that no pivot stands for.

    Rows: node, id, sketch, pivots (list of turn, pivot and other: its sketch); ASKED in each list.
    """
    for batch in batches:
        nodes, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        own, pivots = _bytes(batch.column(2)), batch.column(3).flatten()
        of, other = pivots.field("pivot").to_numpy(zero_copy_only=False).reshape(-1, ASKED), _bytes(pivots.field("other")).reshape(-1, ASKED, SIGNATURE)
        same = np.stack([(own == other[:, k]).sum(axis=1) for k in range(ASKED)], axis=1)
        row, turn = np.nonzero((same >= AGREE) & (of != ids[:, None]))
        on = np.flatnonzero((same < CLOSE).all(axis=1))
        child, node = _children(nodes[on].view(np.uint64), own[on])
        link = np.arange(len(row) + len(child)) < len(row)
        columns = np.concatenate([ids[row], ids[on[child]]]), np.concatenate([of[row, turn], node]), link
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "other", "link"])


def candidates(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Candidate links (a, b) of distinct ``sets`` (id, n_shingles, mins, sketch): forests and stars, linear in the nodes' sizes."""
    signed = sets.select("id", "n_shingles", "sketch")
    rng = np.random.default_rng(5)
    chosen = []
    for tree in range(trees(similarity)):
        for i in rng.choice(SIGNATURE, 1 + (tree % 4 == 0), replace=False):
            chosen.append(F.xxhash64(F.lit(tree), F.lit(int(i)), F.get("mins", F.lit(int(i)))))
    rows = sets.select("id", F.explode(F.array(*chosen)).alias("node"))
    # some of a large node's sets, others in each tree: the smallest after their bits are turned by hashes of the node
    turned = lambda k: F.xxhash64("node", F.lit(k))
    least = [F.min(F.col("id").bitwiseXOR(turned(k))).alias(f"least{k}") for k in range(ASKED)]
    links = []
    for level in range(1, LEVELS + 1):
        sizes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        # written, so that the join shuffles both sides itself: only then Spark splits the partition of a hot node
        rows = written(rows.join(sizes, "node"), "nodes")
        small = rows.where(F.col("n") <= SMALL).select("node", "id")
        small = small.join(signed, "id").select("node", "id", "n_shingles", "sketch")
        small = small.repartition("node").sortWithinPartitions("node")
        links.append(small.mapInArrow(_similar_by_signature(LEVELS + 1 - level), "a long, b long"))
        last = sizes.where(F.col("n") > SMALL).isEmpty()
        released(sizes)
        if last:
            break
        large = rows.where(F.col("n") > SMALL).select("node", "id")
        pivots = large.groupBy("node").agg(*least).select("node", F.posexplode(F.array(*[F.col(f"least{k}").bitwiseXOR(turned(k)) for k in range(ASKED)])).alias("turn", "pivot"))
        pivots = pivots.join(signed.select(F.col("id").alias("pivot"), F.col("sketch").alias("other")), "pivot")
        pivots = pivots.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("turn", "pivot", "other"))).alias("pivots"))
        met = large.join(signed.select("id", "sketch"), "id").join(pivots, "node").select("node", "id", "sketch", "pivots")
        met = written(met.mapInArrow(_near_pivots, "id long, other long, link boolean"), "large-nodes")
        links.append(met.where("link").select(F.col("id").alias("a"), F.col("other").alias("b")))
        rows = met.where("not link").select("id", F.col("other").alias("node"))
    return reduce(DataFrame.union, links)


def _exact(similarity: int):
    def scan(batches):
        """Forests of the exact links of small groups; rows: group, id, hashes; sorted by group."""
        for batch in _whole_groups(batches):
            group, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            hashes = batch.column(2)
            ends, flat = np.asarray(hashes.offsets), hashes.values.to_numpy(zero_copy_only=False)
            out_a, out_b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [flat[ends[i] : ends[i + 1]] for i in range(lo, hi)]
                root = _joined(*_linked(sets, similarity), hi - lo) if hi - lo <= PAIRED else _looked_up(sets, similarity)
                row = np.flatnonzero(root != np.arange(hi - lo))
                out_a.append(ids[lo + row])
                out_b.append(ids[lo + root[row]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return scan


def _linked(sets: list[np.ndarray], similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with 100 * intersection >= similarity * union, by products of incidence matrices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[shared] = np.arange(len(shared))
    column = number[code]
    owner, column = owner[column >= 0], column[column >= 0]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    both = np.zeros((n, n))
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((n, min(4096, len(shared) - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    either = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= similarity * either, 1))
    return a, b


def _looked_up(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """The smallest row of each set's class. A set is compared with all that share a shingle with it.

    Of a link between a set of one class and another outside it, the latter finds it: so sets of the class that is
    the largest after TRIED sets are not looked up.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(code, kind="stable")]
    begins = np.cumsum(times) - times
    root, main = np.arange(n), 0
    for i in range(n):
        if i == TRIED:
            main = int(np.argmax(np.bincount(root)[root]))
        if i >= TRIED and root[i] == root[main]:
            continue
        held = code[starts[i] : starts[i + 1]]
        ends = np.cumsum(times[held])
        at = np.repeat(begins[held] - ends + times[held], times[held]) + np.arange(ends[-1])
        common = np.bincount(holders[at], minlength=n)
        near = np.unique(root[100 * common >= similarity * (sizes[i] + sizes - common)])
        if len(near) > 1:
            root[np.isin(root, near)] = near[0]
    return root


def group_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """id and hashes (array of longs, sorted) of the sets of ``members`` (id, doc_id of a document that has the set)."""
    small_batches(docs.sparkSession)
    texts = keyed(docs).where(F.col("key.doc_id").isNotNull())
    owners = few(members.select(F.col("doc_id").alias("_owner")))
    texts = texts.join(owners, F.col("key.doc_id") == F.col("_owner"), "left_semi")

    def scan(batches):
        for _, raw, offsets in text_blocks(batches):
            found = [s for s in shingle_sets(raw, offsets, size) if len(s)]
            ids = np.array([_digest(s)[0] for s in found], np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "hashes"])

    return texts.mapInArrow(scan, "id long, hashes array<long>")


def _covering(batches):
    """Pivots of large groups; rows: component, sample (list of id and sketch)."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            ids = [x["id"] for x in row["sample"]]
            sketch = np.frombuffer(b"".join(x["sketch"] for x in row["sample"]), np.uint8).reshape(len(ids), -1)
            same = (sketch[:, None] == sketch[None]).sum(axis=2)
            left = np.ones(len(ids), bool)
            for turn in range(PIVOTS):
                stands = ((same >= STANDS) & left).sum(axis=1)
                best = int(np.lexsort((np.array(ids), -same.sum(axis=1), -stands))[0])
                if turn and stands[best] < 2:
                    break
                found.append((row["component"], turn, ids[best]))
                left &= same[best] < STANDS
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["component", "turn", "pivot"])


def _pivot_classes(batches):
    """Classes of the sets of large groups by the pivots that they are linked to; rows: component, masks (of turns), pivots.

    Pivots of one mask are of one class. label: MAIN for the first pivot's class, another class's first pivot, none
    for no pivot; open: whether the group has sets beyond MAIN.
    """
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            classes = [1 << turn for turn in range(len(row["pivots"]))]
            for mask in row["masks"]:
                joined = reduce(lambda a, b: a | b, [c for c in classes if c & mask], 0)
                classes = [c for c in classes if not c & mask] + [joined] * bool(joined)
            label = {}
            for mask in row["masks"]:
                least = next((c & -c for c in classes if c & mask), 0).bit_length() - 1
                label[mask] = None if least < 0 else MAIN if least == 0 else row["pivots"][least]
            found += [(row["component"], m, x, set(label.values()) != {MAIN}) for m, x in label.items()]
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["component", "mask", "label", "open"])


def _large_group_links(members: DataFrame, sets: DataFrame, similarity: int) -> list[DataFrame]:
    """Links (a, b) that give the exact classes of large groups; ``members``: component, id, sketch; ``sets``: component, id, hashes."""
    order = Window.partitionBy("component").orderBy(F.xxhash64("id"), "id")
    sample = members.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SAMPLE)  # limited before the shuffle too
    sample = sample.groupBy("component").agg(F.collect_list(F.struct("id", "sketch")).alias("sample"))
    pivots = sample.mapInArrow(_covering, "component long, turn int, pivot long")
    pivots = pivots.join(sets.select(F.col("id").alias("pivot"), F.col("hashes").alias("whole")), "pivot")
    pivots = pivots.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("turn", "pivot", "whole"))).alias("pivots"))
    pivots = written(pivots, "pivots")
    whole = F.col("pivots")[0]["whole"]
    removed, added = F.array_except(whole, "hashes"), F.array_except("hashes", whole)
    near = sets.join(pivots, "component").select(
        "component", "id", F.size("hashes").cast("long").alias("n"), F.size(whole).cast("long").alias("p"),
        F.transform("pivots", lambda x: F.size(F.array_intersect("hashes", x["whole"])).cast("long")).alias("common"),
        F.transform("pivots", lambda x: F.size(x["whole"]).cast("long")).alias("sizes"),
        F.col("pivots.pivot").alias("pivots"), F.concat(added, F.transform(removed, F.bitwise_not)).alias("dev"),
    )
    near = near.withColumn("linked", F.zip_with("common", "sizes", lambda c, m: 100 * c >= similarity * (F.col("n") + m - c)))
    bits = F.transform("linked", lambda x, turn: F.when(x, F.pow(F.lit(2), turn).cast("int")).otherwise(F.lit(0)))
    near = near.withColumn("mask", F.aggregate(bits, F.lit(0), lambda a, b: a + b)).withColumn("shared", F.col("common")[0])
    near = written(near.drop("common", "sizes"), "pivoted")
    stars = near.select(F.col("id").alias("a"), F.explode(F.arrays_zip("linked", "pivots")).alias("x"))
    stars = stars.where("x.linked and a <> x.pivots").select("a", F.col("x.pivots").alias("b"))
    masks = near.groupBy("component").agg(F.collect_set("mask").alias("masks"), F.first("pivots").alias("pivots"))
    masks = written(masks.mapInArrow(_pivot_classes, "component long, mask int, label long, open boolean"), "pivot-classes")
    # the class of the first pivot is MAIN; sets of equal labels are linked, by others in between
    own = near.join(few(masks.where("open")), ["component", "mask"]).withColumn("label", F.coalesce("label", "id"))
    # what a set deviates beyond one at the threshold: of two sets that are linked but not by the pivot, one is above 0
    excess = similarity * (F.col("n") + F.col("p") - F.col("shared")) - 100 * F.col("shared")
    own = own.select("component", "id", "n", "p", "shared", "dev", "label", excess.alias("excess"))
    tokens = own.select("component", "id", F.explode("dev").alias("token"))
    # most sets that no pivot is linked to are linked to some that share a deviation: a few of each are asked first
    least = lambda k: F.min(F.col("id").bitwiseXOR(F.xxhash64("token", F.lit(k)))).bitwiseXOR(F.xxhash64("token", F.lit(k)))
    counts = tokens.groupBy("component", "token").agg(F.count(F.lit(1)).alias("times"), *[least(k).alias(f"b{k}") for k in range(PROBES)])
    counts = written(counts.where("times > 1"), "token-counts")
    tokens = tokens.join(counts.select("component", "token", "times"), ["component", "token"], "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "token")))
    ranked = tokens.groupBy("id").agg(ranked.alias("r")).select("id", F.col("r.token").alias("tokens"), F.filter("r", lambda x: x["times"] > 1)["token"].alias("common"))
    rows = written(own.drop("dev").join(ranked, "id"), "ranked")
    asked = rows.where(F.col("label") != MAIN).select("component", F.col("id").alias("a"), F.explode("common").alias("token")).join(counts, ["component", "token"])
    pairs = asked.select("a", F.explode(F.array_distinct(F.array(*[f"b{k}" for k in range(PROBES)]))).alias("b")).where("a <> b").distinct()
    probed = written(_reaching(pairs, rows, similarity), "probed")
    links = [stars, probed]
    better = probed.join(rows.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("better"))
    rows = rows.join(better, "id", "left").withColumn("label", F.least("label", "better")).drop("better", "common")
    rows = written(rows, "labelled")
    steps = [F.lit(1), *[F.ceil(F.lit(s) * (100 - similarity) * F.col("p")) for s in STEPS]]
    kind = reduce(lambda a, b: a + b, [(F.col("excess") >= s).cast("int") for s in steps])
    # a linked set has all but so many of one's deviations
    apart = F.floor(F.col("n") * (100 - similarity) / similarity)
    spent = 100 * (F.col("p") - F.col("shared")) + similarity * (F.col("n") - F.col("shared"))
    size = F.size("tokens")

    def prefix(least):
        return F.slice("tokens", 1, F.greatest(F.lit(0), F.least(size - F.ceil(least / (100 + similarity)) + 1, apart + 1, size).cast("int")))

    rows = rows.withColumn("kind", kind)
    strong = rows.where("excess > 0").select("component", "label", "id", "n", "kind", F.explode(prefix(F.col("excess"))).alias("token"))
    weak = F.array(*[F.when(F.col("kind") <= k, F.struct(F.lit(k).alias("kind"), prefix(steps[k - 1] + spent).alias("tokens"))) for k in range(1, len(steps) + 1)])
    weak = rows.select("component", "label", "id", "n", F.explode(F.array_compact(weak)).alias("w"))
    weak = weak.select("component", F.col("label").alias("label2"), F.col("id").alias("id2"), F.col("n").alias("n2"), "w.kind", F.explode("w.tokens").alias("token"))
    # tokens of one class make no pair
    mixed = strong.select("component", "kind", "token", "label").union(weak.select("component", "kind", "token", "label2"))
    mixed = mixed.groupBy("component", "kind", "token").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m")
    mixed = written(mixed.select("component", "kind", "token"), "mixed")
    by = ["component", "kind", "token"]
    pairs = strong.join(mixed, by, "left_semi").join(weak.join(mixed, by, "left_semi"), by).where("label <> label2")
    pairs = pairs.where(similarity * F.greatest("n", "n2") <= 100 * F.least("n", "n2"))
    pairs = written(pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "pairs")
    return [*links, _reaching(pairs, rows, similarity)]


def _reaching(pairs: DataFrame, rows: DataFrame, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the similarity; ``rows``: id, n, p, shared, tokens (deviations from one pivot)."""
    kept = lambda x: rows.select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "p", "shared", "tokens")])
    both = pairs.join(kept("a"), F.col("a") == F.col("a_id")).join(kept("b"), F.col("b") == F.col("b_id"))
    # words in common: those of the pivot that neither lacks, and the others that both have
    common = F.col("a_shared") + F.col("b_shared") - F.col("a_p") + F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common >= similarity * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def exact_links(docs: DataFrame, groups: DataFrame, size: int, similarity: int) -> DataFrame:
    """Links (a, b) that give the exact classes inside ``groups`` (id, component, doc_id, n_shingles, sketch), from whole texts."""
    total = groups.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("shingles"))
    large = (F.col("sets") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES) | (F.col("sets") * F.col("shingles") > BLOCK_WORK)
    total = written(total.select("component", large.alias("large")), "group-sizes")
    members = written(groups.join(total, "component"), "members")
    placed = few(members.select("id", "component", "large"))
    sets = written(group_sets(docs, members, size).join(placed, "id"), "group-sets")
    if counted(sets) != counted(members):  # repeated rows
        sets = written(sets.dropDuplicates(["id"]), "group-sets")
    small = sets.where("not large").select("component", "id", "hashes").repartition("component").sortWithinPartitions("component")
    links = [small.mapInArrow(_exact(similarity), "a long, b long")]
    if not total.where("large").isEmpty():
        links += _large_group_links(members.where("large").select("component", "id", "sketch"), sets.where("large").select("component", "id", "hashes"), similarity)
    return reduce(DataFrame.union, links)


def _classes(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """key, n_shingles, hi, lo, component_id and kept of every row."""
    found = written(features(docs, size).withColumn("doc_id", F.col("key.doc_id")), "shingles")
    full = found.where("n_shingles > 0 and doc_id is not null")
    owners = written(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("own")), "owners")
    # a set is known by 64 bits of its digest, and stands for the documents that have it
    sets = full.join(owners.select("own", F.col("hi").alias("h"), F.col("lo").alias("l")), (F.col("doc_id") == F.col("own")) & (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")))
    sets = written(sets.select(F.col("hi").alias("id"), "doc_id", "n_shingles", "mins", "sketch"), "sets")
    if counted(sets) != counted(owners):  # repeated rows
        sets = written(sets.dropDuplicates(["id"]), "sets")
    groups = components(candidates(sets, similarity)).join(sets.select("id", "doc_id", "n_shingles", "sketch"), "id")
    linked = written(components(exact_links(docs, groups, size, similarity)), "linked")
    named = linked.join(owners.select(F.col("hi").alias("id"), "lo", "own"), "id")
    least = named.groupBy("component").agg(F.min("own").alias("least"))
    named = named.join(least, "component").select(F.col("id").alias("h"), F.col("lo").alias("l"), "least")
    named = owners.join(named, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    named = written(named.select("hi", "lo", F.coalesce("least", "own").alias("least")), "named")
    rows = found.select("key", "doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    rows = rows.select("key", "doc_id", "n_shingles", "hi", "lo", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def classes(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Documents with 100 * intersection >= similarity * union of their sets of shingles are linked. Null, empty and
    blank texts have no shingles and are linked with nothing; rows with a null doc_id have no component and are
    kept; rows that share a doc_id but not a set are linked each by its own; other columns are ignored.
    """
    return _classes(docs, size, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, of the smallest doc_id; rows without shingles or with a null doc_id stay.

    Rows are dropped by id and text: of rows that share an id each is judged by its own text. Of rows that share id
    and set one stays, that of the smallest mark; of wholly equal texts among them the first that Spark meets.
    """
    found = written(_classes(docs, size, similarity), "classes")
    gone = found.where("not kept").select("key")
    own = found.where("kept and doc_id is not null and n_shingles > 0")
    again = written(own.groupBy("doc_id", "hi", "lo").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if again.isEmpty():
        return without(docs, gone)
    rows = own.join(again, ["doc_id", "hi", "lo"])
    first = rows.groupBy("doc_id", "hi", "lo").agg(F.min("key").alias("first"))
    rows = written(rows.join(first, ["doc_id", "hi", "lo"]).select("key", (F.col("key") == F.col("first")).alias("stays")), "repeated-rows")
    name = few(written(rows.where("stays").select(F.col("key").alias("_one")).distinct(), "repeated-keys"))
    one = F.struct(docs["doc_id"].cast("long").alias("doc_id"), text_mark(docs["text"].cast("string")).alias("mark"))
    ones = docs.join(name, one == F.col("_one"), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(docs, gone.union(rows.select("key"))).union(ones)
