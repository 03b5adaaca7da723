"""Benchmark decontamination by suffix arrays of the training words.

Every task turns its documents into shards of word codes, sorts all suffixes of a shard (prefix doubling on
packed codes, to the depth of the longest benchmark item) and binary-searches every benchmark suffix in it:
the range of a window's suffixes holds all its occurrences, the neighbours of a suffix's place give its
longest verbatim match. Documents are never shuffled; the benchmark is broadcast in blocks of bounded size,
however many there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import KEY, WORD_BYTES, keyed, small_batches, text_blocks, without, word_spans, words_of

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: Words of a shard whose suffixes are sorted together.
SHARD_WORDS = 1 << 19
#: Bytes of benchmark texts in one broadcast block.
BLOCK_BYTES = 16 << 20


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts of ``codes`` (int64, >= 0; past the end counts as 0) in order of their first ``depth`` codes."""
    n = len(codes)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    step = max(1, min(depth, 62 // bits))
    padded = np.concatenate([codes, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key |= padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    heads = np.ones(n, bool)
    heads[1:] = key[1:] != key[:-1]
    place = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = place
    rank[n] = -1
    while step < depth:
        alone = heads.copy()
        alone[:-1] &= heads[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        part = order[open_]
        key = rank[part] * (n + 2) + rank[np.minimum(part + step, n)] + 1
        by = np.argsort(key)
        part, key = part[by], key[by]
        order[open_] = part
        first = np.ones(len(part), bool)
        first[1:] = key[1:] != key[:-1]
        heads[open_] = first
        rank[part] = open_[np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))]
        step *= 2
    return order


def _compare(codes, at, wanted, start, length):
    """-1, 0 or 1 as the suffixes at ``at`` sort against patterns wanted[start:start+length], and codes in common."""
    sign = np.zeros(len(at), np.int8)
    common = np.zeros(len(at), np.int64)
    live = np.flatnonzero(length > 0)
    k = 0
    while len(live):
        a, b = codes[at[live] + k], wanted[start[live] + k]
        same = a == b
        differ = live[~same]
        sign[differ] = np.where(a[~same] < b[~same], -1, 1)
        common[live[same]] += 1
        k += 1
        live = live[same]
        live = live[length[live] > k]
    return sign, common


def place(codes, order, wanted, start, length, after: bool = False) -> np.ndarray:
    """For each pattern the first suffix, in order, that is not below it (``after``: that is above it)."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order))
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) >> 1
        sign, _ = _compare(codes, order[middle], wanted, start[live], length[live])
        right = sign <= 0 if after else sign < 0
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]
    return low


class Items:
    """A block of benchmark items: their words in one row, and where windows and suffixes begin."""

    def __init__(self, ids: list, texts: list, window: int):
        shown = np.frombuffer("\0".join(x or "" for x in texts).encode().translate(WORD_BYTES), np.uint8)
        sizes = np.array([len((x or "").encode()) + 1 for x in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        offsets[-1] = len(shown)
        starts, ends, first = word_spans(shown, offsets)
        self.ids, self.words = ids, words_of(shown, starts, ends)
        counts = np.diff(first)
        self.item = np.repeat(np.arange(len(ids)), counts)
        self.left = np.repeat(first[1:], counts) - np.arange(len(starts))  # words from here to the item's end
        self.at = np.arange(len(starts)) - np.repeat(first[:-1], counts)
        short = np.repeat(counts < window, counts)
        self.window = np.flatnonzero((self.left >= window) | short & (self.at == 0))
        self.length = np.minimum(self.left[self.window], window)
        self.longest = int(counts.max(initial=0))


def _shards(words: pa.Array, first: np.ndarray, items: list[Items]):
    """Codes of the block's words (0 between documents) by item block: (items, their codes, codes, word number of each place)."""
    n = len(words)
    where = np.arange(n) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    for block in items:
        both = pa.concat_arrays([block.words.cast(pa.large_binary()), words]).dictionary_encode().indices
        both = both.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        own = len(block.words)
        codes = np.zeros(n + len(first) + block.longest + 1, np.int64)
        codes[where] = both[own:]
        yield block, np.append(both[:own], 0), codes, where


def _pieces(codes: np.ndarray, total: int, depth: int, size: int):
    """(first place, places that count, codes with what follows) of each shard; shards overlap by ``depth`` codes."""
    for at in range(0, total, size):
        own = min(size, total - at)
        yield at, own, codes[at : at + own + depth]


def _sorted_shards(codes, total, depth, size=SHARD_WORDS):
    for at, own, part in _pieces(codes, total, depth, size):
        order = suffix_array(part, depth)
        yield at, own, np.concatenate([part, np.zeros(depth + 1, np.int64)]), order


def _hits(raw: bytes, offsets: np.ndarray, blocks: list, window: int):
    """Per document of a block: words, hit words and the set of items."""
    shown = np.frombuffer(raw.translate(WORD_BYTES), np.uint8)
    starts, ends, first = word_spans(shown, offsets)
    words = words_of(shown, starts, ends)
    docs = len(offsets) - 1
    marks, found = np.zeros(len(starts) + docs + 1, np.int64), [set() for _ in range(docs)]
    total = len(starts) + docs
    where = None
    doc_of = np.repeat(np.arange(docs), np.diff(first) + 1)  # by place
    for block, wanted, codes, where in _shards(words, first, (b for b in blocks if b.longest)):
        depth = max(int(block.length.max(initial=1)), 1)
        for at, own, part, order in _sorted_shards(codes, total, depth):
            begin = place(part, order, wanted, block.window, block.length)
            end = place(part, order, wanted, block.window, block.length, after=True)
            count = end - begin
            if not count.any():
                continue
            which = np.repeat(np.arange(len(count)), count)
            spot = order[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(which))]
            keep = spot < own
            which, spot = which[keep], spot[keep] + at
            np.add.at(marks, spot, 1)
            np.add.at(marks, spot + block.length[which], -1)
            pairs = np.unique(doc_of[spot] * len(block.ids) + block.item[block.window[which]])
            for doc, item in zip(pairs // len(block.ids), pairs % len(block.ids), strict=True):
                if block.ids[item] is not None:
                    found[doc].add(block.ids[item])
    hit = np.cumsum(marks)[:-1] > 0
    if where is None:
        return np.diff(first), np.zeros(docs, np.int64), found
    sums = np.concatenate([[0], np.cumsum(hit[where])])
    return np.diff(first), sums[first[1:]] - sums[first[:-1]], found


def broadcast_items(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcasts of at most ``block_bytes`` of text each (one longer item: its own); the driver holds one at a time."""
    sc = benchmark.sparkSession.sparkContext
    out, ids, texts, size = [], [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if size >= block_bytes:
            out.append(sc.broadcast((ids, texts)))
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
    return [*out, sc.broadcast((ids, texts))]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: its words, those inside any occurrence of a benchmark window, and the items.

    doc_id, n_words, n_hit, n_items (long), item_ids (array, sorted as strings), contaminated (n_hit > 0 and
    share * n_hit >= n_words). Null and empty texts have no words and are clean; benchmark rows without words
    have no windows, rows with a null item_id hit words but are not listed; repeated rows give repeated rows;
    an empty benchmark leaves all clean; other columns are ignored.
    """
    return _contamination(docs, benchmark, window, share).select("key.doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    small_batches(docs.sparkSession)
    blocks = broadcast_items(benchmark, window)

    def scan(batches):
        items = None
        for ids, raw, offsets in text_blocks(batches):
            if items is None or len(blocks) > 1:
                items = (Items(*b.value, window) for b in blocks)
                items = list(items) if len(blocks) == 1 else items
            n_words, n_hit, found = _hits(raw, offsets, items, window)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([sorted(map(str, x)) for x in found], pa.list_(pa.string())),
                    pa.array((n_hit > 0) & (share * n_hit >= n_words), pa.bool_()),
                ],
                ["key", "n_words", "n_hit", "n_items", "item_ids", "contaminated"],
            )

    schema = f"key {KEY}, n_words long, n_hit long, n_items long, item_ids array<string>, contaminated boolean"
    return keyed(docs).mapInArrow(scan, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 5) -> DataFrame:
    """For each benchmark suffix that occurs with at least ``least`` words: its longest verbatim match and one location.

    item_id, item_word, n_words (of the match), doc_id, doc_word (places in words from 0). Shards give their
    longest each; the longest over all, then the smallest place, is kept. Rows without words give none.
    """
    small_batches(docs.sparkSession)
    blocks = broadcast_items(benchmark, WINDOW)

    def scan(batches):
        for ids, raw, offsets in text_blocks(batches):
            shown = np.frombuffer(raw.translate(WORD_BYTES), np.uint8)
            starts, ends, first = word_spans(shown, offsets)
            words = words_of(shown, starts, ends)
            docs_ = len(offsets) - 1
            doc_of = np.repeat(np.arange(docs_), np.diff(first) + 1)
            begin_of = (first[:-1] + np.arange(docs_))[doc_of]
            items = (Items(*b.value, WINDOW) for b in blocks)
            for block, wanted, codes, _ in _shards(words, first, items):
                depth = max(block.longest, 1)
                every = np.arange(len(block.left))
                for at, _own, part, order in _sorted_shards(codes, len(starts) + docs_, depth):
                    spot = place(part, order, wanted, every, block.left)
                    best, where = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
                    for near in (spot - 1, spot):
                        ok = (near >= 0) & (near < len(order))
                        _, common = _compare(part, order[np.clip(near, 0, len(order) - 1)], wanted, every, block.left)
                        better = ok & (common > best)
                        best[better], where[better] = common[better], order[near[better]] + at
                    keep = np.flatnonzero(best >= least)
                    doc = doc_of[where[keep]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block.ids[i] for i in block.item[keep]], pa.int64()),
                            pa.array(block.at[keep], pa.int64()),
                            pa.array(best[keep], pa.int64()),
                            ids.cast(pa.int64()).take(pa.array(doc)),
                            pa.array(where[keep] - begin_of[where[keep]], pa.int64()),
                        ],
                        ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                    )

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scan, "item_id long, item_word long, n_words long, doc_id long, doc_word long"
    )
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "doc_word")).alias("best")
    return (
        found.groupBy("item_id", "item_word")
        .agg(best)
        .select("item_id", "item_word", (-F.col("best.less")).alias("n_words"), "best.doc_id", "best.doc_word")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged; rows that share an id, or have none, are judged each by its text."""
    return without(docs, _contamination(docs, benchmark).where("contaminated"))


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
