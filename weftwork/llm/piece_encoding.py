"""SentencePiece encoding and decoding: Viterbi over distinct marked words in shared-prefix order.

A text is cut into marked words (spaces and what follows them); no piece of the vocabulary reaches over such a cut,
so words segment alone. The distinct new words of a block are sorted, which is the depth-first order of their trie:
a word keeps the forward scores of the prefix that it shares with the one before and computes only what follows.
Ids of words are kept in a bounded table from block to block. Characters that no piece covers become byte pieces;
decoding concatenates pieces, so texts come back exactly.

The vocabulary file is a parameter and is read on the driver; its pieces are broadcast (a fixed size). Scores are
those of the file, added up along a segmentation as a unigram model does.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import small_batches, text_blocks, words_of

#: Words of which a worker keeps the ids.
KEPT_WORDS = 1 << 16
#: Distance below the lowest score at which a character counts that no piece covers.
UNKNOWN = 10.0
INFINITE = float("inf")


class Pieces:
    """A vocabulary: pieces with spaces for marks, scores, byte pieces."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], skip: set[int], unknown: int):
        self.number = {p: i for i, p in enumerate(pieces) if i not in skip and i not in byte_ids.values()}
        self.scores, self.byte_ids, self.unknown = scores, byte_ids, unknown
        self.low = min((scores[i] for i in self.number.values()), default=0.0) - UNKNOWN
        of_byte = {i: bytes([b]) for b, i in byte_ids.items()}
        self.raw = [of_byte.get(i, b"" if i in skip else p.encode()) for i, p in enumerate(pieces)]
        self.trie: dict = {}  # by character; at "": score and number of the piece that ends here
        for p, i in self.number.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (scores[i], i)
        self.sizes = np.array([len(x) for x in self.raw], np.int64)
        self.kept: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        skip = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([x.replace("▁", " ") for x in names], [model.get_score(i) for i in range(n)], byte_ids, skip, model.unk_id())

    def _ids(self, word: str, back: list) -> bytes:
        out, at = array("i"), len(word)
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(word[start:at].encode()))
            else:
                out.append(self.unknown)
            at = start
        out.reverse()
        return out.tobytes()

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit) of each of the sorted ``words``; ties go to the earlier start.

        Each place keeps its best score, where that came from, and the places of the trie that pieces begun before
        it have reached; a word goes on from those of the prefix that it shares with the one before.
        """
        root, low = self.trie, self.low
        best, back, open_, last, out = [0.0], [(0, -1)], [[]], "", []
        for word in words:
            shared = 0
            for a, b in zip(last, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], open_[shared + 1 :]
            active, before = open_[shared], best[shared]
            for at in range(shared, len(word)):
                c, top, link, reached = word[at], -INFINITE, None, []
                for base, start, node in active:
                    if (below := node.get(c)) is not None:
                        reached.append((base, start, below))
                        if (end := below.get("")) is not None and base + end[0] > top:
                            top, link = base + end[0], (start, end[1])
                if (below := root.get(c)) is not None:
                    reached.append((before, at, below))
                    end = below.get("")
                else:
                    end = None
                if end is None:
                    if before + low > top:
                        top, link = before + low, (at, -1)
                elif before + end[0] > top:
                    top, link = before + end[0], (at, end[1])
                best.append(top)
                back.append(link)
                open_.append(reached)
                active, before = reached, top
            last = word
            out.append(self._ids(word, back))
        return out

    def words(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of distinct words; UTF-8 sorts as its code points do."""
        new = sorted(w for w in distinct if w not in self.kept)
        fresh = dict(zip(new, self.segment([w.decode() for w in new]), strict=True))
        found = [x if (x := fresh.get(w)) is not None else self.kept[w] for w in distinct]
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept = {}
        self.kept.update(fresh if len(fresh) <= KEPT_WORDS else {})
        return found

    def encode(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Ids of a block's documents and their offsets; the marked texts and their offsets."""
        ends = offsets.tolist()
        marked = b"".join(b" " + raw[a:b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True))
        sizes = np.diff(offsets)
        at = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        shown = np.frombuffer(marked, np.uint8)
        space = shown == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[at[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begins)
        coded = words_of(shown, starts, np.append(starts[1:], len(shown))).dictionary_encode()
        kinds = self.words(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.array([len(k) for k in kinds], np.int64) // 4
        flat = np.frombuffer(b"".join(kinds), np.int32)
        first = np.cumsum(length) - length
        times = length[codes]
        before = np.concatenate([[0], np.cumsum(times)])
        ids = flat[np.repeat(first[codes] - before[:-1], times) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, at)], marked, at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Marked texts of ids, and their offsets."""
        pieces = pa.array(self.raw, pa.large_binary()).take(pa.array(ids))
        data = pieces.buffers()[2] if len(ids) else None
        return b"" if data is None else data.to_pybytes(), np.concatenate([[0], np.cumsum(self.sizes[ids])])[offsets]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have none; repeated rows are encoded each."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches):
        for keys, raw, offsets in text_blocks(batches):
            ids, at, _, _ = shared.value.encode(raw, offsets)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null or empty ids are the empty text, bad UTF-8 is replaced."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = np.asarray(lists.offsets).astype(np.int64)
            marked, ends = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False), at - at[0])
            texts = [marked[a + 1 : b].decode(errors="replace") if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes (of the decoded text), ids_sha256 (of little-endian 32-bit ids), exact: whether the text comes back."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches):
        for keys, raw, offsets in text_blocks(batches):
            ids, at, marked, ends = shared.value.encode(raw, offsets)
            back, back_ends = shared.value.decode(ids, at)
            sums = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            if back == marked and (back_ends == ends).all():
                same = np.ones(len(sums), bool)
            else:
                same = np.array([marked[a:b] == back[c:d] for a, b, c, d in zip(ends[:-1], ends[1:], back_ends[:-1], back_ends[1:], strict=True)])
            sizes = np.diff(back_ends)
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(np.diff(at)), pa.array(sizes - (sizes > 0)), pa.array(sums), pa.array(same)],
                ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "exact"],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, exact boolean")
