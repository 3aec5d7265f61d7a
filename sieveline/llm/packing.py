"""Packing of token sequences into windows by best-fit decreasing.

A document's tokens are first cut into full windows; what is left over is packed with the left-overs
of other documents, longest first, each into the open window with the least room that still holds
it. The open windows stand in a segment tree indexed by their remaining capacity, so that window is
found in logarithmic time.

Tokens are counted in the task that reads the documents, which also writes the full windows. The
left-overs of all tasks, narrow rows, are dealt evenly into groups of about ``BLOCK`` and each group is
packed in a task, so memory is bounded and padding doesn't depend on how the input is partitioned: a
group leaves a window or two partly filled. Sequence ids are unique (the partition number is their
upper part, and left-overs have a bit of their own).

Cases: a null text counts as empty and still has its end token; an empty table gives no pieces;
repeated rows and ids are packed each on its own; white space and other columns don't matter; of a
very long text a task holds the words and ids, as it does the text itself.
"""

from __future__ import annotations

import json
import re
import string
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship, stored

WINDOW, END_ID, BLOCK = 4096, 2, 32_768
#: Words and stems whose ids a worker remembers, about 200 bytes each; later ones and longer words are looked up again.
CACHE, STEMS, LONG_WORD = 250_000, 200_000, 64
MARKS = string.punctuation
#: Characters of text whose unknown words are looked up together.
CHUNK = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BestFit:
    """Open windows by remaining capacity, below a segment tree over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.room: list[int] = []

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of an open window that is ``need`` or more."""
        count, node = self.count, need + self.size
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.size

    def put(self, length: int) -> tuple[int, int]:
        """Window and offset of a piece."""
        room = self.tightest(length)
        if room is None:
            window, room = len(self.room), self.capacity
            self.room.append(room)
        else:
            window = self.open[room].pop()
            self._change(room, -1)
        left = self.room[window] = room - length
        if left:
            self.open[left].append(window)
            self._change(left, 1)
        return window, self.capacity - room


def pack_lengths(lengths, capacity: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset for each length (1..capacity), packed longest first; ties in input order."""
    fit, windows, offsets = BestFit(capacity), [0] * len(lengths), [0] * len(lengths)
    for i in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist():
        windows[i], offsets[i] = fit.put(lengths[i])
    return windows, offsets


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, remembered by word.

    Space and line feed never lie inside a token of this kind of vocabulary (white space only parts
    words), so a text's ids are those of its words in turn. A word of Latin letters and marks after
    them has the ids of the lower-case letters and then those of the marks.
    """

    PARTS = re.compile(r"^([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)$|^.+$", re.MULTILINE).findall

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        normal, split = about["normalizer"]["normalizers"], about["pre_tokenizer"]["pretokenizers"]
        words = [x for x in split if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[\p{L}]+" in x["pattern"]["Regex"]]
        if about["model"].get("end_of_word_suffix") != "</w>" or not words or not {"Lowercase", "NFC"} <= {x["type"] for x in normal} or any(x.get("add_prefix_space") for x in split):
            raise ValueError("not a vocabulary of lower-case words that white space parts")
        self.tokenizer = Tokenizer.from_file(path)
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.ends = np.array([i in ends for i in range(self.tokenizer.get_vocab_size() + 1)])
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_stems(self, stems: list[str]) -> None:
        """One call for many: each is one run of letters, so it ends with its first token that ends a word."""
        for i in range(0, len(stems), 2000):
            part = stems[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                flat = ids.tobytes()
                for w, a, b in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    self.stems[w] = flat[4 * a : 4 * b]
            else:
                self.stems.update(zip(part, self._whole(part), strict=True))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        stems = self.stems
        parts = self.PARTS("\n".join(words).lower())  # one for each word: letters and marks, or neither
        new = {p[0] for p in parts}.difference(stems)
        self._learn_stems(list(new))
        marks = list({p[1] for p in parts}.difference(stems))
        stems.update(zip(marks, self._whole(marks), strict=True))
        found = {w: stems[p[0]] + stems[p[1]] for w, p in zip(words, parts, strict=True) if p[0]}
        odd = [w for w, p in zip(words, parts, strict=True) if not p[0]]
        for i in range(0, len(odd), 10_000):
            found.update(zip(odd[i : i + 10_000], self._whole(odd[i : i + 10_000]), strict=True))
        if len(stems) > STEMS:  # what came last goes: words seen early are the common ones
            for w in new:
                del stems[w]
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = set().union(*words).difference(known)
        known.update(self._learn(list(new)) if new else ())
        ids = [b"".join(map(known.__getitem__, w)) for w in words]
        if len(known) > CACHE:
            for w in new:
                del known[w]
        else:
            for w in new:
                if len(w) > LONG_WORD:
                    del known[w]
                    self.stems.pop(w.rstrip(MARKS).lower(), None)
        return ids


def chunks(texts: list[str], size: int = CHUNK):
    """Runs of texts of about ``size`` characters together."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One for each worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _batches(rows: list[tuple], with_ids: bool):
    """Rows of ``SCHEMA`` (and ids) as Arrow batches."""
    import pyarrow as pa

    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
    for i in range(0, len(rows), 20_000):
        cols = list(zip(*rows[i : i + 20_000], strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in cols[7]], pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(arrays, names)


def _cutter(path: str, window: int, end_id: int, with_ids: bool):
    """Rows (doc_id, text) -> pieces: full windows with their sequence, left-overs without."""

    def run(batches):
        from pyspark import TaskContext

        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            docs, at = batch.column(0).to_pylist(), 0
            for texts in chunks([t.as_py() or "" for t in batch.column(1)]):
                rows = []
                for ids in encode(texts):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        part = ids[4 * start : 4 * (start + window)]
                        whole = len(part) == 4 * window
                        rows.append((docs[at], start, len(part) // 4, zlib.crc32(part), n, sequence if whole else None, 0, *(part,) * with_ids))
                        sequence += whole
                    at += 1
                yield from _batches(rows, with_ids)

    return run


def _fitter(window: int, with_ids: bool):
    """Left-overs of a group -> the same with their sequence and offset."""

    def run(batches):
        from pyspark import TaskContext

        base, rows = TaskContext.get().partitionId() << 36 | 1 << 62, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            ids = [[np.array(x.as_py(), "<i4").tobytes() for x in batch.column(7)]] if with_ids else []
            rows.extend(zip(*cols, *ids, strict=True))
        windows, offsets = pack_lengths([r[2] for r in rows], window)
        yield from _batches([(*r[:5], base + w, o, *r[5:]) for r, w, o in zip(rows, windows, offsets, strict=True)], with_ids)

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.

    with_ids: also the piece's token ids (array<int>), for writing sequences.
    """
    ship(docs.sparkSession)
    schema = SCHEMA + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_cutter(vocabulary, window, end_id, with_ids), schema)
    pieces = stored(pieces, "pieces")
    rest = pieces.filter("sequence_id IS NULL")
    groups = -(-rest.count() // block)
    return pieces.filter("sequence_id IS NOT NULL").unionByName(rest.repartition(max(1, groups)).mapInArrow(_fitter(window, with_ids), schema))
