"""Encoding and decoding with a SentencePiece model of the merge type, exactly as its library does.

The encoder never runs the merges over a text. It walks the text from left to right and always
tries the longest piece that starts there (found by an Aho-Corasick automaton), then that piece's
shorter prefixes. A piece may follow the one before it only if merging would really leave the two
side by side; that is checked by undoing their merges one at a time, latest first, and seeing
whether a merge across the border would have come first. If nothing fits, the position is marked in
a bitfield of failed positions and the last piece is taken back.

Texts are cut where no piece can reach across (before a space, around a line feed), and what these
chunks encode to is remembered in each worker up to a bounded number of chunks.

Cases: a null text counts as empty and has no ids; characters that the vocabulary lacks become
their bytes; texts of any length are encoded whole; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship

#: Chunks that a worker remembers; beyond that the younger half goes. Longer chunks aren't remembered.
CACHE, LONG_CHUNK = 800_000, 64
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value = data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            value = np.frombuffer(data[at : at + size], "<f4" if size == 4 else "<f8")[0]
            at += size
        yield key >> 3, value


class PieceCodec:
    """encode(text) -> ids and decode(ids) -> text of one model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        pieces: list[tuple[str, float, int]] = []
        normaliser: dict = {}
        with open(path, "rb") as f:
            model = f.read()
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), float(piece.get(2, 0.0)), piece.get(3, NORMAL)))
            elif field == 2:
                if dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("the model isn't of the merge type")
            elif field == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("only models without a character map are supported")
        if normaliser.get(4, 1):
            raise ValueError("only models that keep extra white space are supported")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        if any(kind == USER_DEFINED for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.pieces = pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.byte_ids = {int(p[0][1:-1], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p[2] in (NORMAL, UNUSED)}
        order = sorted(self.ids.values(), key=lambda i: (-pieces[i][1], i))
        #: Ranks count merges from the best; all that follows works on ranks.
        self.of_rank = order
        self.rank = {pieces[i][0]: r for r, i in enumerate(order)}
        self.texts = [pieces[i][0] for i in order]
        self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        # A node's children are tried in the order they came: characters of many pieces first.
        common = Counter(c for t in self.texts for c in t)
        for r in sorted(self.reachable, key=lambda r: [-common[c] for c in self.texts[r]]):
            self.automaton.add_word(self.texts[r], r)
        self.automaton.make_automaton()
        self.chars = frozenset(t for t in self.rank if len(t) == 1)
        self.known: dict[str, bytes] = {}
        self.fitting: dict[int, bool] = {}
        self.inner = {pair for t in self.texts for pair in zip(t, t[1:], strict=False)}
        self.chunks = re.compile(self._chunk_pattern()).findall
        self.bytes_of = [self._bytes(i) for i in range(len(pieces))]

    def _chunk_pattern(self) -> str:
        """Matches stretches of text between which no piece can reach: before spaces, around line feeds, before marks that follow letters."""
        if any(SPACE in t.lstrip(SPACE) for t in self.rank) or any("\n" in t for t in self.rank):
            return r"(?s).+"
        marks = {c for c in self.chars if not (c.isalpha() or c.isdecimal()) and c not in (SPACE, "\n")}
        while reached := {b for a, b in self.inner if b in marks and a not in marks and a != SPACE}:
            marks -= reached
        among = "".join(map(re.escape, sorted(marks)))
        return f"\n|{SPACE}*[^{SPACE}\n{among}]+|{SPACE}*[{among}][^{SPACE}\n]*|{SPACE}+" if marks else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"

    def _bytes(self, i: int) -> bytes:
        text, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(text[1:-1], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return text.replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging, best pair first, leftmost among equals. Slow: for tables."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _learn_merges(self) -> None:
        """The last merge of each piece, by merging its own characters; pieces that don't come out whole can't occur."""
        n = len(self.texts)
        self.left, self.right, self.reachable = list(range(n)), list(range(n)), []
        self.pairs: dict[tuple[int, int], int] = {}
        for r, t in enumerate(self.texts):
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = r
            if len(t) == 1:
                self.reachable.append(r)
                continue
            parts = list(t)
            while len(parts) > 2:
                best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and parts[0] in self.rank and parts[1] in self.rank:
                self.left[r], self.right[r] = self.rank[parts[0]], self.rank[parts[1]]
                self.reachable.append(r)
        ok = set(self.reachable)
        at = {self.texts[r]: r for r in self.reachable}
        self.shorter = [-1] * n
        for r in ok:
            t = self.texts[r]
            self.shorter[r] = next((at[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in at), -1)
        self.length = [len(t) for t in self.texts]

    def fits(self, a: int, b: int) -> bool:
        """Would merging leave piece b right after piece a? Undoes their merges, latest first."""
        pairs, left, right, limit = self.pairs, self.left, self.right, 1 << 40
        while True:
            r = pairs.get((a, b))
            if r is not None and r < limit:
                return False
            # The later of the two merges is undone. One in b gives way to an equal one across the border, which lies further left.
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _known_run(self, text: str) -> list[int]:
        """Ranks for a text whose characters are all in the vocabulary."""
        end, length, shorter, fitting = len(text), self.length, self.shorter, self.fitting
        longest = [-1] * end
        for last, r in self.automaton.iter(text):
            longest[last + 1 - length[r]] = r  # those that end later, so longer ones, come later
        failed = bytearray(end + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        while at < end:
            last = out[-1] if out else -1
            while piece >= 0:
                stop = at + length[piece]
                if not failed[stop]:
                    if last < 0:
                        break
                    fit = fitting.get(last << 32 | piece)
                    if fit is None:
                        if len(fitting) > CACHE:
                            fitting.clear()
                        fit = fitting[last << 32 | piece] = self.fits(last, piece)
                    if fit:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = stop
                piece = longest[at] if at < end else -1
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed[at] = 1
                piece = out.pop()
                at -= length[piece]
        return out

    def _part(self, part: str) -> bytes:
        if self.chars.issuperset(part):
            return np.array([self.of_rank[r] for r in self._known_run(part)], "<i4").tobytes()
        out: list[int] = []
        run = ""
        for c in [*part, ""]:
            if c in self.chars:
                run += c
                continue
            if run:
                out += [self.of_rank[r] for r in self._known_run(run)]
                run = ""
            out += [self.byte_ids.get(b, self.unknown) for b in c.encode()] if self.byte_ids else [self.unknown] * bool(c)
        return np.array(out, "<i4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't remembered. A long one is cut between characters that no piece has side by side."""
        if len(chunk) <= LONG_CHUNK:
            return self._part(chunk)
        inner, known, start, out = self.inner, self.known, 0, []
        for i, pair in enumerate(zip(chunk, chunk[1:], strict=False), 1):
            if pair not in inner:
                out.append(chunk[start:i])
                start = i
        if not start:
            return self._part(chunk)
        out.append(chunk[start:])
        for part in out:
            if part not in known and len(part) <= LONG_CHUNK:
                known[part] = self._part(part)
        return b"".join(known[p] if p in known else self._part(p) for p in out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        chunks = self.chunks(SPACE + text if self.dummy_prefix else text)
        known = self.known
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<i4").tolist()
        except KeyError:
            pass
        if len(known) > CACHE:  # chunks seen early are the common ones
            known = self.known = dict(islice(known.items(), CACHE // 2))
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        for c in new:
            known[c] = self._chunk(c)
        ids = np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<i4").tolist()
        for c in new:
            if len(c) > LONG_CHUNK:
                known.pop(c, None)
        return ids

    def decode_bytes(self, ids) -> bytes:
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


#: Takes a document's ids and its decoded bytes and returns the values of the result's columns.
Finish = Callable[[list[int], bytes], tuple]


def whole(ids: list[int], decoded: bytes) -> tuple:
    return ids, decoded.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", finish: Finish = whole, schema: str = "ids array<int>, decoded string") -> DataFrame:
    """doc_id and what ``finish`` makes of each document's ids and decoded text."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(parsed)
        coder = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = coder.encode(text.as_py())
                    rows.append((doc, *finish(ids, coder.decode_bytes(ids))))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, types, strict=True)], schema=types)

    full = f"doc_id long, {schema}"
    parsed = docs.sparkSession.createDataFrame([], full).schema
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, full)
