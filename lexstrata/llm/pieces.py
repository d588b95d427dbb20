"""SentencePiece encoding and decoding by a batched numpy Viterbi pass over distinct words.

A chunk of texts is cut into segments wherever two neighbouring characters stand next to each other
in no piece, as no piece can cross such a place. Each distinct segment is encoded once. Segments of
equal length advance together, one character at a time: at each place the hashes of all substrings
that end there probe the sorted keys of the pieces, and a vectorised maximum over their lengths
stores the backpointer.

For unigram models the maximum is over summed piece scores. A merge (BPE) model ranks merges, which
no sum of scores can express: there the maximum is taken over the pieces that may follow the piece
before, i.e. whose pair no earlier merge would have torn apart; exactly one candidate is left at
each place, and the result is that of the merge rule. Runs of blanks, which such a model ranks
equally, and segments over ``LONG`` characters go through a plain queue of merges instead.

Defined results: null and empty texts have no pieces; characters outside the vocabulary become byte
pieces (or the unknown piece, if there are none); U+2581 counts as a blank, as in the library; rows
with repeated ids are encoded each for itself; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .cluster import add_columns, picked, text_rows

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LONG = 48
GROUP = 16_384
#: Distinct segments that a worker remembers, and slots of its table of checked pairs.
REMEMBERED, PAIR_SLOTS = 1 << 18, 1 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.int64(1) << 62


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + n]
            at += n


def _spread(points: np.ndarray) -> np.ndarray:
    return bt.mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class PieceModel:
    """Pieces sorted by hash, their ranks or scores, and which characters may stand side by side."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], merges: bool, prefix: bool = True):
        """``kinds``: of each piece ``normal``, ``byte``, ``unknown`` or ``control``."""
        self.merges, self.prefix, self.size = merges, prefix, len(pieces)
        self.bytes = np.full(256, -1, np.int64)
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.bytes[int(p[3:5], 16)] = i
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.scores = np.array(scores, float)
        order = sorted({-scores[i] for i in normal})
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = {pieces[i]: rank_of[-scores[i]] for i in normal}
        self.id_of = {pieces[i]: i for i in normal}
        self.ranks = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        usable = []
        for i in normal:
            if len(pieces[i]) == 1:
                usable.append(i)
            elif not merges:
                usable.append(i)
            elif set(pieces[i]) == {BLANK}:
                continue
            else:
                last = self._last_merge(pieces[i])
                if last:  # else the merge rule never yields it
                    self.left[i], self.right[i] = self.id_of.get(last[0], self.size), self.id_of.get(last[1], self.size)
                    self.ranks[i] = self.rank[pieces[i]]
                    usable.append(i)
        self.longest = max([1, *(len(pieces[i]) for i in usable)])
        self.power = np.cumprod(np.append(np.uint64(1), np.full(LONG + self.longest + 1, _BASE)), dtype=np.uint64)
        self.lengths = np.array([len(p) for p in pieces] + [1])
        hashes = np.array([self._hash(pieces[i]) for i in usable], np.uint64)
        at = np.argsort(hashes)
        self.keys, self.ids = hashes[at], np.array(usable, np.int64)[at]
        self.hash_of = np.zeros(self.size + 1, np.uint64)
        self.hash_of[self.ids] = self.keys
        self._neighbours([pieces[i] for i in normal])
        self._decoder(pieces, kinds)
        self.forget()

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> PieceModel:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        top = list(_fields(raw))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normalizer = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models that leave characters and blanks as they are can be encoded")
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = sp.vocab_size()
        kinds = ["byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal" for i in range(n)]
        kind = trainer.get(3, 1)
        if kind not in (1, 2):
            raise ValueError("neither a unigram nor a merge model")
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds, kind == 2, bool(normalizer.get(3, 1)))

    def _hash(self, piece: str) -> int:
        points = np.array([ord(c) for c in piece])
        return int((_spread(points) * self.power[: len(piece)]).sum(dtype=np.uint64))

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The pair that the merge rule joins last to make ``piece``; None if it ends otherwise."""
        parts, rank = list(piece), self.rank
        while len(parts) > 2:
            best = min(((rank[j], i) for i in range(len(parts) - 1) if (j := parts[i] + parts[i + 1]) in rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _neighbours(self, pieces: list[str]) -> None:
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.astral = {ord(c): k for k, c in enumerate(chars, 1) if ord(c) > 0xFFFF}
        self.classes = np.zeros(1 << 16, np.uint16)
        for k, c in enumerate(chars, 1):
            if ord(c) <= 0xFFFF:
                self.classes[ord(c)] = k
        number = {c: k for k, c in enumerate(chars, 1)}
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in pieces:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[number[a], number[b]] = True

    def _decoder(self, pieces: list[str], kinds: list[str]) -> None:
        out = []
        for p, k in zip(pieces, kinds, strict=True):
            out.append(bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.replace(BLANK, " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.piece_ends = np.cumsum([len(x) for x in out])
        self.piece_starts = np.append(0, self.piece_ends[:-1])

    def forget(self) -> None:
        self.known, self.known_at, self.known_n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pairs = np.full(PAIR_SLOTS, -1, np.int64) if self.merges else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "known_at", "known_n", "flat", "pairs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    # -- encoding

    def char_ids(self, point: int) -> list[int]:
        """A character of its own: its piece, or its bytes, or the unknown piece."""
        c = chr(point)
        if c in self.id_of:
            return [self.id_of[c]]
        raw = self.bytes[list(c.encode("utf-8", "replace"))].tolist()
        return raw if min(raw) >= 0 else [self.unknown]

    def queue_merges(self, text: str) -> list[int]:
        """The merge rule itself, with a queue: for runs of blanks and very long segments."""
        parts, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        queue = [(rank[j], i, j) for i in range(n - 1) if (j := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            k = after[i]
            if parts[i] is None or k < 0 or parts[i] + parts[k] != joined:
                continue
            parts[i], parts[k] = joined, None
            after[i] = after[k]
            if after[k] >= 0:
                before[after[k]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (j := parts[a] + parts[b]) in rank:
                    heapq.heappush(queue, (rank[j], a, j))
        return [i for p in parts if p is not None for i in ([self.id_of[p]] if p in self.id_of else self.char_ids(ord(p)))]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merge rule leaves pieces ``a`` and ``b`` side by side."""
        key = a * (self.size + 1) + b
        slot = (key.astype(np.uint64) * _BASE >> np.uint64(44)).astype(np.int64)
        held = self.pairs[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = self._check_pairs(fresh // (self.size + 1), fresh % (self.size + 1))
            out[new] = found[back]
            self.pairs[slot[new]] = key[new] << 1 | out[new]
        return out

    def _check_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the merges of both pieces from the last on; a joint piece of earlier rank would have torn the pair."""
        a, b = a.copy(), b.copy()
        out, limit, active = np.ones(len(a), bool), np.full(len(a), _NONE), np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            at = bt.find_sorted(self.keys, self.hash_of[x] + self.power[self.lengths[x]] * self.hash_of[y])
            joint = np.where(at >= 0, 2 * self.ranks[self.ids[at]], _NONE)
            torn = joint < limit[active]
            out[active[torn]] = False
            rx, ry = self.ranks[x], self.ranks[y]
            on = ~torn & ((rx >= 0) | (ry >= 0))
            active, x, y, rx, ry = active[on], x[on], y[on], rx[on], ry[on]
            undo_a = rx > ry
            limit[active] = np.where(undo_a, 2 * rx, 2 * ry + 1)
            a[active] = np.where(undo_a, self.right[x], x)
            b[active] = np.where(undo_a, y, self.left[y])
        return out

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of equal length (one a row of ``points``): piece and its length by the place where it ends, 0 elsewhere."""
        words, n = points.shape
        sums = np.zeros((words, n + 1), np.uint64)
        np.cumsum(_spread(points) * self.power[:n], axis=1, out=sums[:, 1:])
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        down = np.cumprod(np.append(np.uint64(1), np.full(n, inverse)), dtype=np.uint64)
        best = np.full((words, n + 1), -np.inf)
        best[:, 0] = 0.0
        last, back = np.full((words, n + 1), self.size, np.int64), np.zeros((words, n + 1), np.int64)
        penalty = (self.scores.min() if self.size else 0.0) - 10
        for end in range(1, n + 1):
            top = min(end, self.longest)
            score, piece = np.full((words, top), -np.inf), np.full((words, top), self.size, np.int64)
            for k in range(1, top + 1):
                start = end - k
                at = bt.find_sorted(self.keys, (sums[:, end] - sums[:, start]) * down[start])
                here = np.flatnonzero((at >= 0) & (best[:, start] > -np.inf))
                found = self.ids[at[here]]
                piece[here, k - 1] = found
                if self.merges:
                    fits = np.ones(len(here), bool) if not start else self.may_follow(last[here, start], found)
                    score[here, k - 1] = np.where(fits, k, -np.inf)
                else:
                    score[here, k - 1] = best[here, start] + self.scores[found]
            lone = np.flatnonzero((piece[:, 0] == self.size) & (best[:, end - 1] > -np.inf))
            score[lone, 0] = 1 if self.merges else best[lone, end - 1] + penalty
            pick = score.argmax(1)
            rows = np.arange(words)
            best[:, end], last[:, end], back[:, end] = score[rows, pick], piece[rows, pick], np.where(score[rows, pick] > -np.inf, pick + 1, 0)
        taken, at = np.zeros((words, n + 1), np.int64), np.full(words, n)
        rows = np.arange(words)
        while (on := at > 0).any():
            r, p = rows[on], at[on]
            taken[r, p] = np.maximum(back[r, p], 1)
            at[on] = p - taken[r, p]
        return last, taken

    def _encode_distinct(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each segment, one after another, and how many each has."""
        n = ends - starts
        out: list = [None] * len(n)
        blank = ord(BLANK)
        runs = (points[starts] == blank) & (points[np.minimum(starts + 1, ends - 1)] == blank) & (n > 1) & self.merges
        single = np.flatnonzero(n == 1)
        for i in single.tolist():
            out[i] = self.char_ids(int(points[starts[i]]))
        slow = (n > LONG) | runs if self.merges else np.zeros(len(n), bool)
        for i in np.flatnonzero(slow).tolist():
            out[i] = self.queue_merges("".join(map(chr, points[starts[i] : ends[i]].tolist())))
        rest = np.flatnonzero((n > 1) & ~slow)
        rest = rest[np.argsort(n[rest], kind="stable")]
        cuts = np.flatnonzero(np.append(True, np.diff(n[rest]) > 0)) if len(rest) else []
        for group in np.split(rest, cuts[1:]) if len(rest) else []:
            for some in np.split(group, range(GROUP, len(group), GROUP)):
                width = int(n[some[0]])
                matrix = points[starts[some][:, None] + np.arange(width)]
                last, taken = self.viterbi(matrix)
                row, end = np.nonzero(taken)
                ids = last[row, end]
                bounds = np.searchsorted(row, np.arange(len(some) + 1))
                lone = ids == self.size
                if lone.any():
                    for k, i in enumerate(some.tolist()):
                        own = slice(bounds[k], bounds[k + 1])
                        out[i] = [x for p, e in zip(ids[own].tolist(), end[own].tolist(), strict=True) for x in (self.char_ids(int(matrix[k, e - 1])) if p == self.size else (p,))]
                else:
                    listed = ids.tolist()
                    for k, i in enumerate(some.tolist()):
                        out[i] = listed[bounds[k] : bounds[k + 1]]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((x for ids in out for x in ids), np.int32, int(counts.sum())), counts

    def encode(self, chunk: bt.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows of a chunk, and where each row's begin."""
        begins = (chunk.buf & 0xC0) != 0x80
        points = np.frombuffer(chunk.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        offsets = np.append(0, np.cumsum(begins))[chunk.offsets]
        blank = ord(BLANK)
        if self.prefix:
            full = np.flatnonzero(np.diff(offsets) > 0)
            points = np.insert(points, offsets[full], blank)
            offsets = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(chunk.rows + 1, np.int64)
        points[points == 32] = blank
        cls = self.classes[np.where(points <= 0xFFFF, points, 0)]
        if (points > 0xFFFF).any():
            for i in np.flatnonzero(points > 0xFFFF).tolist():
                cls[i] = self.astral.get(int(points[i]), 0)
        cut = np.append(True, ~self.beside[cls[:-1], cls[1:]])
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        up, down = bt.powers(n + 1)
        sums = np.append(np.uint64(0), np.cumsum(_spread(points) * up[:n], dtype=np.uint64))
        h = bt.mix((sums[ends] - sums[starts]) * down[starts])
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = bt.find_sorted(self.known, distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, counts = self._encode_distinct(points, starts[first[new]], ends[first[new]])
            if len(self.known) > REMEMBERED:
                pairs = self.pairs
                self.forget()
                self.pairs = pairs
                if len(new) < len(distinct):  # what was known is gone: encode the chunk's segments anew
                    return self.encode(chunk)
            places = len(self.flat) + np.cumsum(counts) - counts
            keys = np.append(self.known, distinct[new])
            order = np.argsort(keys, kind="stable")
            self.known, self.known_at, self.known_n = keys[order], np.append(self.known_at, places)[order], np.append(self.known_n, counts)[order]
            self.flat = np.append(self.flat, flat)
            at = bt.find_sorted(self.known, distinct)
        count = self.known_n[at][back]
        total = np.append(0, np.cumsum(count))
        ids = self.flat[np.repeat(self.known_at[at][back] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows and where each row's begin; the blank that encoding puts first is dropped."""
        n = (self.piece_ends - self.piece_starts)[ids]
        total = np.append(0, np.cumsum(n))
        out = self.piece_bytes[np.repeat(self.piece_starts[ids] - total[:-1], n) + np.arange(total[-1])]
        bounds = total[offsets]
        if self.prefix:
            full = np.flatnonzero(np.diff(bounds) > 0)
            drop = bounds[full][out[bounds[full]] == 32]
            keep = np.ones(len(out), bool)
            keep[drop] = False
            gone = np.append(0, np.cumsum(~keep))
            out, bounds = out[keep], bounds - gone[bounds]
        return out, bounds


def encode(docs: DataFrame, *, model_path: str = MODEL_PATH, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, n_pieces, pieces_sha256, round_trip, pieces) for every row: its piece ids, the digest of
    them as little-endian 32-bit numbers, and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    columns = [id_column, *keep]
    docs = picked(docs, *columns, text_column)
    rows = text_rows(docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_column).alias("_text")), *columns, "_text")
    schema = add_columns(docs.select(*[F.col(f"`{c}`") for c in columns]).schema, n_pieces="long", pieces_sha256="string", round_trip="boolean", pieces="array<int>")
    blank = BLANK.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in bt.chunks(bt.string_column(batch, "_text")):
                ids, bounds = model.encode(chunk)
                out, at = model.decode(ids, bounds)
                raw, packed = chunk.buf.tobytes(), ids.astype("<i4").tobytes()
                decoded, places, own = out.tobytes(), at.tolist(), chunk.offsets.tolist()
                same = [decoded[places[r] : places[r + 1]] == raw[own[r] : own[r + 1]].replace(blank, b" ") for r in range(chunk.rows)]
                digests = [hashlib.sha256(packed[4 * bounds[r] : 4 * bounds[r + 1]]).hexdigest() for r in range(chunk.rows)]
                part = [c.slice(chunk.first, chunk.rows) for c in batch.columns[:-1]]
                pieces = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(bounds)), pa.array(digests), pa.array(same), pieces], names=[*columns, "n_pieces", "pieces_sha256", "round_trip", "pieces"])

    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, *, model_path: str = MODEL_PATH, id_column: str = "doc_id", pieces_column: str = "pieces") -> DataFrame:
    """(id, text) from piece ids; a null list gives a null text, bytes that aren't UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    encoded = picked(encoded, id_column, pieces_column)
    kind = encoded.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                out = None if ids is None else model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")
                texts.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return text_rows(encoded, id_column, pieces_column).mapInArrow(work, f"{id_column} {kind}, text string")


def report(docs: DataFrame, *, model_path: str = MODEL_PATH) -> DataFrame:
    return encode(docs, model_path=model_path)
