"""Byte-level BPE encoding and decoding.

Text is cut into pieces without a regular expression. Every code point gets a
class (letter, number, white space, other); most piece starts follow from the
classes of neighbours alone. Contractions (``'s 't 're 've 'm 'll 'd``) need
state, which a four-state automaton carries: each code point is a transition
function packed into one byte, and functions are composed by a table in a
doubling scan, which ends once every composite has become a constant function.
The slices between starts feed pair merging by rank, whose results are cached
per worker process. The byte where each piece starts is retained on demand;
decoding then holds every retained offset against the tokens' ends, so that
each piece can be cut out of the decoded bytes.

Defined results: null and empty texts give no ids; unknown rows do not exist
because every byte is a token. Repeated rows and clashing column names are
kept as they are, since encoding adds columns and drops none but the text's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.textscan import Chunk, chunks

OTHER, LETTER, NUMBER, BLANK, BREAK = range(5)
#: White space as Unicode's White_Space property has it (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16, which the tokenizer's library follows, has beyond Python's tables (fixed values): first and last code point.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Entries of a worker's merge cache; a full cache is emptied.
CACHE_ENTRIES = 300_000
#: Code points of the longest piece that is kept; with it the cache has a bound in bytes too.
CACHED_LENGTH = 64

_CLASSES: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """Class of each code point."""
    if not _CLASSES:
        import unicodedata

        first = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
            for first, last in ranges:
                table[first : last + 1] = kind
        table[WHITE_SPACE] = BLANK
        _CLASSES.append(table)
    return _CLASSES[0]


# --- transition functions over the states: 0 free, 1 and 2 letters of a contraction to go, 3 contraction just ended
def _pack(images: tuple[int, int, int, int]) -> int:
    return sum(v << (2 * s) for s, v in enumerate(images))


PLAIN, SHORT, LONG = (_pack((k, 3, 1, k)) for k in (0, 1, 2))
_IMAGE = np.array([[(f >> (2 * s)) & 3 for s in range(4)] for f in range(256)], dtype=np.uint8)
#: COMPOSE[f, g] is "first f, then g".
COMPOSE = (np.take_along_axis(np.broadcast_to(_IMAGE[None], (256, 256, 4)), _IMAGE[:, None, :].astype(np.int64).repeat(256, 1), 2) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(2).astype(np.uint8)
CONSTANT = np.array([len(set(row)) == 1 for row in _IMAGE.tolist()])


def scan_states(functions: np.ndarray) -> np.ndarray:
    """State after each function, from state 0: an inclusive scan by doubling that stops once all composites are constant."""
    composed, stride = functions.copy(), 1
    while stride < len(composed):
        pending = np.flatnonzero(~CONSTANT[composed[stride:]]) + stride
        if not len(pending):
            break
        composed[pending] = COMPOSE[composed[pending - stride], composed[pending]]
        stride *= 2
    return composed & 3


def piece_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Positions where pieces start; ``breaks`` are separators between texts, each a piece of its own."""
    n = len(points)
    kind = code_point_classes()[points]
    kind[breaks] = BREAK
    before = np.empty(n, dtype=np.uint8)
    before[0] = BREAK
    before[1:] = kind[:-1]
    after = np.empty(n, dtype=np.uint8)
    after[-1] = BREAK
    after[:-1] = kind[1:]
    spaced = np.zeros(n, dtype=bool)  # the code point before is U+0020
    spaced[1:] = (points[:-1] == 0x20) & (kind[:-1] == BLANK)
    starts = kind != before
    blank = kind == BLANK
    starts |= blank & (before == BLANK) & (after != BLANK) & (after != BREAK)
    starts &= blank | (kind == BREAK) | ~spaced
    starts |= kind == BREAK
    marks = np.flatnonzero((points == 0x27) & starts)
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        sep = np.concatenate([kind, np.full(2, BREAK, dtype=np.uint8)])
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            length[(one == ord(a)) & (two == ord(b)) & (sep[marks + 2] != BREAK)] = 2
        length[sep[marks + 1] == BREAK] = 0
        if length.any():
            functions = np.full(n, PLAIN, dtype=np.uint8)
            functions[marks[length == 1]] = SHORT
            functions[marks[length == 2]] = LONG
            state = np.zeros(n, dtype=np.uint8)  # before each code point
            # only the neighbourhood of a mark can leave state 0, and a constant PLAIN run resets it
            state[1:] = scan_states(functions)[:-1]
            starts &= (state != 1) & (state != 2)
            starts |= state == 3
    return np.flatnonzero(starts)


class Merger(dict):
    """Piece of text -> its ids as little-endian 32-bit bytes, filled on demand by pair merging."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.merge(raw)
        packed = np.array(ids, dtype="<i4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Joins the adjacent pair of least rank, leftmost first, until no pair has one."""
        if len(raw) > 200:
            return self.merge_long(raw)
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pair = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges from a heap and a linked list, for pieces where repeated scans would be quadratic."""
        from heapq import heapify, heappop, heappush

        get, n = self.ranks.get, len(raw)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := left[i]) >= 0 and (r := get(raw[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out


_VOCABULARIES: dict[str, tuple[dict[bytes, int], Merger]] = {}


def vocabulary(path: str) -> tuple[dict[bytes, int], Merger]:
    """Ranks of a vocabulary file, one base64 token and rank a line, and this process's merge cache."""
    if path not in _VOCABULARIES:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _VOCABULARIES[path] = ranks, Merger(ranks)
    return _VOCABULARIES[path]


def encode_chunk(chunk: Chunk, merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts end to end, ids per text, byte end of each piece within its text, pieces per text."""
    texts = [chunk.text_of(k).tobytes().decode("utf-8") for k in range(len(chunk))]
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    breaks = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    starts = piece_starts(points, breaks)
    first = np.searchsorted(starts, breaks)
    bounds = starts.tolist()
    packed, counts, pieces, begin = [], [], [], 0
    for stop in first.tolist():
        own = bounds[begin : stop + 1]
        got = b"".join([merger[joined[a:b]] for a, b in zip(own, own[1:], strict=False)])
        packed.append(got)
        counts.append(len(got) >> 2)
        pieces.append(stop - begin)
        begin = stop + 1
    ends = np.delete(starts, first)
    return np.frombuffer(b"".join(packed), dtype="<i4"), np.array(counts, dtype=np.int64), ends, np.array(pieces, dtype=np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def encode(frame: DataFrame, path: str, text: str = "text", ids: str = "ids", starts: str | None = None, offsets: str | None = None) -> DataFrame:
    """Replaces ``text`` by ``ids`` (array of int) and, if named, ``starts`` and ``offsets``: the code point and the byte where each piece starts.

    Narrow: no shuffle. Other columns pass through; one named like an output is replaced.
    """
    outputs = [ids] + [c for c in (starts, offsets) if c]
    kept = [c for c in frame.columns if c != text and c not in outputs]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, merger = vocabulary(path)
        for chunk in chunks(batches, text):
            values, counts, begin, pieces = encode_chunk(chunk, merger)
            columns = [chunk.column(c) for c in kept] + [_lists(values, counts, pa.int32())]
            if starts or offsets:
                begin = begin - np.repeat(np.arange(len(chunk)), pieces)  # without the separators between texts
                points = np.flatnonzero((chunk.data & 0xC0) != 0x80)  # the byte of each code point
                if starts:
                    columns.append(_lists((begin - np.repeat(np.searchsorted(points, chunk.offsets[:-1]), pieces)).astype(np.int32), pieces, pa.int32()))
                if offsets:
                    columns.append(_lists((points[begin] - np.repeat(chunk.offsets[:-1], pieces)).astype(np.int32), pieces, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=kept + outputs)

    return frame.select(*kept, text).mapInArrow(run, schema)


class Tokens:
    """All tokens' bytes end to end, for decoding many ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.start, self.length = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        at, parts = 0, []
        for raw, rank in ranks.items():
            self.start[rank], self.length[rank] = at, len(raw)
            parts.append(raw)
            at += len(raw)
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``ids`` end to end, and where each token ends. An unknown id is a KeyError."""
        known = (ids >= 0) & (ids < len(self.start))
        if not known.all() or (self.length[ids] < 0).any():
            raise KeyError(int(ids[~known][0] if not known.all() else ids[self.length[ids] < 0][0]))
        length = self.length[ids]
        ends = np.cumsum(length)
        place = np.repeat(self.start[ids] - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes[place], ends


_TOKENS: dict[str, Tokens] = {}
#: Ids that are decoded together.
DECODED = 1 << 19


def decode(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded", offsets: str | None = None) -> DataFrame:
    """Adds ``out``: the bytes that ``ids`` stand for; null ids decode to no bytes. Raises KeyError on an unknown id.

    With ``offsets`` (bytes where pieces start, as :func:`encode` retains them) each must be where a token starts, else ValueError.
    """
    kept = [c for c in frame.columns if c != out]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])

    def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(batch.schema.get_field_index(name))
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(vocabulary(path)[0])
        for batch in batches:
            values, cuts = column(batch, ids)
            pieces, piece_cuts = column(batch, offsets) if offsets else (None, None)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + DECODED, "right")) - 1)
                raw, ends = _TOKENS[path].decode(values[cuts[first] : cuts[last]])
                edges = np.concatenate([[0], ends])[cuts[first : last + 1] - cuts[first]]
                if offsets:
                    own = piece_cuts[first : last + 1]
                    wanted = pieces[own[0] : own[-1]] + np.repeat(edges[:-1], np.diff(own))
                    begins = ends - np.diff(ends, prepend=0)
                    near = np.minimum(np.searchsorted(begins, wanted), max(0, len(begins) - 1))
                    if len(wanted) and (not len(begins) or (begins[near] != wanted).any()):
                        raise ValueError("a retained offset is inside a token")
                decoded = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(batch.schema.get_field_index(c)) for c in kept] + [decoded], names=[*kept, out])
                first = last

    return frame.select(*kept).mapInArrow(run, schema)


def digests(decoded: DataFrame, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """doc_id with the count and digests of its ids and of its decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
        F.sha2(raw, 256).alias("decoded_sha256"),
    )
