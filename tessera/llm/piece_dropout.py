"""SentencePiece (merge type) encoding with seeded merge-dropout, and lossless decoding.

An agenda holds the candidate merges of neighbouring symbols; the best scored one (leftmost of
equals) is taken first. With dropout a candidate is skipped if a keyed hash falls below the rate.

The key is (seed, document id, text, the chunk's place in the text, the three boundaries of the
candidate): each occurrence of a word has draws of its own. The hash depends on nothing else, so a
document is always cut the same way for a seed, on any executor, and other seeds cut it otherwise.

No piece of the vocabulary holds a blank after another character, so merges never cross the start
of a run of blanks: a text is encoded chunk by chunk, and each worker remembers chunks.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytes_np import U64, mix
from tessera.llm.common import give_back

BLANK = "▁"
_CUT = re.compile(r"(?<! )(?= )")
#: Longer chunks are encoded one by one, shorter ones many at a time.
LONG = 40
_NO_MERGE = np.iinfo(np.int64).max
_OUTSIDE = 1 << 20  # a character without a piece is this plus its code point
_WIDE = 1 << 21  # symbols are below 2 * _OUTSIDE + the last code point


class Pieces:
    """The vocabulary of a SentencePiece merge model: its characters, merges and bytes."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(len(names))]
        ids = {name: i for i, name in enumerate(names) if plain[i]}
        if any(BLANK in name.lstrip(BLANK) for name in ids):
            raise ValueError("a piece holds a blank inside; texts can't be cut at blanks")
        self.byte_ids = np.zeros(256, np.int64)
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
        self.bytes = [
            bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(BLANK, " ").encode() if plain[i] else b""
            for i, name in enumerate(names)
        ]
        self.chars = {name: i for name, i in ids.items() if len(name) == 1}
        known = lambda s: ids.get(s, _OUTSIDE + ord(s) if len(s) == 1 else None)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = known(name[:cut]), known(name[cut:])
                if left is not None and right is not None:
                    self.merges[left, right] = (-int(model.get_score(i)), i)
        pairs = sorted(self.merges.items(), key=lambda kv: kv[0][0] * 2 * _WIDE + kv[0][1])
        self.pair_keys = np.array([a * 2 * _WIDE + b for (a, b), _ in pairs] or [-1], np.int64)
        self.pair_rank = np.array([r for _, (r, _) in pairs] + [_NO_MERGE] * (1 + (not pairs)), np.int64)
        self.pair_piece = np.array([p for _, (_, p) in pairs] + [0] * (1 + (not pairs)), np.int64)
        #: The symbol of each code point.
        self.symbol_of = _OUTSIDE + np.arange(0x110000)
        for c, i in self.chars.items():
            self.symbol_of[ord(c)] = i
        self.symbol_of[ord(BLANK)] = _OUTSIDE + ord(BLANK)
        self.symbol_of[ord(" ")] = self.chars[BLANK]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols among the merges; their number for pairs that don't merge."""
        pair = left * (2 * _WIDE) + right
        at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == pair), at, len(self.pair_keys))

    def symbols(self, chunk: str) -> list[int]:
        """The chunk's characters as symbols; a blank sign that stands in the text itself isn't a blank."""
        return self.symbol_of[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)].tolist()

    def flat_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of rows of final symbols, and their new counts; characters without a piece become their UTF-8 bytes."""
        outside = symbols >= _OUTSIDE
        if not outside.any():
            return symbols.astype("<u4"), counts
        points = (symbols[outside] - _OUTSIDE).astype("<u4")
        many = np.ones(len(symbols), np.int64)
        many[outside] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        is_byte = np.repeat(outside, many)
        out = np.empty(len(is_byte), "<u4")
        out[~is_byte] = symbols[~outside]
        out[is_byte] = self.byte_ids[np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum(counts)]
        return out, np.diff(ends, prepend=0)

    def ids(self, symbols: Iterable[int]) -> np.ndarray:
        """Piece ids of one row of final symbols."""
        row = np.fromiter(symbols, np.int64)
        return self.flat_ids(row, np.array([len(row)]))[0]


@functools.cache
def pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def _skipped(key, start, middle, end, rate: float):
    """Whether the candidate merge of [start, middle) and [middle, end) is dropped."""
    place = np.asarray(start, U64) << U64(42) | np.asarray(middle, U64) << U64(21) | np.asarray(end, U64)
    draw = mix(np.asarray(key, U64) ^ mix(place))
    return draw < U64(int(rate * 2.0**64)) if rate < 1 else np.ones(draw.shape, bool)


def encode_by_agenda(vocabulary: Pieces, chunk: str, rate: float, key: int) -> np.ndarray:
    """One chunk of any length, with a heap as the agenda."""
    symbol = vocabulary.symbols(chunk)
    n = len(symbol)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    agenda: list[tuple[int, int, int, int]] = []

    def propose(left: int) -> None:
        if left < 0 or after[left] >= n:
            return
        right = after[left]
        merge = vocabulary.merges.get((symbol[left], symbol[right]))
        if merge and not _skipped(np.array([key], U64), [left], [right], [end[right]], rate)[0]:
            heapq.heappush(agenda, (merge[0], left, right, end[right]))

    for left in range(n - 1):
        propose(left)
    while agenda:
        _, left, right, stop = heapq.heappop(agenda)
        if not (alive[left] and alive[right] and after[left] == right and end[right] == stop):
            continue
        symbol[left] = vocabulary.merges[symbol[left], symbol[right]][1]
        alive[right] = False
        end[left], after[left] = stop, after[right]
        if after[left] < n:
            before[after[left]] = left
        propose(before[left])
        propose(left)
    return vocabulary.ids([s for s, ok in zip(symbol, alive) if ok])


def encode_together(vocabulary: Pieces, chunks: list[str], rate: float, key: np.ndarray, taken: list | None = None) -> list[bytes]:
    """Ids of many short chunks, as bytes: in each round every chunk merges its best candidate.

    ``taken`` gets (rows, places) of the merges of each round.
    """
    if not chunks:
        return []
    n = len(chunks)
    size = np.fromiter(map(len, chunks), np.int64, n)
    width = int(size.max())
    # A symbol stands where its first character stood; two more columns without symbols end each row.
    ids = np.full((n, width + 2), -1, np.int64)
    ids[np.arange(width + 2) < size[:, None]] = vocabulary.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
    after = np.tile(np.minimum(np.arange(1, width + 3), width + 1), (n, 1))
    before = np.tile(np.arange(-1, width + 1), (n, 1))
    rank = vocabulary.pair_rank

    def slots(left, right, k, start, middle, end):
        found = vocabulary.find(left, right)
        return np.where(_skipped(k, start, middle, end, rate), len(rank) - 1, found) if rate > 0 else found

    place = np.arange(width)
    slot = slots(ids[:, :width], ids[:, 1 : width + 1], key[:, None], place, place + 1, place + 2)
    score = rank[slot]
    live = np.arange(n)
    while True:
        left = (some := score[live]).argmin(axis=1)
        go = some[np.arange(len(live)), left] != _NO_MERGE
        live, left = live[go], left[go]
        if not len(live):
            break
        right = after[live, left]
        end = after[live, right]
        if taken is not None:
            taken.append((live, left << 42 | right << 21 | end))
        ids[live, left], ids[live, right] = vocabulary.pair_piece[slot[live, left]], -1
        after[live, left], before[live, end] = end, left
        score[live, right] = _NO_MERGE
        first = before[live, left]
        prior = first >= 0
        for row, one, two, stop in ((live, left, end, after[live, end]), (live[prior], first[prior], left[prior], end[prior])):
            slot[row, one] = found = slots(ids[row, one], ids[row, two], key[row], one, two, stop)
            score[row, one] = rank[found]
    inside = ids >= 0
    flat, count = vocabulary.flat_ids(ids[inside], inside.sum(axis=1))
    raw, stops = flat.tobytes(), (4 * np.cumsum(count)).tolist()
    return [raw[a:b] for a, b in zip([0, *stops], stops)]


def decoded(vocabulary: Pieces, ids: bytes) -> str:
    """The text: pieces joined as bytes, without the blank that stands before every text."""
    table = vocabulary.bytes
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()[1:]


def occurrence_keys(doc_id: int | None, text: str, n: int, seed: int) -> np.ndarray:
    """The keys of the text's ``n`` chunks, by their places."""
    key = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(str(doc_id), seed))
    return mix(np.arange(n, dtype=U64) ^ mix(np.array([key], U64)))


_ALL = (1 << 64) - 1


def _mix(x: int) -> int:
    """``mix`` of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _encode_keyed(vocabulary: Pieces, chunk: str, key: int, rate: float) -> bytes:
    """What ``encode_by_agenda`` gives, in plain numbers: a merge's draw is made when it is the best one left."""
    limit = int(rate * 2.0**64)
    symbol = vocabulary.symbols(chunk)
    n = len(symbol)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, get = [True] * n, vocabulary.merges.get
    agenda: list[tuple[int, int, int, int, int]] = []
    fresh = range(n - 1)
    while True:
        for left in fresh:
            if left < 0 or after[left] >= n:
                continue
            right = after[left]
            merge = get((symbol[left], symbol[right]))
            if merge:
                heapq.heappush(agenda, (merge[0], left, right, end[right], merge[1]))
        fresh = ()
        if not agenda:
            return vocabulary.ids([s for s, ok in zip(symbol, alive) if ok]).tobytes()
        _, left, right, stop, piece = heapq.heappop(agenda)
        if not (alive[left] and alive[right] and after[left] == right and end[right] == stop):
            continue
        if _mix(key ^ _mix(left << 42 | right << 21 | stop)) < limit:
            continue
        symbol[left] = piece
        alive[right] = False
        end[left], after[left] = stop, after[right]
        if after[left] < n:
            before[after[left]] = left
        fresh = (before[left], left)


class OccurrenceEncoder:
    """Encodes texts with draws of their own for each occurrence of a chunk.

    What is remembered depends on no draw: of at most about ``max_chunks`` chunks the ids without dropout
    and the places of the merges that lead to them. An occurrence that drops none of these has those
    ids, for the best candidate left is the same one each time; the others are encoded one by one.
    """

    _SLICE = 1 << 15

    def __init__(self, model_path: str, seed: int, rate: float, max_chunks: int = 150_000):
        self.vocabulary, self.seed, self.rate, self.max_chunks = pieces(model_path), seed, rate, max_chunks
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.start, self.mixed = np.zeros(1, np.int64), np.empty(0, U64)  # of each chunk's merges

    def _remember(self, chunks: list[str]) -> None:
        chunks = sorted(chunks, key=len)
        counts, mixed = [], []
        for k in range(0, len(chunks), 4096):
            some, taken = chunks[k : k + 4096], []
            self.ids += encode_together(self.vocabulary, some, 0.0, np.zeros(len(some), U64), taken)
            row, place = (np.concatenate([t[i] for t in taken] or [[]]).astype(kind) for i, kind in ((0, np.int64), (1, U64)))
            mixed.append(mix(place[np.argsort(row, kind="stable")]))
            counts.append(np.bincount(row, minlength=len(some)))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(counts))])
        self.mixed = np.concatenate([self.mixed, *mixed])

    def _forget(self, chunks: list[str]) -> None:
        """Drop the chunks that were remembered last."""
        for c in chunks:
            del self.known[c]
        n = len(self.known)
        del self.ids[n:]
        self.start = self.start[: n + 1]
        self.mixed = self.mixed[: self.start[-1]]

    def _dropping(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which occurrences drop a merge of the way without dropout."""
        n = self.start[node + 1] - self.start[node]
        row = np.repeat(np.arange(len(node)), n)
        at = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(len(row))
        hit = mix(key[row] ^ self.mixed[at]) < U64(int(self.rate * 2.0**64)) if self.rate < 1 else np.ones(len(row), bool)
        return np.bincount(row[hit], minlength=len(node)) > 0

    def encode(self, texts: list[str], doc_ids: list[int | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        out, some, size = [], [], 0
        for text, doc_id in zip(texts, doc_ids):
            chunks = _chunks(text)
            some.append((chunks, occurrence_keys(doc_id, text, len(chunks), self.seed)))
            size += len(chunks)
            if size >= self._SLICE:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some) if some else out

    def _encode(self, rows: list[tuple[list[str], np.ndarray]]) -> list[bytes]:
        chunks = [c for row, _ in rows for c in row]
        keys = np.concatenate([k for _, k in rows])
        node = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        lost = np.flatnonzero(node < 0).tolist()
        new = list({c for k in lost if len(c := chunks[k]) <= LONG})
        if new:
            self._remember(new)
        node[lost] = [self.known.get(chunks[k], -1) for k in lost]
        short, long = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        got = list(map(self.ids.__getitem__, node.tolist())) if len(short) else [b""] * len(chunks)
        hit = [np.zeros(0, bool)]
        for a in range(0, len(short), self._SLICE):
            part = short[a : a + self._SLICE]
            hit.append(self._dropping(node[part], keys[part]))
        again = short[np.concatenate(hit)]
        again = again[np.argsort([len(chunks[k]) for k in again.tolist()], kind="stable")]
        for a in range(0, len(again), 4096):
            part = again[a : a + 4096]
            some = [chunks[k] for k in part.tolist()]
            for k, ids in zip(part.tolist(), encode_together(self.vocabulary, some, self.rate, keys[part])):
                got[k] = ids
        for k in long.tolist():
            got[k] = _encode_keyed(self.vocabulary, chunks[k], int(keys[k]), self.rate)
        out, a = [], 0
        for row, _ in rows:
            out.append(b"".join(got[a : a + len(row)]))
            a += len(row)
        if len(self.known) > self.max_chunks:
            self._forget(new)
        return out

    def decode(self, ids: bytes) -> str:
        return decoded(self.vocabulary, ids)


def _chunks(text: str) -> list[str]:
    """The text after its leading blank, cut before each run of blanks."""
    if not text:
        return []
    text = " " + text
    if "  " in text or text.endswith(" "):
        return _CUT.split(text)[(1 if text[0] == " " else 0) :] if _CUT.match(text) else _CUT.split(text)
    return [" " + x for x in text[1:].split(" ")]


def encode_decode(docs: DataFrame, model_path: str, seed: int = 1, rate: float = 0.1, with_ids: bool = False, max_chunks: int = 150_000) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, text_crc32 of the decoded text, lossless; with ``with_ids`` also ids.

    Each occurrence of a word in each document has draws of its own. lossless says whether decoding gave the text back. A task remembers
    about ``max_chunks`` chunks, which changes its memory and time, never its results.

    Defined cases: a null or empty text has no pieces and decodes to an empty one (lossless); texts of
    blanks only, line ends, characters without a piece and the blank sign itself come back as they
    were; null ids count as one id; rows with equal ids and texts are cut alike; an empty table gives no rows;
    other columns are ignored.
    """
    types = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "text_crc32": pa.int64(), "lossless": pa.bool_()}
    types |= {"ids": pa.list_(pa.int32())} if with_ids else {}
    fields = "n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean" + ", ids array<int>" * with_ids

    @F.arrow_udf(fields)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = OccurrenceEncoder(model_path, seed, rate, max_chunks)  # what it remembers goes with the task
        for doc_ids, texts in batches:
            parts = [pa.array([], pa.struct(list(types.items())))]
            for k in range(0, len(texts), 512):
                some = [t or "" for t in texts[k : k + 512].to_pylist()]
                done = encoder.encode(some, doc_ids[k : k + 512].to_pylist())
                back = [encoder.decode(x) for x in done]
                columns = [[len(x) // 4 for x in done], [zlib.crc32(x) for x in done], [zlib.crc32(t.encode()) for t in back], [a == b for a, b in zip(back, some)]]
                arrays = [pa.array(c, t) for c, t in zip(columns, types.values())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(columns[0])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(done), "<u4").astype(np.int32))))
                parts.append(pa.StructArray.from_arrays(arrays, list(types)))
            yield pa.concat_arrays(parts)
        del encoder
        give_back()

    return docs.select("doc_id", run(F.col("doc_id").cast("long"), F.col("text")).alias("x")).select("doc_id", "x.*")
