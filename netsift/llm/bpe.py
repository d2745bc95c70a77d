"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours encode to themselves
when they stand alone side by side, and every token does. So the merges compile into a nondeterministic transducer: it
reads bytes along the token trie, and may end a token wherever the pair of this token and the last one is valid. Its
subsets of live hypotheses are built when a text first needs them and kept as states of a deterministic transducer.
A hypothesis dies when its bytes leave the trie, so the live ones agree on all but the last bytes: tokens are given out
after a bounded look ahead, at the end of a piece or where all live hypotheses agree.

The deterministic transducer is one array of next states, so the pieces of many texts go through it together, a byte of
each at a time; tokens are read off backwards from all ends of pieces together as well. Only new states are made one by
one, and very long pieces are read one by one with the look ahead.

Decoding. Token bytes go through an incremental UTF-8 state machine that holds back at most three bytes of an
unfinished character; broken sequences become U+FFFD.

Rows: a null text is an empty one (no tokens); the pieces of very long texts come in portions, which only bounds memory;
repeated rows repeat their result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import column, leave

_STATES = 200_000  # states of a task (512 bytes each, or 1 KB), after which it begins anew; more than the bytes of a piece that is not long
_PAIRS = 300_000  # remembered pairs of tokens
_LOOK = 1024  # characters after which a piece is long, and bytes of it after which agreed tokens are given out
_PORTION = 1 << 20  # characters that go through the transducer together, or a little more
_PORTION_PIECES = 200_000  # pieces of a longer text that are found at a time
_NEVER = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class _Full(Exception):
    """There is no room for another state."""


class Transducer:
    """A hypothesis is a place where a token may have ended: the token that ended there, and the trie node of what was read since.

    The state is the set of places that are still on the trie; it also has the length of the one token that a correct
    encoding of everything read so far ends with, so tokens are read off backwards from any place that all live
    hypotheses share. States that would go beyond a fixed number are not kept, so a worker's memory is bounded.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict[bytes, list[bytes]], dict[bytes, list[bytes]]] = ({}, {})
        self._pairs: dict[tuple[int, int], bool] = {}
        self._children: list[dict[int, int]] = [{}]  # the trie: node 0 is its root
        self._token: list[int | None] = [None]
        self._depth = [0]
        self.unmade = {}  # tokens that no merge makes: only a piece that is one gives its id
        for token in ranks:
            if len(token) == 1 or self.parts(token):
                node = 0
                for byte in token:
                    child = self._children[node].get(byte)
                    if child is None:
                        child = self._children[node][byte] = len(self._children)
                        self._children.append({})
                        self._token.append(None)
                        self._depth.append(self._depth[node] + 1)
                    node = child
                self._token[node] = ranks[token]
            else:
                self.unmade[token] = ranks[token]
        self._column = np.full(256, -1, np.int16)  # of the bytes that have come up; others need no room in the table
        self._byte: list[int] = []
        self._bits = 7
        self._reset()

    def _reset(self) -> None:
        self._next = np.zeros(_STATES << self._bits, np.int32)  # state and column -> next state, 0 if not made yet
        self._size, self._id = np.zeros(_STATES, np.int32), np.zeros(_STATES, np.int32)  # of the token that ends here
        self._live: list[tuple[int, ...]] = []  # a hypothesis is one number: the token (-1: none) times the nodes, plus the node
        self._states: dict[tuple[int, ...], int] = {}
        self._number((-len(self._children),), -1)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        for byte in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self._column < 0)).tolist():
            self._column[byte] = len(self._byte)
            self._byte.append(byte)
            if len(self._byte) == 129:
                self._bits = 8
                self._reset()
        return self._column[data]

    def _number(self, live: tuple[int, ...], end: int) -> int:
        known = self._states.get(live)
        if known is None:
            known = len(self._live)
            if known == _STATES:
                raise _Full
            self._states[live] = known
            self._live.append(live)
            self._size[known], self._id[known] = len(self._bytes.get(end, b"")), end
        return known

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None if merges never make it."""
        if token in self._parts:
            return self._parts[token]
        top, parts = self.ranks[token], [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
            if rank >= top:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self._parts[token] = made = (parts[0], parts[1]) if len(parts) == 2 and all(p in self.ranks for p in parts) else None
        return made

    def _edge(self, token: bytes, side: int) -> list[bytes]:
        """What stands at the token's left (0) or right (1) end while it is merged, first the single byte."""
        known = self._edges[side].get(token)
        if known is None:
            known = [token] if len(token) == 1 else [*self._edge(self.parts(token)[side], side), token]
            self._edges[side][token] = known
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether a and b side by side stay these two tokens: no merge across their border ever has its turn."""
        rank, left, right = self.ranks, self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            across = rank.get(left[i] + right[j], _NEVER)
            grow_left = rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            grow_right = rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            if across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == _NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _pair(self, a: int, b: int) -> bool:
        if len(self._pairs) >= _PAIRS:
            self._pairs.clear()
        self._pairs[a, b] = known = self.fits(self._bytes[a], self._bytes[b])
        return known

    def _step(self, state: int, column: int) -> int:
        live, end, children, token, pairs, byte = [], None, self._children, self._token, self._pairs, self._byte[column]
        nodes = len(children)
        for hypothesis in self._live[state]:
            last, node = divmod(hypothesis, nodes)
            below = children[node].get(byte)
            if below is None:
                continue
            if children[below]:
                live.append(hypothesis - node + below)
            if end is None and (own := token[below]) is not None:
                if last < 0 or ((fits := pairs.get((last, own))) is None and self._pair(last, own)) or fits:
                    end = own
        if end is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append(end * nodes)
        self._next[state << self._bits | column] = known = self._number(tuple(live), end)
        return known

    def encode_together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces of ``data`` (none is empty), and the offsets at which the tokens end."""
        ids, ends, columns = np.empty(len(data), np.int32), np.zeros(len(data), bool), self._columns(data)
        waiting = [(starts, sizes)] if len(starts) else []
        while waiting:
            starts, sizes = waiting.pop()
            try:
                self._read_together(columns, starts, sizes, ids, ends)
            except _Full:  # a new table has room for a state per byte of these pieces, or of some of them
                self._reset()
                half = len(starts) // 2 if sizes.sum() >= _STATES else 0
                waiting += [(starts[half:], sizes[half:])] + ([(starts[:half], sizes[:half])] if half else [])
        at = np.flatnonzero(ends)
        return ids[at], at + 1

    def _read_together(self, columns: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")  # so those that are not at their end are always the first ones
        starts, sizes = starts[order], sizes[order]
        path = np.empty(len(columns), np.int32)
        state = np.zeros(len(starts), np.int32)
        for k, n in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]))):
            at = starts[:n] + k
            step = (state[:n] << self._bits) + columns[at]
            state = self._next[step]
            if not state.all():
                for new in np.unique(step[state == 0]).tolist():
                    self._step(new >> self._bits, new & (1 << self._bits) - 1)
                state = self._next[step]
            path[at] = state
        at, first = starts + sizes - 1, starts
        while len(at):
            state = path[at]
            ends[at] = True
            ids[at] = self._id[state]
            at = at - self._size[state]
            more = at >= first
            at, first = at[more], first[more]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        columns = self._columns(np.frombuffer(piece, np.uint8)).tolist()
        state, path, out = 0, [], []  # the path: size and id of the token that ends at each place
        for at in range(0, len(piece), _LOOK):
            if len(self._live) + _LOOK >= _STATES:
                live, end = self._live[state], self._id.item(state)
                self._reset()
                state = self._number(live, end)
            for column in columns[at : at + _LOOK]:
                state = self._next.item(state << self._bits | column) or self._step(state, column)
                path.append((self._size.item(state), self._id.item(state)))
            if at + _LOOK < len(piece):
                done = self._agreed(path, state)
                out += self._read(path, done)
                del path[:done]
        return out + self._read(path, len(path))

    def _agreed(self, path: list[tuple[int, int]], state: int) -> int:
        """The last place that the encodings of all live hypotheses go through."""
        shared = None
        for hypothesis in self._live[state]:
            at, places = len(path) - self._depth[hypothesis % len(self._depth)], set()
            while at > 0:
                places.add(at)
                at -= path[at - 1][0]
            shared = places if shared is None else shared & places
        return max(shared, default=0)

    @staticmethod
    def _read(path: list[tuple[int, int]], end: int) -> list[int]:
        out = []
        while end > 0:
            size, id = path[end - 1]
            out.append(id)
            end -= size
        out.reverse()
        return out


class Codec:
    """Encodes texts with one vocabulary and pattern, the pieces of many texts together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._alone = sorted({len(token.decode("utf-8", "surrogatepass")) for token in self.transducer.unmade})
        most = max(self.bytes_of, default=-1) + 1
        self.tokens = pa.array([self.bytes_of.get(k, b"") for k in range(most)], pa.binary())
        self.digits = pa.array([b",%d" % k for k in range(most)], pa.binary())

    def _portions(self, text: str) -> Iterator[list[str]]:
        if len(text) <= _PORTION:
            yield self.pieces.findall(text)
            return
        found = (match.group() for match in self.pieces.finditer(text))
        while portion := list(islice(found, _PORTION_PIECES)):
            yield portion

    def groups(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of texts, the token ids of all of them and the offsets where each one's begin; a long text comes several times."""
        rows, pieces, ends, chars = [], [], [0], 0
        for row, text in enumerate(texts):
            for portion in self._portions(text or ""):
                rows.append(row)
                pieces += portion
                ends.append(len(pieces))
                chars += min(len(text or ""), _PORTION)
                if chars >= _PORTION:
                    yield rows, *self._encode_pieces(pieces, ends)
                    rows, pieces, ends, chars = [], [], [0], 0
        if rows:
            yield rows, *self._encode_pieces(pieces, ends)

    def _encode_pieces(self, pieces: list[str], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, and how many there are before each of the marks, which are numbers of pieces."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        apart = {}
        for k in np.flatnonzero((sizes > _LOOK) | np.isin(sizes, self._alone)).tolist():
            piece = pieces[k].encode("utf-8", "surrogatepass")
            if sizes[k] > _LOOK or piece in self.transducer.unmade:
                apart[k], pieces[k], sizes[k] = self.transducer.encode_piece(piece), "", 0
        data = np.frombuffer("".join(pieces).encode("utf-8", "surrogatepass"), np.uint8)
        stops = np.concatenate(([0], np.cumsum(sizes)))
        if len(data) > stops[-1]:
            stops = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[stops]
        sizes = np.diff(stops)
        filled = np.flatnonzero(sizes)
        ids, ends = self.transducer.encode_together(data, stops[filled], sizes[filled])
        counts = np.searchsorted(ends, stops[marks], "right")
        if apart:
            at = np.searchsorted(ends, stops[list(apart)], "right")
            ids = np.insert(ids, np.repeat(at, [len(own) for own in apart.values()]), [k for own in apart.values() for k in own])
            more = np.concatenate(([0], np.cumsum([len(own) for own in apart.values()])))
            counts += more[np.searchsorted(list(apart), marks)]
        return ids, counts

    def encode(self, text: str | None) -> list[int]:
        return [k for _, ids, _ in self.groups([text]) for k in ids.tolist()]


class StreamDecoder:
    """Turns ids that come in any portions into text; gives out whole characters only."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self._bytes_of = bytes_of
        self._open = b""

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(b"".join(map(self._bytes_of.__getitem__, ids)))

    def feed_bytes(self, data: bytes) -> str:
        """The same for the bytes of the ids."""
        data = self._open + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:  # a lead byte: does it wait for more than stands there?
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if needs > back:
                    cut -= back
                break
        self._open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self._open = self._open, b""
        return rest.decode("utf-8", "replace")


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(raw), pattern)
        leave(_codecs.clear)
    return _codecs[key]


def _joined(words: pa.Array, ids: np.ndarray, begins: np.ndarray) -> tuple[memoryview, list[int]]:
    """The words of all ids, one after the other, and where those of each text begin."""
    taken = words.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :]
    return memoryview(taken.buffers()[2] or b""), at[begins].tolist()


def encode(spark: SparkSession, documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array) and the text decoded from them; ``vocabulary`` is the path of a rank file on the driver."""
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # as large as the file, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [[] for _ in range(part.num_rows)]
                for rows, own, begins in codec.groups(column(part, "text")):
                    for row, begin, end in zip(rows, begins.tolist(), begins[1:].tolist()):
                        ids[row] += own[begin:end].tolist()
                texts = []
                for own in ids:
                    decoder = StreamDecoder(codec.bytes_of)
                    texts.append(decoder.feed(own) + decoder.finish())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(spark: SparkSession, documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same work, but the ids stay in the task."""
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = [0] * part.num_rows
                told, back = [[hashlib.sha256() for _ in n] for _ in range(2)]
                decoders = [StreamDecoder(codec.bytes_of) for _ in n]
                for rows, ids, begins in codec.groups(column(part, "text")):
                    digits, digits_at = _joined(codec.digits, ids, begins)
                    tokens, tokens_at = _joined(codec.tokens, ids, begins)
                    for k, row in enumerate(rows):
                        comma = n[row] == 0  # the first number has none before it
                        n[row] += int(begins[k + 1] - begins[k])
                        told[row].update(digits[digits_at[k] + comma : digits_at[k + 1]])
                        back[row].update(decoders[row].feed_bytes(bytes(tokens[tokens_at[k] : tokens_at[k + 1]])).encode())
                for hashed, decoder in zip(back, decoders):
                    hashed.update(decoder.finish().encode())
                ids_hash, decoded_hash = ([hashed.hexdigest() for hashed in own] for own in (told, back))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
