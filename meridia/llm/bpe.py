"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

A sequence of tokens is the encoding of its bytes exactly if each neighbouring pair
is the encoding of that pair's bytes. So reading a piece byte by byte needs, as
hypotheses, only (trie node of the bytes since an earlier place, token that ends at that
place): a nondeterministic transducer, whose states are sets of hypotheses. Sets are built
when first met and kept. Every prefix has one encoding, so each move of the
deterministic machine says which token, if any, ends that encoding; tokens go out as soon
as all live hypotheses agree on them, which is no later than the longest token's bytes
on, and in a short piece at its end. Time is linear in the piece, however long.

The table of sets and that of whole pieces are bounded and begin anew when full.

Decoding streams token bytes through an incremental UTF-8 state machine, so that a
character split over tokens, or over chunks, comes out whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import give_back

MOST_STATES, MOST_PAIRS, MOST_PIECES, LONGEST_KEPT = 120_000, 300_000, 250_000, 64
#: Pieces up to so many bytes go out at their end; longer ones as they settle.
FLUSH = 4096


def read_ranks(lines) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Trie:
    """Children by node << 8 | byte, and of each node the token that it ends, if any, and
    whether it has children."""

    def __init__(self, ranks: dict[bytes, int]):
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                nxt = self.child.get(at << 8 | byte)
                if nxt is None:
                    nxt = self.child[at << 8 | byte] = len(self.token)
                    self.inner[at] = True
                    self.token.append(-1)
                    self.inner.append(False)
                at = nxt
            self.token[at] = rank


class Transducer:
    """Encodes pieces of text by ``ranks`` (bytes to id, which is also the merge order)."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, most_pairs: int = MOST_PAIRS):
        self.ranks, self.trie, self.most, self.most_pairs = ranks, Trie(ranks), most_states, most_pairs
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.length.values(), default=1)
        self.agree: dict[int, bool] = {}  # by a << 32 | b
        self.made: dict[int, tuple[int, int]] = {}
        self.whole: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # a hypothesis is node << 32 | token + 1; a state is a tuple of them; a move, by
        # state << 8 | byte, is the next state << 32 | token + 1
        self.states: dict[tuple, int] = {(0,): 0}
        self.sets: list[tuple] = [(0,)]
        self.moves: dict[int, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding by merging the pair of lowest rank, leftmost first: for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (token, token) if none do."""
        known = self.made.get(token)
        if known is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.made[token] = tuple(self.ranks[x] for x in parts) if len(parts) == 2 else (token, token)
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may follow a; a of -1 is the piece's start.

        The tokens at the border, seen back through the merges that made a and b (the
        later merge undone first), must never have been a pair that merges sooner."""
        if a < 0:
            known = self.whole.get(b)
            if known is None:
                known = self.whole[b] = self.merged(self.bytes_of[b]) == [b]
            return known
        known = self.agree.get(a << 32 | b)
        if known is not None:
            return known
        if len(self.agree) > self.most_pairs:
            self.agree.clear()
        x, y, until, known = a, b, 1 << 60, True
        ranks, text = self.ranks, self.bytes_of
        while True:
            rank = ranks.get(text[x] + text[y])
            if rank is not None and rank < until:
                known = False
                break
            left, right = self.halves(x)[1], self.halves(y)[0]
            # of the two, undo the merge that came later; a tie was made left to right
            if left != x and (x > y or right == y):
                until, x = x, left
            elif right != y:
                until, y = y + 1, right
            else:
                break
        self.agree[a << 32 | b] = known
        return known

    def _number(self, hypotheses: tuple) -> int:
        number = self.states.get(hypotheses)
        if number is None:
            number = self.states[hypotheses] = len(self.sets)
            self.sets.append(hypotheses)
        return number

    def _move(self, state: int, byte: int) -> int:
        """The next state << 32 | the token that ends the encoding there + 1 (0: none does)."""
        live, ended = [], -1
        child, tokens, inner, agree = self.trie.child, self.trie.token, self.trie.inner, self.agree
        for h in self.sets[state]:
            nxt = child.get(h >> 32 << 8 | byte)
            if nxt is None:
                continue
            if inner[nxt]:
                live.append(nxt << 32 | h & 0xFFFFFFFF)
            if ended < 0:
                token = tokens[nxt]
                if token >= 0:
                    last = (h & 0xFFFFFFFF) - 1
                    fits = agree.get(last << 32 | token) if last >= 0 else None
                    if fits or fits is None and self.follows(last, token):
                        ended = token
        if ended >= 0:
            live.append(ended + 1)
        move = self.moves[state << 8 | byte] = self._number(tuple(live)) << 32 | ended + 1
        return move

    def _back(self, ends: list[int], base: int, at: int) -> list[int]:
        """The tokens of the encoding up to place at, from base on, by the ends met."""
        out, lengths = [], self.length
        while at > base:
            token = ends[at - base - 1]
            if token < 0:
                raise ValueError("a byte that no token holds")
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.sets) > self.most:
            self._clear()
        if len(piece) > FLUSH:
            return [t for part in self.stream([piece]) for t in part]
        state, ends, known = 0, [], self.moves.get
        for byte in piece:
            move = known(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 32
            ends.append((move & 0xFFFFFFFF) - 1)
        return self._back(ends, 0, len(piece))

    def stream(self, parts) -> Iterator[list[int]]:
        """Encodes one piece that comes in parts, holding back FLUSH bytes at most."""
        state, ends, base = 0, [], 0
        for part in parts:
            for a in range(0, len(part), FLUSH):
                if len(self.sets) > self.most:  # keep the set at hand only
                    at = self.sets[state]
                    self._clear()
                    state = self._number(at)
                known = self.moves.get
                for byte in part[a : a + FLUSH]:
                    move = known(state << 8 | byte)
                    if move is None:
                        move = self._move(state, byte)
                    state = move >> 32
                    ends.append((move & 0xFFFFFFFF) - 1)
                # places where a live hypothesis begins; where their encodings meet is settled
                end = base + len(ends)
                live = {end} if ends[-1] >= 0 else set()
                live |= {x for x in range(max(base, end - self.longest), end) if x == base or ends[x - base - 1] >= 0}
                while len(live) > 1:
                    x = max(live)
                    live.discard(x)
                    live.add(x - self.length[ends[x - base - 1]])
                settled = live.pop()
                out = self._back(ends, base, settled)
                ends, base = ends[settled - base :], settled
                if out:
                    yield out
        yield self._back(ends, base, base + len(ends))


def _utf8_rows() -> list[bytes]:
    """The automaton of well-formed UTF-8: for each state and byte the next state. State 0
    stands between characters, 1 is broken, 2 to 4 await one to three more bytes, 5 to 8
    await bytes of which the next has a narrower range (after E0, ED, F0 and F4)."""
    rows = [bytearray([1] * 256) for _ in range(9)]
    rows[0][:0x80] = bytes(0x80)
    for lead, state in ((range(0xC2, 0xE0), 2), (range(0xE1, 0xF0), 3), ([0xE0], 5), ([0xED], 6), ([0xF0], 7), (range(0xF1, 0xF4), 4), ([0xF4], 8)):
        for byte in lead:
            rows[0][byte] = state
    for state, low, high, to in ((2, 0x80, 0xBF, 0), (3, 0x80, 0xBF, 2), (4, 0x80, 0xBF, 3), (5, 0xA0, 0xBF, 2), (6, 0x80, 0x9F, 2), (7, 0x90, 0xBF, 3), (8, 0x80, 0x8F, 3)):
        for byte in range(low, high + 1):
            rows[state][byte] = to
    return [bytes(r) for r in rows]


_UTF8 = _utf8_rows()


class Utf8Machine:
    """Incremental UTF-8 decoder. Its state after each piece is the automaton's, with the
    bytes of the character begun; what the automaton has accepted goes out at once. Broken
    bytes give U+FFFD and the automaton begins anew, as in bytes.decode."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        # a character has four bytes at most, so the state at the end comes from there on
        start = max(0, len(data) - 3)
        while start < len(data) and 0x80 <= data[start] < 0xC0:
            start += 1
        state = 0
        for at in range(start, len(data)):
            if state <= 1:
                begun = at
            state = _UTF8[state if state != 1 else 0][data[at]]
            if state == 1 and at > begun:  # the byte that broke it may begin the next
                begun, state = at, _UTF8[0][data[at]]
        cut = begun if state > 1 and not last else len(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it (no U+001C to U+001F)."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Codec:
    """Text to ids and back for one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = MOST_PIECES, room: float = 1.0):
        """room: part of the usual size of all tables."""
        self.machine = Transducer(ranks, int(MOST_STATES * room), int(MOST_PAIRS * room))
        self.split, self.most = split_pattern(pattern), int(most_pieces * room)
        self.vocabulary = [self.machine.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]
        self.pieces: dict[str, bytes] = {}

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, out = self.pieces, []
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.machine.encode(piece.encode()), "<u4").tobytes()
                if len(piece) <= LONGEST_KEPT:
                    if len(known) >= self.most:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_stream(self, chunks):
        """Strings from chunks of ids, cut anywhere."""
        utf8 = Utf8Machine()
        for ids in chunks:
            yield utf8.feed(b"".join([self.vocabulary[i] for i in ids]))
        yield utf8.feed(b"", last=True)


_CODECS: dict[tuple, Codec] = {}


def codec(name: str, pattern: str, room: float = 1.0) -> Codec:
    """This worker's codec for a file that was added to the session."""
    if (name, pattern, room) not in _CODECS:
        with open(SparkFiles.get(name), "rb") as lines:
            _CODECS[name, pattern, room] = Codec(read_ranks(lines), pattern, room=room)
    return _CODECS[name, pattern, room]


def ship(spark, path: str) -> str:
    """Sends a vocabulary file to all executors, also later ones; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


#: Ids that are decoded at a time, and bytes of text whose results are handed on together.
CHUNK, PART = 1 << 15, 1 << 22


def parts(batches) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about PART bytes of text, one row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + PART, side="right")))
            yield b.slice(at, end - at)
            at = end


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, room: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids (packed), ids_sha256, decoded_sha256. A null text is empty;
    repeated rows each get their own; other columns are left alone. With less ``room`` the
    tables are smaller and begin anew more often; the result is the same."""
    name = ship(docs.sparkSession, ranks_path)

    def run(batches):
        # what the worker's earlier tasks have freed goes back before the tables grow
        give_back()
        c = codec(name, pattern, room)
        for b in parts(batches):
            n, packed, sha, back = [], [], [], []
            for x in b.column("text"):
                ids = c.encode_packed(x.as_py() or "")
                digest, utf8 = hashlib.sha256(), Utf8Machine()
                numbers = np.frombuffer(ids, "<u4")
                for at in range(0, len(numbers), CHUNK):
                    digest.update(utf8.feed(b"".join(map(c.vocabulary.__getitem__, numbers[at : at + CHUNK].tolist()))).encode())
                digest.update(utf8.feed(b"", last=True).encode())
                n.append(len(numbers))
                packed.append(ids)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(digest.hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.large_binary()).cast(pa.binary()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
