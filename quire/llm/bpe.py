"""Byte-level BPE: merges compiled into a lazily determinised transducer, and streaming decoding.

The encoding of every prefix of a byte string ends in one token, and a token
may follow another exactly if merging the two together gives the two again.
So a transducer that reads bytes needs to know only the offsets from which a longer
token can still start within the last bytes, and of each the token that ends there.
A state is just that: per live offset its node in the trie of all tokens and the
token before it. Which offset a new token starts from and which offsets stay live
is a transition's output; the tokens themselves are kept in one register per
live offset, so texts with other tokens before share states. As soon as one offset is
left its tokens are emitted; the lookahead is bounded by the longest token. States and
transitions come into being when a text first needs them, as far as a bound on
their number allows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import list_column, map_batches, texts_of

#: Bounds of a process's tables. States beyond the first are made for one piece and forgotten.
STATE_LIMIT, FOLLOW_LIMIT, PIECE_LIMIT = 120_000, 400_000, 250_000
DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], before: int = 1 << 62) -> list[int]:
    """The tokens of a short byte string by the definition: the lowest pair first, those from ``before`` on not."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= before:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


#: Per live offset, from the first to the last: its node in the trie (0: the root), and the token that ends there (-1: none).
Key = tuple[tuple[int, int], ...]
#: The next state, the live offsets that stay (None: all), and the new token with the offset it starts from.
Step = tuple[dict, tuple[int, ...] | None, int, int]


class Transducer:
    """Encodes the pieces of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], states: int | None = None) -> None:
        self.ranks = ranks
        self.limit = STATE_LIMIT if states is None else states
        self.most_follows = min(FOLLOW_LIMIT, 5 * self.limit)
        self.bytes_of = {v: k for k, v in ranks.items()}
        #: The trie: node * 256 + byte -> node; and the token that ends at a node (-1: none).
        self.trie: dict[int, int] = {}
        self.token_at = [-1]
        self.inner = {0}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                at = node << 8 | byte
                if (child := self.trie.get(at)) is None:
                    child = self.trie[at] = len(self.token_at)
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[int, bool] = {}
        #: States by what they stand for: their transitions by byte, and at -1 their key.
        self.states: dict[Key, dict] = {}
        self.start = self.state(((0, -1),))

    def state(self, key: Key) -> dict:
        if (found := self.states.get(key)) is None:
            found = {-1: key}
            if len(self.states) < self.limit:
                self.states[key] = found
        return found

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or what no merge makes."""
        if token not in self.halves:
            b = self.bytes_of[token]
            parts = merged(b, self.ranks, token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging both together leaves ``left`` and ``right``.

        Merges are undone from the last to the first; the pair at the border
        must not have a merge that comes before the one just undone (of equal
        merges the left one comes first).
        """
        if len(self.bytes_of[right]) > 1 and self.split(right) is None:
            return False
        before, a, b = 1 << 62, left, right
        while left >= 0:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < before:
                return False
            halves_a, halves_b = self.split(a), self.split(b)
            if halves_a and (a > b or not halves_b):
                before, a = a, halves_a[1]
            elif halves_b:
                before, b = b + 1, halves_b[0]
            else:
                break
        return True

    def step(self, state: dict, byte: int) -> Step:
        """The transition of ``state`` on ``byte``; it is kept if both its states are."""
        live, kept, source, token = [], [], -1, -1
        for at, (node, last) in enumerate(state[-1]):
            if (child := self.trie.get(node << 8 | byte)) is None:
                continue
            if source < 0 and (found := self.token_at[child]) >= 0:
                key = (last + 1) << 24 | found
                if (fits := self.follows.get(key)) is None:
                    if len(self.follows) >= self.most_follows:
                        self.follows.clear()
                    fits = self.follows[key] = self.may_follow(last, found)
                if fits:
                    source, token = at, found
            if child in self.inner:
                kept.append(at)
                live.append((child, last))
        if source < 0:
            raise ValueError("the vocabulary lacks a byte or isn't made of merges")
        live.append((0, token))
        after = self.state(tuple(live))
        out = after, None if len(kept) == len(state[-1]) else tuple(kept), source, token
        if after[-1] in self.states and state[-1] in self.states:
            state[byte] = out
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        # A register is the last token and the register before it.
        state, registers = self.start, [None]
        for byte in piece:
            step = state.get(byte) or self.step(state, byte)
            state, kept, source, token = step
            new = (token, registers[source])
            if kept is None:
                registers.append(new)
            elif kept:
                registers = [registers[k] for k in kept]
                registers.append(new)
            else:
                self.emit(new, out)
                registers = [None]
        self.emit(registers[-1], out)
        return out

    @staticmethod
    def emit(register, out: list[int]) -> None:
        end = len(out)
        while register is not None:
            out.append(register[0])
            register = register[1]
        if len(out) - end > 1:
            out[end:] = out[:end - 1 if end else None:-1]


class Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit integers, filled on demand.

    Two generations: when the younger is full it becomes the elder, and pieces
    still in use come back from there.
    """

    def __init__(self, transducer: Transducer, limit: int) -> None:
        super().__init__()
        self.transducer, self.elder, self.limit = transducer, {}, limit

    def __missing__(self, piece: str) -> bytes:
        if (packed := self.elder.get(piece)) is None:
            ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.elder = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Utf8Stream:
    """Incremental UTF-8 decoding: a state machine over the bytes that a sequence still lacks.

    Bytes that can't be UTF-8 become U+FFFD as in Python's decoder.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """Bytes at the end that begin a sequence which isn't complete yet."""
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte >= 0xC0:
                need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data) if last else len(data) - self.open_tail(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def stream_decode(ids: Iterable[int], bytes_of: list[bytes]) -> Iterator[str]:
    """The text of ``ids``, token by token as soon as its characters are complete."""
    machine = Utf8Stream()
    for i in ids:
        if part := machine.feed(bytes_of[i]):
            yield part
    if part := machine.feed(b"", last=True):
        yield part


#: Tables of this process, kept from task to task unless released.
_encoders: dict[tuple, tuple[Pieces, regex.Pattern]] = {}
_decoders: dict[str, list[bytes]] = {}


def _encoder(path: str, pattern: str, states: int = STATE_LIMIT, pieces: int = PIECE_LIMIT) -> tuple[Pieces, regex.Pattern]:
    key = path, pattern, states, pieces
    if key not in _encoders:
        _encoders[key] = Pieces(Transducer(read_ranks(path), states), pieces), regex.compile(pattern)
    return _encoders[key]


def _release() -> None:
    _encoders.clear()


def _decoder(path: str) -> list[bytes]:
    if path not in _decoders:
        ranks = read_ranks(path)
        _decoders[path] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            _decoders[path][rank] = token
    return _decoders[path]


def _packed_ids(texts: list[str], pieces: Pieces, split: regex.Pattern) -> Iterator[bytes]:
    gc.disable()  # millions of small tuples without cycles
    try:
        for t in texts:
            yield b"".join(map(pieces.__getitem__, split.findall(t)))
    finally:
        gc.enable()


def _decoded(ids: list[int], bytes_of: list[bytes]) -> Iterator[tuple[bytes, str]]:
    """The bytes of ``ids`` and the text that is complete by then, part by part."""
    machine = Utf8Stream()
    for at in range(0, len(ids), 4096):
        data = b"".join(map(bytes_of.__getitem__, ids[at : at + 4096]))
        yield data, machine.feed(data)
    yield b"", machine.feed(b"", last=True)


def bpe_encode(
    docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN,
    text: str = "text", keep: tuple[str, ...] = ("doc_id",), packed: bool = False, states: int = STATE_LIMIT, cached: int = PIECE_LIMIT,
    release: bool = False,
) -> DataFrame:
    """``keep`` columns, ``n_tokens`` long and ``ids`` (array of int, or packed little-endian bytes).

    Each match of ``pattern`` is encoded by itself; text that it doesn't match is
    left out, as by the tokenizer itself. Null and empty texts have no ids. Rows
    are independent: repeated rows give repeated results, other columns are ignored,
    an empty table gives an empty one. A text needs memory in proportion to its length.
    ``states`` and ``cached`` (pieces) bound the tables of a process, not the results; with
    ``release`` they live for one task, so that the process has room for other work.
    """
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)
    kept = docs.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces, split = _encoder(path, pattern, states, cached)
        out = list(_packed_ids(texts_of(batch.column("_text")), pieces, split))
        counts = np.array([len(b) // 4 for b in out], np.int64)
        if packed:
            ids = pa.array(out, pa.binary())
        else:
            ids = list_column(np.frombuffer(b"".join(out), "<u4").astype(np.int32), np.concatenate(([0], np.cumsum(counts))), pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts), ids], names=[*keep, "n_tokens", "ids"])

    return map_batches(
        docs.select(*keep, docs[text].cast("string").alias("_text")), encode,
        f"{kinds}, n_tokens bigint, ids {'binary' if packed else 'array<int>'}", _release if release else None,
    )


def bpe_decode(encoded: DataFrame, ranks_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``: the text of ``ids`` (array of int or packed bytes; null: empty)."""
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)
    kept = encoded.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bytes_of = _decoder(path)
        out = []
        for ids in batch.column("_ids").to_pylist():
            ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids or ()
            out.append("".join(t for _, t in _decoded(ids, bytes_of)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "decoded"])

    return map_batches(encoded.select(*keep, encoded["ids"].alias("_ids")), decode, f"{kinds}, decoded string")


def bpe_digest(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``decoded_chars`` (code points) of every text.

    Encodes, decodes and digests in one pass, so that neither ids nor decoded texts
    leave the task; the hashes are those of the packed ids of ``bpe_encode`` and of the bytes
    they stand for. Null and empty texts, repeated rows and empty tables as there.
    """
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bytes_of, counts, ids_hash, text_hash, chars = _decoder(path), [], [], [], []
        for packed in _packed_ids(texts_of(batch.column("_text")), *_encoder(path, pattern)):
            counts.append(len(packed) // 4)
            ids_hash.append(hashlib.sha256(packed).hexdigest())
            seen, n = hashlib.sha256(), 0
            for data, part in _decoded(np.frombuffer(packed, "<u4").tolist(), bytes_of):
                seen.update(data)
                n += len(part)
            text_hash.append(seen.hexdigest())
            chars.append(n)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(chars, pa.int64())],
            names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"],
        )

    return map_batches(docs.select(*keep, docs[text].cast("string").alias("_text")), digest, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_chars bigint")
