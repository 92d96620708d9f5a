"""SentencePiece encoding and decoding: Viterbi over a double-array trie.

The pieces and log scores come from a public model file. A text gets a
leading space, spaces become the whitespace marker, and the segmentation with the
best sum of scores is found over a double-array trie of the pieces. No piece has
a marker after another character, so the best path of a text is that of
its units (a run of markers and the characters up to the next one): units are
segmented once, many at a time, and kept in a bounded cache per worker.

A character that is no piece costs the least score minus 10 and is written as
its UTF-8 bytes. So is a literal marker character, which makes decoding exact.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARKER = "▁"
UNIT = re.compile(" *[^ ]+| +")
UNKNOWN_PENALTY = 10.0
CACHE_UNITS = 400_000


class DoubleArray:
    """Double-array trie over bytes: the child of state ``s`` by byte ``c`` is
    ``base[s] + c`` if ``check`` there names ``s``."""

    def __init__(self, keys: dict[bytes, int]):
        children: dict[bytes, list[int]] = {b"": []}
        for key in sorted(keys):
            for n in range(len(key)):
                below = children.setdefault(key[:n], [])
                if not below or below[-1] != key[n]:
                    below.append(key[n])
            children.setdefault(key, [])
        size = 2 * len(children) + 4096
        self.base, self.check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.value = np.full(size, -1, dtype=np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        state, least = {b"": 0}, {}
        for prefix in sorted(children, key=len):
            s, labels = state.pop(prefix), children[prefix]
            if prefix in keys:
                self.value[s] = keys[prefix]
            if not labels:
                continue
            # nodes with as many children did not fit below this place before
            kind = min(len(labels), 8)
            base = least.get(kind, 1)
            while True:
                if base + 4096 > len(free):
                    grow = len(free)
                    free = np.concatenate([free, np.ones(grow, dtype=bool)])
                    for name, fill in (("base", 0), ("check", -1), ("value", -1)):
                        setattr(self, name, np.concatenate([getattr(self, name), np.full(grow, fill, dtype=np.int32)]))
                fits = np.logical_and.reduce([free[base + c:base + c + 2048] for c in labels])
                at = int(fits.argmax())
                if fits[at]:
                    base += at
                    break
                base += 2048
            least[kind] = base
            self.base[s] = base
            for c in labels:
                free[base + c] = False
                self.check[base + c] = s
                state[prefix + bytes([c])] = base + c

    def matches(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of every key at every position; ``room`` tells
        how many bytes follow a position in its unit. All positions step together."""
        at = np.arange(len(data))
        state = np.zeros(len(data), dtype=np.int64)
        found, length = [], 0
        while len(at):
            keep = room[at] > length
            at, state = at[keep], state[keep]
            to = self.base[state] + data[at + length].astype(np.int64)
            ok = self.check[to] == state
            at, state, length = at[ok], to[ok], length + 1
            value = self.value[state]
            hit = value >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), value[hit]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 3


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, and their trie."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], first: int = 0):
        self.score = np.array([s for _, s in pieces], dtype=np.float64)
        self.byte_ids = byte_ids
        special = set(byte_ids)
        usable = {p.encode(): i for i, (p, _) in enumerate(pieces) if i >= first and i not in special and p}
        self.trie = DoubleArray(usable)
        self.unknown = min(self.score[list(usable.values())], default=0.0) - UNKNOWN_PENALTY
        self.surface = [p.replace(MARKER, " ").encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        control = [i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)]
        pieces = [("" if i in control else m.id_to_piece(i), m.get_score(i)) for i in range(n)]
        return cls(pieces, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    # ------------------------------------------------------------- segmentation

    def segment(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of the best path of every unit. Of paths
        with equal scores the one whose last pieces are longest is taken."""
        raw = [u.replace(MARKER, "￿￿").replace(" ", MARKER).encode() for u in units]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        stops = np.cumsum(lengths)
        starts = stops - lengths
        first = np.repeat(starts, lengths)
        room = np.repeat(stops, lengths) - np.arange(len(data))
        at, size, piece = self.trie.matches(data, room)
        # characters that are no piece of their own
        lead = (data & 0xC0) != 0x80
        width = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        single = np.zeros(len(data), dtype=bool)
        single[at[size == width[at]]] = True
        lone = np.flatnonzero(lead & ~single)
        at = np.concatenate([at, lone])
        size = np.concatenate([size, width[lone]])
        score = np.concatenate([self.score[piece], np.full(len(lone), self.unknown)])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        # one node per byte position and one for the end of each unit
        shift = np.repeat(np.arange(len(units)), lengths)
        begin, end = at + shift[at], at + size + shift[at]
        order = np.lexsort((begin, end, at + size - first[at]))
        begin, end, score, piece = begin[order], end[order], score[order], piece[order]
        depth = (at + size - first[at])[order]
        best = np.zeros(len(data) + len(units))
        via = np.full(len(best), -1, dtype=np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]]) if len(depth) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            total = best[begin[lo:hi]] + score[lo:hi]
            node = end[lo:hi]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
            top = np.maximum.reduceat(total, heads)
            equal = np.flatnonzero(total == np.repeat(top, np.diff(np.concatenate([heads, [hi - lo]]))))
            winner = equal[np.searchsorted(equal, heads)]  # the first is the longest piece
            best[node[heads]], via[node[heads]] = top, lo + winner
        # all units are walked back together
        who = np.flatnonzero(lengths > 0)
        node, origin = stops[who] + who, starts + np.arange(len(units))
        steps = []
        while len(who):
            edge = via[node]
            steps.append((who, edge))
            node = begin[edge]
            going = node > origin[who]
            who, node = who[going], node[going]
        out: list[list[int]] = [[] for _ in units]
        for who, edge in reversed(steps):
            for u, e in zip(who.tolist(), edge.tolist()):
                if piece[e] >= 0:
                    out[u].append(int(piece[e]))
                else:
                    a = int(begin[e]) - u
                    out[u] += [self.byte_ids[b] for b in data[a:a + int(end[e] - begin[e])].tolist()]
        mark = [self.byte_ids[b] for b in MARKER.encode()]
        odd = [self.byte_ids[b] for b in "￿￿".encode()]
        result = []
        for u, ids in zip(units, out):
            if MARKER in u:  # literal markers travelled as two noncharacters
                ids = _replaced(ids, odd, mark)
            result.append(np.array(ids, dtype="<u4").tobytes())
        return result

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as bytes; the empty text has none."""
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        fresh = list({u for units in split for u in units if u not in self.cache})
        size = 0
        part: list[str] = []
        for u in fresh:
            part.append(u)
            size += len(u)
            if size > 1 << 19:
                self.cache.update(zip(part, self.segment(part)))
                part, size = [], 0
        if part:
            self.cache.update(zip(part, self.segment(part)))
        get = self.cache.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: markers become spaces, the leading one goes."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def _replaced(ids: list[int], old: list[int], new: list[int]) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if ids[i:i + len(old)] == old:
            out += new
            i += len(old)
        else:
            out.append(ids[i])
            i += 1
    return out


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, round_trip and, on demand, ids.

    ``model`` is the path of a SentencePiece model on every machine.
    ``round_trip`` tells whether decoding the ids gives back the text. Null and
    empty texts have no pieces (and do round-trip, null as the empty text). A null
    id stays null, rows that repeat are encoded each, an empty table gives no
    rows, other columns are not looked at.
    """
    path = model or public_model()
    schema = ("doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean"
              + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        is_byte = np.zeros(len(pieces.score), dtype=bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns: list[list] = [[] for _ in range(5)]
                for text, data in zip(texts, pieces.encode_batch(texts)):
                    ids = np.frombuffer(data, dtype="<u4")
                    row = (len(ids), int(is_byte[ids].sum()), zlib.crc32(data), pieces.decode(ids) == text,
                           ids.astype(np.int32))
                    for c, v in zip(columns, row):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                names = ["n_pieces", "n_byte_pieces", "ids_crc32", "round_trip", "ids"]
                n = 5 if with_ids else 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns[:n], types))],
                                                 ["doc_id", *names[:n]])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of a table of doc_id, ids (null ids: null text)."""
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in batches:
            texts = [None if ids is None else pieces.decode(np.array(ids, dtype=np.int64)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id bigint, text string")
