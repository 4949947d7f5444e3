"""SentencePiece BPE encoding with the place of every piece in the text, and decoding.

Encoding normalises by longest prefix: at each place the longest entry of the model's
compiled character map is replaced, and one character is kept where no entry fits. Every
byte written remembers the byte of the text it came from, so each piece is projected back
to the span of the text it covers. Merging then works on stretches that no piece of the
vocabulary can cross, and a worker remembers the pieces of stretches it has seen. Models
are read from a path the caller gives; none is trained here.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from presswork.llm.common import Memo, raw_texts
from presswork.llm.tokens import NEVER, pair_ranks, spread_pairs

# Fixed values of the model format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
UNKNOWN_SURFACE = " ⁇ "
BROKEN = "�"

_MEMO = 1 << 17
_STRETCH = 1 << 20
# Stretches up to this many characters are merged together in arrays, and remembered.
_SHORT = 48
_PIECE = np.dtype([("id", "<i4"), ("covers", "<i4")])


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: lambda: 8, 2: varint, 5: lambda: 4}[kind]()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings, and their replacements.

    The first four bytes give the size of the trie; its units follow, then the
    replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that begins at ``at``, and its replacement."""
        units, found = self.units, None
        node = self._child(units[0])
        for place in range(at, len(raw)):
            byte = raw[place]
            if byte == 0:
                break
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._child(unit)
            if unit & 0x100:
                found = place + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.texts[start : self.texts.index(b"\0", start)]


class Normalizer:
    """Normalisation as a model file states it, with the source of every byte."""

    def __init__(self, spec: bytes):
        fields = dict(proto_fields(spec))
        blob = fields.get(2, b"")
        self.map = CharacterMap(blob) if blob else None
        self.dummy_prefix = bool(fields.get(3, 1))
        self.remove_extra = bool(fields.get(4, 1))
        self.escape = bool(fields.get(5, 1))
        self.space = SPACE.encode() if self.escape else b" "

    @property
    def plain(self) -> bool:
        """Nothing but the prefix and the sign for spaces."""
        return self.map is None and not self.remove_extra and self.escape

    def _next(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Bytes consumed at ``at`` and what is written for them."""
        found = self.map.longest(raw, at) if self.map else None
        if found:
            return found
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, raw[at : at + size]

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 of valid UTF-8, and for each of its bytes (and its end) the
        place in ``raw`` that it came from."""
        at, end = 0, len(raw)
        if self.remove_extra:
            while at < end:
                size, made = self._next(raw, at)
                if made != b" ":
                    break
                at += size
        if at == end:
            return b"", np.zeros(1, np.int64)
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += self.space
            source += [at] * len(self.space)
        after_space = self.remove_extra
        while at < end:
            size, made = self._next(raw, at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                written = made.replace(b" ", self.space)
                out += written
                source += [at] * len(written)
                after_space = self.remove_extra and made.endswith(b" ")
            at += size
        if self.remove_extra:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), np.array([*source, at], np.int64)


class PieceModel:
    """A BPE model of the ``sentencepiece`` library with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(proto_fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer, denormalizer = {}, b"", {}
        for number, value in fields:
            if number == 1:
                piece = dict(proto_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(proto_fields(value))
            elif number == 3:
                normalizer = value
            elif number == 5:
                denormalizer = dict(proto_fields(value))
        plain = (
            trainer.get(3) == BPE_MODEL
            and trainer.get(35)  # byte fallback
            and not trainer.get(24)  # white space as a suffix
            and not {USER_DEFINED, UNUSED} & set(self.kinds)
            and not denormalizer.get(2)
        )
        if not plain:
            raise ValueError(f"{path} is not a plain BPE model with byte fallback")
        self.normalizer = Normalizer(normalizer)
        self.unknown = self.kinds.index(UNKNOWN)
        byte_ids = [i for i, kind in enumerate(self.kinds) if kind == BYTE]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in byte_ids}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.is_control = np.array([kind == CONTROL for kind in self.kinds])
        self.covers = np.array([len(p.encode()) for p in self.pieces])
        self.surface = [self._surface(i, trainer) for i in range(len(self.pieces))]
        self._cut()
        self._pair()
        self.memo = Memo(_MEMO, _SHORT)

    def _surface(self, i: int, trainer: dict) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([self.byte_of[i]])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return trainer.get(44, UNKNOWN_SURFACE.encode())
        return self.pieces[i].replace(SPACE, " ").encode()

    def _cut(self) -> None:
        """The pattern of stretches that no piece crosses.

        A character of no longer piece stands alone. If no piece has a space sign behind
        another character, stretches also end before space signs.
        """
        longer = [p for p in self.id_of if len(p) > 1]
        joined = "".join(sorted(set("".join(longer)) - {SPACE}))
        inner = any(a != SPACE and b == SPACE for p in longer for a, b in zip(p, p[1:]))
        some = f"[{re.escape(joined)}]" if joined else "(?!)"
        together = f"(?:{SPACE}|{some})+" if inner else f"{SPACE}*{some}+|{SPACE}+"
        self.stretch = re.compile(f"{together}|.", re.DOTALL)
        # Long texts are worked through in parts that begin at such a space.
        self.gap = None if inner else re.compile(f"(?<=[^ {SPACE}]) ")

    def _pair(self) -> None:
        """Lookup tables for merging in arrays: symbols are pieces and single characters."""
        single = sorted({c for p in self.id_of for c in p} - set(self.id_of))
        symbol = self.id_of | {c: len(self.pieces) + i for i, c in enumerate(single)}
        # The last symbol stands for every other character.
        self.n_symbols = len(self.pieces) + len(single) + 1
        self.symbol_of = np.full(0x110000, self.n_symbols - 1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        pairs = sorted(
            (-self.scores[i], symbol[p[:k]] * self.n_symbols + symbol[p[k:]], i)
            for p, i in self.id_of.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        )
        self.pair_keys, self.pair_ranks = spread_pairs(np.array([k for _, k, _ in pairs], np.int64))
        self.made = np.array([i for *_, i in pairs], np.int64)
        # Pairs of equal score have one level, so that the leftmost counts.
        score = np.array([s for s, *_ in pairs])
        level = np.cumsum(np.concatenate(([0], score[1:] != score[:-1])), dtype=np.int32)
        self.level = np.concatenate((level, [NEVER])).astype(np.int32)

    def _merge_short(self, stretches: list[str]) -> list[bytes]:
        """The pieces of many stretches at once: each round merges in every stretch its
        best-scored pair, of equally scored ones the leftmost."""
        flat = self.symbol_of[np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")]
        flat = flat.astype(np.int64)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        row = np.repeat(np.arange(len(stretches)), sizes)

        def ranks(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at places, none at the end of a stretch."""
            after = np.minimum(at + 1, len(flat) - 1)
            out = pair_ranks(self.pair_keys, self.pair_ranks, flat[at] * self.n_symbols + flat[after])
            out[(row[after] != row[at]) | (after == at)] = len(self.made)
            return np.minimum(out, len(self.made))

        rank = ranks(np.arange(len(flat)))
        done_rows, done_ids = [], []
        while len(flat):
            level = self.level[rank]
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            size = np.diff(np.concatenate((starts, [len(row)])))
            least = np.repeat(np.minimum.reduceat(level, starts), size)
            over = least == NEVER
            done_rows.append(row[over])
            done_ids.append(flat[over])
            hit = np.flatnonzero((level == least) & ~over)
            hit = hit[np.concatenate(([True], row[hit[1:]] != row[hit[:-1]]))] if len(hit) else hit
            flat[hit] = self.made[rank[hit]]
            stay = ~over
            stay[hit + 1] = False
            place = (np.cumsum(stay) - 1)[hit]
            flat, row, rank = flat[stay], row[stay], rank[stay]
            changed = np.concatenate((place, place[place > 0] - 1))
            rank[changed] = ranks(changed)
        rows, ids = np.concatenate(done_rows), np.concatenate(done_ids)
        order = np.argsort(rows, kind="stable")  # a stretch leaves whole, in its order
        rows, ids = rows[order], ids[order]
        packed = np.empty(len(ids), _PIECE)
        odd = set(rows[ids >= len(self.pieces)].tolist())
        ids = np.minimum(ids, len(self.pieces) - 1)
        packed["id"], packed["covers"] = ids, self.covers[ids]
        edges = np.searchsorted(rows, np.arange(len(stretches) + 1)) * _PIECE.itemsize
        buffer, edges = packed.tobytes(), edges.tolist()
        out = [buffer[a:b] for a, b in zip(edges, edges[1:])]
        for i in odd:  # characters without a piece of their own
            out[i] = self._packed(self._merge_long(stretches[i]))
        return out

    def _merge_long(self, stretch: str) -> list[str]:
        """The same merges for one long stretch, in order of a queue."""
        parts = list(stretch)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            whole = parts[left] + parts[right]
            i = self.id_of.get(whole)
            if i is not None:
                heapq.heappush(queue, (-self.scores[i], left, right, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, whole = heapq.heappop(queue)
            if not parts[left] or not parts[right] or parts[left] + parts[right] != whole:
                continue
            parts[left], parts[right] = whole, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p]

    def _packed(self, parts: list[str]) -> bytes:
        """(id, normalised bytes covered) of each piece. The bytes of a character outside
        the vocabulary are pieces of their own; the last of them covers it."""
        out = []
        for piece in parts:
            raw = piece.encode()
            i = self.id_of.get(piece)
            if i is not None:
                out.append((i, len(raw)))
            else:
                out += [(self.byte_id[b], 0) for b in raw[:-1]]
                out.append((self.byte_id[raw[-1]], len(raw)))
        return np.array(out, _PIECE).tobytes()

    def _made(self, stretches: list[str]) -> list[bytes]:
        """Pieces of each stretch, packed."""
        short = [s for s in stretches if len(s) <= _SHORT]
        made = dict(zip(short, self._merge_short(short))) if short else {}
        return [made.get(s) or self._packed(self._merge_long(s)) for s in stretches]

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids and bytes covered, as two columns, for each normalised text."""
        cut = [self.stretch.findall(text) for text in texts]
        wanted = set().union(*cut)
        memo = self.memo.fill(wanted, self._made)
        return [
            np.frombuffer(b"".join(map(memo.__getitem__, found)), "<i4").reshape(-1, 2)
            for found in cut
        ]

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.gap and len(text) - at > _STRETCH:
            gap = self.gap.search(text, at + _STRETCH)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        if at < len(text):
            yield text[at:]

    def _normal_parts(self, raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
        """Parts of the normalised text that can be cut alone, with the source of each byte
        of them and of their end."""
        text = raw.decode("utf-8", "replace")
        if not self.normalizer.plain:
            normal, source = self.normalizer.normalize(text.encode())
            yield normal.decode(), source
            return
        # Without a map each character stands for itself and a space for its sign, so the
        # sources follow from where the spaces are.
        at = 0
        for part in self._parts(text):
            own = np.frombuffer(part.encode(), np.uint8)
            prefix = SPACE if at == 0 and self.normalizer.dummy_prefix else ""
            starts = np.arange(at, at + len(own))
            width = np.where(own == 0x20, len(SPACE.encode()), 1)
            source = np.full(len(prefix.encode()) + int(width.sum()) + 1, at)
            source[len(prefix.encode()) : -1] = np.repeat(starts, width)
            source[-1] = at + len(own)
            yield prefix + part.replace(" ", SPACE), source
            at += len(own)

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces of a text, and the byte each begins and ends at in it."""
        return self.encode_all([raw])[0]

    def encode_all(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of many texts, whose new stretches are merged together.

        Texts are UTF-8; broken sequences are read as U+FFFD, and places then refer to the
        text with these.
        """
        ids: list[list[np.ndarray]] = [[] for _ in raws]
        edges = [[np.zeros(1, np.int32)] for _ in raws]
        waiting: list[tuple[int, str, np.ndarray]] = []
        held = 0

        def settle():
            nonlocal held
            for (i, _, source), found in zip(waiting, self._pieces([n for _, n, _ in waiting])):
                if not ids[i]:
                    edges[i] = [source[:1].astype(np.int32)]
                ids[i].append(found[:, 0])
                edges[i].append(source[np.cumsum(found[:, 1], dtype=np.int64)].astype(np.int32))
            waiting.clear()
            held = 0

        for i, raw in enumerate(raws):
            for normal, source in self._normal_parts(raw):
                waiting.append((i, normal, source))
                held += len(normal)
                if held > _STRETCH:
                    settle()
        settle()
        empty = np.zeros(0, np.int32)
        out = []
        for own, places in zip(ids, edges):
            joined = np.concatenate(places)
            out.append((np.concatenate(own) if own else empty, joined[:-1], joined[1:]))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids, as the library's decode gives it."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            raise ValueError("an id outside the vocabulary")
        listed = ids.tolist()
        made = list(map(self.surface.__getitem__, listed))
        if self.normalizer.dummy_prefix or self.normalizer.remove_extra:
            self._strip_first_space(listed, made)
        if not self.is_control[ids].any():  # else pieces may end a run of bytes unseen
            try:
                return b"".join(made).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_broken(listed, made)

    def _strip_first_space(self, ids: list[int], made: list[bytes]) -> None:
        """Drop the space that encoding put before the text (all, if extra ones go)."""
        for place, i in enumerate(ids):
            kind = self.kinds[i]
            if kind == CONTROL:
                continue
            if kind == NORMAL and made[place].startswith(b" "):
                made[place] = made[place][1:]
                if self.normalizer.remove_extra and not made[place]:
                    continue
            break

    def _decode_broken(self, ids: list[int], made: list[bytes]) -> str:
        """Runs of byte pieces character by character; what is none is U+FFFD per byte."""
        out, run = [], bytearray()

        def settle():
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(BROKEN)
                    size = 1
                at += size
            run.clear()

        for i, text in zip(ids, made):
            if self.kinds[i] == BYTE:
                run += text
            else:
                settle()
                out.append(text.decode())
        settle()
        return "".join(out)


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a path, read once in a worker."""
    return PieceModel(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def encode(
    docs: DataFrame, vocabulary: str, text: str = "text", keep_text: bool = True
) -> DataFrame:
    """``docs`` with ids, begins and ends added: the pieces of each whole text in order.

    Piece k covers the bytes begins[k] to ends[k] (exclusive) of the UTF-8 text; spans
    follow one another without gaps from 0 to its length. The sign put before the text
    belongs to the first piece and covers nothing by itself; of a character spelled in
    bytes the last byte covers it. Null and empty texts have empty arrays. Columns of these
    names in ``docs`` are replaced; repeated rows come out as often as they occur.
    ``keep_text=False`` leaves the text out. ``vocabulary`` is a path that every executor
    can read.
    """
    names = ["ids", "begins", "ends"]
    rest = docs.drop(*names)
    at = rest.columns.index(text)
    kept = [f for f in rest.schema.fields if keep_text or f.name != text]
    places = [rest.columns.index(f.name) for f in kept]

    def run(batches):
        pieces = model(vocabulary)
        for batch in batches:
            rows = pieces.encode_all([raw or b"" for raw in raw_texts(batch.column(at))])
            made = [_lists([r[k] for r in rows]) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(p) for p in places), *made], [*(f.name for f in kept), *names]
            )

    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]
    return rest.mapInArrow(run, T.StructType([*kept, *fields]))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids added as ``out`` (null ids: null).

    A null inside the ids counts as an unknown piece.
    """
    rest = encoded.drop(out)
    at = rest.columns.index(ids)

    def run(batches):
        pieces = model(vocabulary)
        for batch in batches:
            rows = batch.column(at)
            values = rows.values.fill_null(pieces.unknown).to_numpy()
            edges = rows.offsets.to_pylist()
            texts = [
                pieces.decode(values[a:b]) if there else None
                for a, b, there in zip(edges, edges[1:], rows.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out]
            )

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())]))
