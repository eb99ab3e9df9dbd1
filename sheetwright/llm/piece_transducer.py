"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Compiled once from a model file into one table of arcs (state, character) -> state:

* normaliser: its map of blank to U+2581 is composed with the pieces at once, so that each arc
  on U+2581 has a twin on the blank; a dummy U+2581 stands in front of each text;
* pieces: a trie from the initial state; where a piece ends, its id is written and the
  initial state entered again, now with that piece as history;
* byte fallback: a character that is no piece has an arc from the initial state that writes the bytes of its
  UTF-8 form: those that begin a piece on their own arc, all others on one arc that any of them takes.

Weights are in the tropical semiring (min, +). In a unigram model a piece weighs minus its score,
whatever its history. In a BPE model piece v after u weighs 1 if merging by the scores would leave
both as they are, else infinity; this is read from the compiled splits: undo the later merge
of the two pieces again and again, and see whether their inner neighbours would have merged
across the border before. A sequence of pieces is what BPE makes of a text just if each two
neighbours have finite weight, so each prefix has one history and the whole text one path.

A text is composed with the table arc by arc, in order of its characters, and each position
keeps the least weight and the arc that gave it. No piece crosses from other characters into
white space, or between classes of characters, so every path passes the positions between
them; the parts between such positions are solved one by one and remembered within a task.

A normaliser with a character map has arcs of its own: a trie of the map's keys over the bytes of a text, where the longest key at
each place writes its replacement, and a character that begins none writes itself. It is composed with the text before the
pieces are, as is one that collapses blanks (those at the ends go, several become one); such a text doesn't decode to itself.

Edge cases: null and empty texts encode to no ids; text of any characters decodes to
itself (to its mapped form, with a character map), but U+2581, which decodes to a blank, as in the library; each input row gives
one row; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Parts remembered in a task, newer and older ones, each at most; weights of pairs of pieces at most, after which these start anew.
MEMORY, PAIRS = 100_000, 300_000
UNKNOWN_WEIGHT, FAR = 1e6, float("inf")


def _runs(pieces) -> re.Pattern:
    """Pattern of the parts of a text that can be solved alone.

    Characters that stand side by side in a piece are of one class, as are those that
    further pieces link with them (in effect scripts, and punctuation). No piece
    crosses from one class into another, or from any character into white space.
    """
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for piece in pieces:
        bare = piece.lstrip(BLANK)
        for a, b in zip(bare, bare[1:], strict=False):
            root[top(a)] = top(b)
        if len(bare) > 1 and bare[0] == bare[-1]:
            top(bare[0])
    classes: dict[str, list[str]] = {}
    for c in root:
        classes.setdefault(top(c), []).append(c)
    sets = sorted(("".join(map(re.escape, sorted(x))) for x in classes.values()), key=lambda x: (-len(x), x))
    return re.compile(f"[{BLANK} ]*(?:{''.join(f'[{x}]+|' for x in sets)}[^{BLANK} ])|[{BLANK} ]+", re.DOTALL)


class CharacterMap:
    """The arcs of a compiled character map: (state, byte) -> state, and what is written where a key ends.

    The compiled form is the size of a double array, its units of 32 bits, and the replacements, each ended by a zero.
    A state is a place in the array; its arc on a byte is the unit at place ^ byte, if that bears the byte as its label, and
    leads to the unit's place ^ its offset. Where a key ends, a unit with bit 8 set, its replacement's place stands in the state.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
        self.label = (units & 0x800000FF).tolist()
        # Bit 9 says that the offset, from bit 10 on, counts in units of 256.
        self.offset = ((units >> 10) << np.where(units & 512, 8, 0)).tolist()
        self.ends = (units & 256 > 0).tolist()
        self.value = (units & 0x7FFFFFFF).tolist()
        self.texts = compiled[4 + size :]

    def apply(self, text: str) -> str:
        """The text with the longest key at each place replaced."""
        label, offset, ends = self.label, self.offset, self.ends
        data, out, at, n = text.encode(), [], 0, len(label)
        while at < len(data):
            state, to, end, value = offset[0] if n else n, at, at, None
            while to < len(data) and (arc := state ^ data[to]) < n and label[arc] == data[to]:
                state, to = arc ^ offset[arc], to + 1
                if ends[arc]:
                    end, value = to, state
            if value is None:
                lead = data[at]
                end = at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                out.append(data[at:end])
            else:
                begin = self.value[value]
                out.append(self.texts[begin : self.texts.index(0, begin)])
            at = end
        return b"".join(out).decode()


class PieceTransducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, kind = proto.normalizer_spec, proto.SentencePiece
        if not norm.escape_whitespaces:
            raise ValueError("only models that write white space as U+2581")
        if norm.precompiled_charsmap and any(p.type == kind.USER_DEFINED for p in proto.pieces):
            raise ValueError("pieces defined by a user aren't kept from a character map")
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with white space before words")
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.dummy, self.collapse = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        plain = {kind.NORMAL, kind.USER_DEFINED, kind.UNUSED}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in plain and p.type != kind.UNUSED}
        self.score = [p.score for p in proto.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN), 0)
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece has white space behind other characters")
        self.runs = _runs(self.ids)
        value = {i: b for b, i in self.byte.items()}
        silent = {i for i, p in enumerate(proto.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.output = [
            b"" if i in silent else bytes([value[i]]) if i in value else p.replace(BLANK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.pair: dict[int, float] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self._compile()

    def _compile(self) -> None:
        """The arc table, and for BPE each piece's rank and the two pieces that its last merge joined."""
        order = {x: k for k, x in enumerate(sorted({self.score[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: -1 if len(p) == 1 else order[self.score[i]] for p, i in self.ids.items()}
        self.split: dict[str, tuple[str, str]] = {}
        if self.bpe:
            whole = {p for p in self.ids if len(p) == 1} | {c for p in self.ids for c in p}
            for p in sorted((p for p in self.ids if len(p) > 1), key=lambda p: (self.rank[p], len(p))):
                for k in range(1, len(p)):
                    u, v = p[:k], p[k:]
                    if u in whole and v in whole and self._stand(u, v, self.rank[p]):
                        self.split[p] = u, v
                        whole.add(p)
                        break
        self.arcs: list[dict[str, int]] = [{}]
        self.writes: list[int] = [-1]
        for p, i in self.ids.items():
            if self.bpe and len(p) > 1 and p not in self.split:
                continue  # merging never makes it
            state = 0
            for c in p:
                if c not in self.arcs[state]:
                    self.writes.append(-1)
                    self.arcs.append({})
                    self.arcs[state][c] = len(self.writes) - 1
                    if c == BLANK:
                        self.arcs[state][" "] = len(self.writes) - 1
                state = self.arcs[state][c]
            self.writes[state] = i
        # Byte fallback: its arc's end for all other characters, and the same output where a character only begins pieces.
        self.bytes = len(self.pieces)
        self.score.append(-UNKNOWN_WEIGHT)
        self.rest = len(self.writes)
        self.writes.append(self.bytes)
        self.arcs.append({})
        for state in self.arcs[0].values():
            if self.writes[state] < 0:
                self.writes[state] = self.bytes
        none: dict[str, int] = {}
        self.arcs = [x or none for x in self.arcs]

    def _stand(self, u: str, v: str, limit: float = FAR) -> bool:
        """Whether no merge takes place across the border of neighbours u and v before ``limit``."""
        rank = self.rank
        while True:
            if rank.get(u + v, FAR) < limit:
                return False
            made_u, made_v = rank.get(u, -1), rank.get(v, -1)
            if made_u < 0 and made_v < 0:
                return True
            if made_u > made_v:
                limit, u = made_u, self.split[u][1]
            else:  # of equal merges the left one is the first, so one across the border goes before that of v
                limit, v = made_v + 1, self.split[v][0]

    def _after(self, u: int, v: int) -> float:
        """Weight of v after u in a BPE model; nothing merges with the bytes of a character that is no piece."""
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        stays = self.bytes in (u, v) or self._stand(self.pieces[u], self.pieces[v])
        w = self.pair[u << 32 | v] = 1.0 if stays else FAR
        return w

    def _written(self, v: int, text: str) -> tuple[int, ...]:
        """The output of an arc, in reverse."""
        if v < self.bytes:
            return (v,)
        return tuple(self.byte[b] for b in reversed(text.encode())) if self.byte else (self.unknown,)

    def _shortest(self, text: str) -> tuple[int, ...]:
        """What the shortest path over a part of the text writes."""
        n, arcs, writes, bpe, score, pair, rest = len(text), self.arcs, self.writes, self.bpe, self.score, self.pair, self.rest
        first = arcs[0]
        far, last, back = [0.0] + [FAR] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            state, j, here, u = first.get(text[i], rest), i + 1, far[i], last[i]
            while state is not None:
                v = writes[state]
                if v >= 0 and (not bpe or far[j] == FAR):  # a BPE prefix has one path: no other can be finite
                    if not bpe:
                        w = -score[v]
                    elif u < 0:
                        w = 1.0
                    else:
                        w = pair.get(u << 32 | v) or self._after(u, v)
                    w += here
                    if w < far[j]:
                        far[j], last[j], back[j] = w, v, i
                if j == n:
                    break
                state = arcs[state].get(text[j])
                j += 1
        out: list[int] = []
        while n:
            out += self._written(last[n], text[back[n] : n])
            n = back[n]
        return tuple(out[::-1])

    def parts(self, text: str) -> list[str]:
        """The text behind its dummy blank, cut where no piece crosses."""
        return self.runs.findall((BLANK if self.dummy else "") + text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.map:
            text = self.map.apply(text)
        if self.collapse:
            text = re.sub("  +", " ", text.lstrip(" ")).rstrip(f" {BLANK}")
            if not text:
                return []
        known, out = self.known, []
        for part in self.parts(text):
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part) or self._shortest(part)
                if len(part) <= 64:
                    if len(known) >= MEMORY:
                        self.older, known = known, {}
                        self.known = known
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        out = b"".join(map(self.output.__getitem__, ids))
        if self.dummy and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


_READY: dict[int, PieceTransducer] = {}


def _transducer(model: bytes) -> PieceTransducer:
    """The transducer of a model, compiled once in a Python worker."""
    key = hash(model)
    if key not in _READY:
        _READY.clear()
        _READY[key] = PieceTransducer(model)
    return _READY[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids array<int>, round_trip): round_trip is whether the ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                texts = some.column(1).to_pylist()
                ids = [np.array(t.encode(x), np.int32) for x in texts]
                same = [t.decode(i.tolist()) == (x or "").replace(BLANK, " ") for i, x in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), column, pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode_ids(rows: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(shared.value)
        for b in batches:
            text = [None if i is None else t.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
