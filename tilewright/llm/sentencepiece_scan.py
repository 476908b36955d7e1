"""SentencePiece encoding and decoding by a max-plus parallel scan.

A merge-based vocabulary has one encoding of a text, and a sequence of pieces is that encoding iff each two neighbours are
the encoding of their concatenation. So encoding is a longest-path problem: positions are states, pieces are edges, a
step onto a piece counts its ids, and a step between pieces that do not fit weighs minus infinity.

Every text is cut into chunks of ``CHUNK`` characters, one or many. A chunk is a matrix from the pieces that may cross its start
to those that may cross its end, holding the ids between. The matrices of a text are combined by the max-plus product, which
is associative: blocks of ``FAN`` neighbours are multiplied level by level up to one matrix of the text, and on the way down
each block hands its members the piece that enters and the piece that leaves them and the ids before. Then each chunk is
traced back for itself.

Paths within a chunk are followed by an automaton, whose state is all that the rest of a path depends on. No piece of the
vocabulary holds a word start after another character, or a letter beside anything that is no letter, so such places are cuts
that every path goes through. Between a chunk's first and last cut the path does not depend on its ends: it is followed once,
word by word, and only what lies before and after is followed for each entering piece and traced when that is known. A text's own ends are
cuts, so a text of one chunk is that middle alone, and its product has one factor.
"""

from __future__ import annotations

import functools
import re
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, per_worker, small_batches

VOCABULARY = "piece_bpe_32k.model"
#: Characters of a chunk, and neighbours that one product takes.
CHUNK, FAN = 1 << 13, 64
#: Words and states that a worker remembers, and twice as many pairs of pieces; it starts afresh beyond.
REMEMBERED = 160_000
#: Texts whose words are looked up together.
AT_ONCE = 256
MARK = "▁"
#: Runs between cuts: marks and the letters, or the other characters, after them. The superscript two has a piece with a full stop.
WORD = re.compile(rf"{MARK}*(?:[^\W\d_²]+|(?:[^\w{MARK}]|[\d_²])+)|{MARK}+")
#: Characters and the longest word that many words step over at once; others step one by one.
USUAL, LOCKSTEP = MARK + string.ascii_letters + ".,-#*$%&|:;'!?0123456789" + "àáâäçèéêëìíîïñòóôöùúûüßÉÈÀÖÄÜÑ", 48
#: What ends at a place that no path goes through.
NOWHERE = -2
State = tuple[int, int]  #: a piece by its start and end in the text; (-1, 0) and (end, end) are the text's own ends
Matrix = dict[State, dict[State, int]]  #: what is not there weighs minus infinity


def spellings(path: str) -> list[bytes]:
    """The bytes of each piece; control pieces spell nothing."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).encode()
    return [spelled(i) for i in range(sp.get_piece_size())]


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model of merges with identity normalisation and a leading mark."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        if any(WORD.fullmatch(p) is None for p in self.id):
            raise ValueError(f"{path}: a piece crosses the cuts that this operator relies on")
        #: A trie: node << 21 | character to node; the piece that ends at a node, or -1.
        self.trie: dict[int, int] = {}
        self.piece_at = [-1]
        for text, i in self.id.items():
            node = 0
            for c in text:
                step = node << 21 | ord(c)
                if step not in self.trie:
                    self.trie[step] = len(self.piece_at)
                    self.piece_at.append(-1)
                node = self.trie[step]
            self.piece_at[node] = i
        #: Single characters without a piece of their own are edges too: numbers from here on, by character.
        self.other = n
        self.inner = {step >> 21 for step in self.trie} - {0}
        self._forget()
        self.column = np.zeros(1 << 14, np.int64)
        self.column[[ord(c) for c in USUAL]] = np.arange(len(USUAL))
        self.usual = re.compile(f"[{re.escape(USUAL)}]+")
        if any(c not in self.id for c in USUAL):
            raise ValueError(f"{path}: a usual character has no piece")
        self.four = [i.to_bytes(4, "little") for i in range(n)]
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _forget(self) -> None:
        """Begin with the one state in front of a text."""
        first = array("i", [-1]).tobytes()
        #: Int32 bytes: the piece that ends here; then, of each piece begun before, the piece that it follows and its node.
        self.states, self.ending, self.lengths, self.weights = [first], [-1], [0], [0]
        self.numbered: dict[bytes, int] = {first: 0}
        self.steps: dict[int, int] = {}
        #: Steps over usual characters; nothing leads to state 0. Only what is used takes memory.
        self.table = np.zeros((2 * REMEMBERED, len(USUAL)), np.int32)

    def merges(self, text: str) -> list[str]:
        """The encoding by its definition: join the neighbours of best score, leftmost first, until none can be joined."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, piece: str) -> int:
        return self.id[piece] if piece in self.id else self.other + ord(piece)

    def spelled(self, number: int) -> str:
        return self.text[number] if number < self.other else chr(number - self.other)

    def fit(self, a: int, b: int) -> bool:
        """Whether the weight between neighbours a and b is not minus infinity."""
        if len(self.fits) > 2 * REMEMBERED:
            self.fits.clear()
        x, y = self.spelled(a), self.spelled(b)
        found = self.fits[a << 21 | b] = self.merges(x + y) == [x, y]
        return found

    def ids_of(self, number: int) -> tuple[int, ...]:
        return (number,) if number < self.other else tuple(self.bytes_[b] for b in chr(number - self.other).encode())

    def packed(self, numbers: list[int]) -> bytes:
        """Ids of pieces as little-endian int32."""
        known = self.four
        return b"".join([known[p] if p < self.other else b"".join([known[i] for i in self.ids_of(p)]) for p in numbers])

    def word(self, text: str) -> bytes:
        """Ids of a text between cuts."""
        return self.packed(self._word_path(text))

    def _step(self, state: int, code: int) -> int:
        """The state after one more character. A state is the piece that ends here, and the pieces begun before that may go on,
        each with the piece that it follows: all that the rest of the path depends on."""
        last, *rest = memoryview(self.states[state]).cast("i")
        found, on = NOWHERE, array("i", [0])
        if last != NOWHERE:
            rest += (last, 0)
        for k in range(0, len(rest), 2):  # longest first
            before, node = rest[k], rest[k + 1]
            after = self.trie.get(node << 21 | code)
            piece = -1 if after is None else self.piece_at[after]
            if piece < 0 and node == 0:
                piece = self.other + code  # a single character is always an edge
            if piece >= 0 and found < 0 and (before < 0 or self._fits(before, piece)):
                found = piece
            if after in self.inner:
                on.extend((before, after))
        on[0] = found
        return self._numbered(on)

    def _numbered(self, state: array) -> int:
        key = state.tobytes()
        new = self.numbered.get(key)
        if new is None:
            piece = state[0]
            new = self.numbered[key] = len(self.states)
            self.states.append(key)
            self.ending.append(piece)
            self.lengths.append(0 if piece < 0 else len(self.spelled(piece)))
            self.weights.append(0 if piece < 0 else 1 if piece < self.other else len(self.ids_of(piece)))
        return new

    def _fits(self, a: int, b: int) -> bool:
        ok = self.fits.get(a << 21 | b)
        return self.fit(a, b) if ok is None else ok

    def _run(self, text: str, state: int, start: int, stop: int) -> list[int]:
        """The states after each character of text[start:stop]."""
        steps, step, seen = self.steps, self._step, []
        for code in map(ord, text[start:stop]):
            after = steps.get(state << 21 | code)
            if after is None:
                after = steps[state << 21 | code] = step(state, code)
            state = after
            seen.append(state)
        return seen

    def _back(self, seen: list[int], n: int) -> list[int]:
        """The pieces of the path whose first n states are ``seen``."""
        path, ending, lengths = [], self.ending, self.lengths
        while n:
            state = seen[n - 1]
            path.append(ending[state])
            n -= lengths[state]
        return path[::-1]

    def _ids_before(self, seen: list[int]) -> list[int]:
        """Ids of the path up to each place; only places that a path goes through are of use."""
        out, lengths, weights = [0], self.lengths, self.weights
        for state in seen:
            out.append(out[-lengths[state]] + weights[state] if lengths[state] else 0)
        return out

    def _word_path(self, text: str) -> list[int]:
        """Pieces of a text between cuts, where every place is some piece's end."""
        return self._back(self._run(text, 0, 0, len(text)), len(text))

    def _lockstep(self, words: list[str]) -> list[bytes]:
        """``word`` for many short words of usual characters: all take their next step at once."""
        size = np.array([*map(len, words)])
        order = np.argsort(-size, kind="stable")
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        column = self.column[codes]
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        state, seen = np.zeros(len(words), np.int32), np.empty(len(codes), np.int32)
        for k in range(size[0]):
            on = np.searchsorted(-size, -k)  # words longer than k
            at = start[:on] + k
            now, c = state[:on], column[at]
            after = self.table[now, c]
            missing = np.flatnonzero(after == 0)
            if len(missing):
                pairs, first = np.unique(now[missing].astype(np.int64) << 32 | c[missing], return_index=True)
                for pair, i in zip(pairs.tolist(), missing[first].tolist(), strict=True):
                    to = self._step(pair >> 32, int(codes[at[i]]))
                    if len(self.states) > len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[pair >> 32, pair & 0xFFFFFFFF] = to
                after = self.table[now, c]
            seen[at] = state[:on] = after
        piece, length = np.array(self.ending, np.int32), np.array(self.lengths, np.int32)
        end, live, back = size.copy(), np.arange(len(words)), []
        while len(live):
            at = seen[start[live] + end[live] - 1]
            back.append((live, piece[at]))
            end[live] -= length[at]
            live = live[end[live] > 0]
        count = np.zeros(len(words), np.int64)
        for w, _ in back:
            count[w] += 1
        stop = np.cumsum(count)
        flat = np.empty(stop[-1], "<i4")
        for k, (w, p) in enumerate(back):
            flat[stop[w] - 1 - k] = p
        raw, out = flat.tobytes(), [b""] * len(words)
        for i, b, n in zip(order.tolist(), (4 * stop).tolist(), (4 * count).tolist(), strict=True):
            out[i] = raw[b - n : b]
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts between cuts, word by word; each word is encoded once while it is remembered."""
        parts = [WORD.findall(t) for t in texts]
        new = {w for p in parts for w in p if w not in self.words}
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = {w for p in parts for w in p}
        if len(self.states) > REMEMBERED or len(self.steps) > REMEMBERED:
            self._forget()
        usual = [w for w in new if len(w) <= LOCKSTEP and self.usual.fullmatch(w)]
        if usual:
            self.words.update(zip(usual, self._lockstep(usual), strict=True))
        for w in new.difference(usual):
            self.words[w] = self.word(w)
        known = self.words
        return [b"".join([known[w] for w in p]) for p in parts]

    def crossing(self, text: str, at: int) -> list[State]:
        """Pieces that may cover or end at boundary ``at``: those that start before it and do not end before it."""
        if at == 0:
            return [(-1, 0)]
        starts = range(max(0, at - self.longest), at)
        return [(s, e) for s in starts for e in range(at, min(len(text), s + self.longest) + 1) if e == s + 1 or text[s:e] in self.id]

    def cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last place of a chunk that every path has a piece's end at; None if it has none. The text's own ends are such."""
        first, last = 0 if lo == 0 else None, hi if hi == len(text) else None
        if first is None:
            found = (w.start() for w in WORD.finditer(text, lo - 1) if w.start() >= lo)
            first = next((k for k in found if k >= hi or self._cut(text, k)), hi)
            first = first if first < hi else last
        if last is None and first is not None:
            last = next(k for k in range(hi - 1, first - 1, -1) if k == first or self._cut(text, k))
        return None if first is None else (first, last)

    @staticmethod
    def _cut(text: str, k: int) -> bool:
        """A word never goes on from text[k - 1] to text[k]."""
        return WORD.fullmatch(text[k - 1 : k + 1]) is None

    def _entered(self, text: str, entry: State) -> int:
        """The automaton's state behind an entering piece."""
        return 0 if entry[0] < 0 else self._numbered(array("i", [self.number(text[entry[0] : entry[1]])]))

    def _leaving(self, text: str, state: int, start: int, hi: int) -> dict[State, int]:
        """Pieces that a path from ``start`` may leave a chunk by, with the ids up to and with each."""
        seen = self._run(text, state, start, min(len(text), hi + self.longest - 1))
        ids, out = self._ids_before(seen), {}
        for e in range(hi, start + len(seen) + 1):
            n = self.lengths[seen[e - 1 - start]]
            if n and e - n < hi:
                out[e - n, e] = ids[e - start]
        return out

    def transfers(self, chunks: list[tuple[str, int, int]]) -> list[tuple[tuple[int, int] | None, bytes, Matrix]]:
        """Of each chunk [lo, hi) of a text that reaches a piece's length beyond both ends: its first and last cut, the ids between them, and its
        matrix, with the ids after the entering piece up to and with the leaving one."""
        cuts = [self.cuts(*c) for c in chunks]
        inner = self.encode_texts(["" if k is None else text[k[0] : k[1]] for (text, _, _), k in zip(chunks, cuts, strict=True)])
        return [(k, ids, self._matrix(*c, k, len(ids) // 4)) for c, k, ids in zip(chunks, cuts, inner, strict=True)]

    def _matrix(self, text: str, lo: int, hi: int, cuts: tuple[int, int] | None, inner: int) -> Matrix:
        entering = self.crossing(text, lo)
        if cuts is None:
            rows = {entry: self._leaving(text, self._entered(text, entry), entry[1], hi) for entry in entering}
            return {entry: row for entry, row in rows.items() if row}
        first, last = cuts
        # after a cut the way does not depend on the piece before it: words are apart
        tail = {(hi, hi): 0} if last == hi else self._leaving(text, 0, last, hi)
        out = {}
        for entry in entering:
            if entry[1] <= first:  # no piece goes over a cut
                seen = self._run(text, self._entered(text, entry), entry[1], first)
                if not seen or self.lengths[seen[-1]]:
                    head = self._ids_before(seen)[-1] + inner
                    out[entry] = {leave: head + n for leave, n in tail.items()}
        return out

    def trace(self, head: str, tail: str, cuts: tuple[int, int] | None, entry: State, leave: State) -> tuple[bytes, bytes]:
        """Ids of a chunk after ``entry`` up to the first cut, and from the last cut up to and with ``leave``. ``head``: its text up to the first
        cut, ``tail``: its text from the last one on; without cuts, ``head`` is all of it and the first ids go to ``leave``."""
        if cuts is None:
            return self.packed(self._back(self._run(head, self._entered(head, entry), entry[1], leave[1]), leave[1] - entry[1])), b""
        before = self._run(head, self._entered(head, entry), entry[1], cuts[0])
        after = self._run(tail, 0, 0, leave[1] - cuts[1])
        return self.packed(self._back(before, len(before))), self.packed(self._back(after, len(after)))


def through(vector: dict[State, int], matrix: Matrix) -> dict[State, int]:
    """Max-plus product of a row vector and a matrix."""
    out: dict[State, int] = {}
    for k, n in vector.items():
        for j, m in matrix.get(k, {}).items():
            if j not in out or n + m > out[j]:
                out[j] = n + m
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two sparse matrices; associative."""
    rows = {i: through(row, b) for i, row in a.items()}
    return {i: row for i, row in rows.items() if row}


def way_through(matrices: list[Matrix], entry: State, leave: State, before: int = 0) -> list[tuple[State, State, int]]:
    """Of each of some neighbouring chunks or blocks, between whose ends ``entry`` and ``leave`` the path lies: the piece that enters, the piece
    that leaves, and the ids before."""
    vectors, out = [{entry: before}], []
    for m in matrices:
        vectors.append(through(vectors[-1], m))
    for m, v in zip(reversed(matrices), reversed(vectors[:-1]), strict=True):
        enter = max((s for s in v if leave in m.get(s, ())), key=lambda s: v[s] + m[s][leave])
        out.append((enter, leave, v[enter]))
        leave = enter
    return out[::-1]


def marked(text: str) -> str:
    """As the model's normaliser leaves it: a leading mark, and marks for blanks; empty stays empty."""
    return (" " + text).replace(" ", MARK) if text else ""


def spelled(raw: bytes) -> str:
    """Marks back to blanks, without the leading one."""
    text = raw.decode(errors="replace").replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


def decode(pieces: list[bytes], ids) -> str:
    """The text of ids: ``spellings`` joined."""
    return spelled(b"".join([pieces[i] for i in ids]))


def lists(packed: list[bytes]) -> pa.Array:
    """A list column from int32 bytes."""
    offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _vocabulary(path: str) -> Vocabulary:
    return per_worker(f"sentencepiece {path}", lambda: Vocabulary(path))


def _cells(matrix: Matrix, shift: int = 0) -> bytes:
    """A matrix as int64 bytes; positions are moved by ``shift``."""
    at = lambda s: (s[0] + shift if s[0] >= 0 else -1, s[1] + shift)
    return np.array([(*at(i), *at(j), n) for i, row in matrix.items() for j, n in row.items()], "<i8").tobytes()


def _matrix_of(cells: bytes) -> Matrix:
    out: Matrix = {}
    for a, b, c, d, n in np.frombuffer(cells, "<i8").reshape(-1, 5).tolist():
        out.setdefault((a, b), {})[c, d] = n
    return out


def _decoding(pieces: list[bytes], column: pa.ListArray) -> list[pa.Array]:
    """Of a list column of ids: the texts, and the checksums over ids as little-endian uint32."""
    cuts = column.offsets.to_numpy()
    flat, cuts = column.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0]
    raw = [pieces[i] for i in flat.tolist()]
    text = [spelled(b"".join(raw[lo:hi])) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    crc = [zlib.crc32(flat[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [pa.array(text, pa.string()), pa.array(crc, pa.int64())]


def _pieces(path: str) -> list[bytes]:
    return per_worker(f"spellings {path}", lambda: spellings(path))


def _decoded(path: str):
    def scan(batches):
        for b in (x.slice(at, AT_ONCE) for x in batches for at in range(0, x.num_rows, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([b.column(0), *_decoding(_pieces(path), b.column(1))], ["row", "decoded", "ids_crc32"])

    return scan


def _whole(path: str, decoded: bool):
    """Texts of one chunk: its matrix is the whole product. The same worker decodes, where that is asked for."""

    def scan(batches):
        v = _vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                texts = [marked(t or "") for t in some.column(1).to_pylist()]
                ids = []
                for text, (cuts, inner, matrix) in zip(texts, v.transfers([(t, 0, len(t)) for t in texts]), strict=True):
                    [(entry, leave, _)] = way_through([matrix], (-1, 0), (len(text), len(text)))
                    before, after = v.trace(text[: cuts[0]], text[cuts[1] :], cuts, entry, leave)
                    ids.append(before + inner + after)
                columns = [some.column(0), lists(ids)]
                columns += _decoding(_pieces(path), columns[1]) if decoded else []
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "decoded", "ids_crc32"][: len(columns)])

    return scan


def _cut(chunk: int, reach: int):
    """Texts into chunks that reach beyond both ends by ``reach`` characters, in one pass."""

    def scan(batches):
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                text = marked(text)
                n = -(-len(text) // chunk)
                for at in range(0, n, AT_ONCE):
                    some = range(at, min(n, at + AT_ONCE))
                    shift = [max(0, c * chunk - reach) for c in some]
                    parts = [text[s : (c + 1) * chunk + reach] for c, s in zip(some, shift, strict=True)]
                    hi = [min(len(text), (c + 1) * chunk) - s for c, s in zip(some, shift, strict=True)]
                    lo = [c * chunk - s for c, s in zip(some, shift, strict=True)]
                    row = b.column(0).take(pa.array(np.full(len(some), k)))
                    yield pa.RecordBatch.from_arrays([row, pa.array(list(some), pa.int32()), pa.array(parts), pa.array(shift, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["row", "k", "text", "shift", "lo", "hi"])

    return scan


def _matrices(path: str):
    """Chunks: matrices, and what a trace needs."""

    def scan(batches):
        v = _vocabulary(path)
        for b in (x.slice(at, AT_ONCE) for x in batches for at in range(0, x.num_rows, AT_ONCE)):
            texts, shift, lo, hi = (b.column(c).to_pylist() for c in (2, 3, 4, 5))
            found = v.transfers(list(zip(texts, lo, hi, strict=True)))
            cells = [_cells(matrix, s) for (_, _, matrix), s in zip(found, shift, strict=True)]
            ends = [(t, "", None, None) if cuts is None else (t[: cuts[0]], t[cuts[1] :], *cuts) for t, (cuts, _, _) in zip(texts, found, strict=True)]
            head, tail, first, last = zip(*ends, strict=True) if ends else ([], [], [], [])
            columns = (pa.array(cells, pa.binary()), pa.array(head, pa.string()), pa.array(tail, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), lists([ids for _, ids, _ in found]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(6), *columns], ["row", "k", "shift", "times", "cells", "head", "tail", "first", "last", "inner"])

    return scan


def _multiplied(batches):
    """Of each block: the product of its members' matrices."""
    for b in batches:
        out = [_cells(functools.reduce(product, map(_matrix_of, cells))) for cells in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["row", "k", "cells"])


def _ends(batches):
    """Of each text's one matrix: the way through all of it."""
    for b in batches:
        ends = [max((leave for leave in _matrix_of(c)[-1, 0]), key=lambda s: s[1]) for c in b.column(2).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in ([-1] * len(ends), [0] * len(ends), [c for c, _ in ends], [d for _, d in ends], [0] * len(ends))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["row", "k", "a", "b", "c", "d", "before"])


def _ways(fan: int):
    """Of each block with its own way: the way through each member."""

    def scan(batches):
        for b in batches:
            block, cells, *own = (b.column(c).to_pylist() for c in range(1, 8))
            found = [way_through([*map(_matrix_of, m)], (s, e), (t, f), n) for m, s, e, t, f, n in zip(cells, *own, strict=True)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found]))
            k = pa.array([fan * at + i for at, w in zip(block, found, strict=True) for i in range(len(w))], pa.int32())
            flat = np.array([(*i, *j, n) for w in found for i, j, n in w], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), k, *(pa.array(flat[:, c]) for c in range(5))], ["row", "k", "a", "b", "c", "d", "before"])

    return scan


def _traced(path: str):
    """Of each chunk the ids before its first cut, as part 0, and after its last one, as part 2."""

    def scan(batches):
        v = _vocabulary(path)
        for b in batches:
            ids = []
            for head, tail, first, last, shift, s, e, t, f in zip(*(b.column(c).to_pylist() for c in range(2, 11)), strict=True):
                entry, leave = (s - shift if s >= 0 else -1, e - shift), (t - shift, f - shift)
                ids += v.trace(head, tail, None if first is None else (first, last), entry, leave)
            row = pa.array(np.repeat(np.arange(b.num_rows), 2))
            part = pa.array(np.tile([0, 2], b.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), part, lists(ids)], ["row", "k", "part", "ids"])

    return scan


def longest_piece(path: str) -> int:
    """Characters of the longest piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return max(len(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


_ROW = "row struct<id:bigint,h1:bigint,h2:bigint>"


def ways(level: DataFrame, n: int, fan: int) -> DataFrame:
    """``row, k, a, b, c, d, before`` of each chunk of ``level`` (row, k, cells), at most ``n`` of a text: products of blocks of ``fan`` up to one
    matrix of each text, and the way back down. No task holds more than a block's matrices, of some dozen cells each."""
    block = F.expr(f"cast(k div {fan} as int)").alias("k")
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("k", "cells"))), lambda c: c["cells"]).alias("cells")
    levels = [level]
    while n > 1:
        levels.append(materialise(levels[-1].groupBy("row", block).agg(sorted_).mapInArrow(_multiplied, f"{_ROW}, k int, cells binary"), "products"))
        n = -(-n // fan)
    kind = f"{_ROW}, k int, a long, b long, c long, d long, before long"
    way = levels.pop().mapInArrow(_ends, kind)
    for members in reversed(levels):
        way = members.groupBy("row", block).agg(sorted_).join(way, ["row", "k"]).mapInArrow(_ways(fan), kind)
    return way


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN, decoded: bool = False) -> DataFrame:
    """``id, ids, n_chunks``: the ids of each text as the model's own encoder gives them; with ``decoded`` the columns of ``decode_ids`` too, for which
    texts of one chunk need no second pass through Python.

    Null and empty texts have no ids. Texts over ``chunk`` characters are several chunks, which different tasks take. A null id stays,
    repeated rows repeat, an empty table gives an empty result, other columns are not read. A chunk shorter than two of the model's pieces raises
    ValueError."""
    spark = df.sparkSession
    small_batches(spark)
    reach = longest_piece(model_path)
    if chunk < 2 * reach or fan < 2:
        raise ValueError(f"a chunk of {chunk} characters is shorter than two pieces of {reach}, or a block of {fan} holds no two chunks")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = F.coalesce(F.length("text"), F.lit(0)) + 1 > chunk  # with the leading mark
    more = ", decoded string, ids_crc32 long" if decoded else ""
    one = rows.filter(~several).select(F.struct("id").alias("row"), "text").mapInArrow(_whole(model_path, decoded), f"row struct<id:bigint>, ids array<int>{more}")
    one = one.select("row.id", "ids", F.lit(1).alias("n_chunks"), *(["decoded", "ids_crc32"] if decoded else []))
    # a row is known by id and content; equal ones are encoded once and each gets the result
    key = F.struct("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).alias("row")
    cut = rows.filter(several).select(key, "text").mapInArrow(_cut(chunk, reach), f"{_ROW}, k int, text string, shift long, lo int, hi int")
    dealt = cut.groupBy("row", "k").agg(F.first(F.struct("text", "shift", "lo", "hi")).alias("c"), F.count(F.lit(1)).cast("int").alias("times")).select("row", "k", "c.*", "times")
    kind = f"{_ROW}, k int, shift long, times int, cells binary, head string, tail string, first int, last int, inner array<int>"
    chunks = materialise(dealt.mapInArrow(_matrices(model_path), kind), "chunks")
    most = chunks.agg(F.max("k")).first()[0]
    if most is None:
        return one
    way = ways(chunks.select("row", "k", "cells"), most + 1, fan)
    # only the ends of chunks, which are short, meet the way; the ids between the cuts move once, to their text
    ends = chunks.select("row", "k", "head", "tail", "first", "last", "shift").join(way, ["row", "k"]).drop("before")
    traced = ends.mapInArrow(_traced(model_path), f"{_ROW}, k int, part int, ids array<int>")
    parts = traced.unionByName(chunks.select("row", "k", F.lit(1).alias("part"), F.col("inner").alias("ids")))
    whole = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "part", "ids"))).alias("parts"))
    times = chunks.filter("k = 0").select("row", "times")
    many = whole.join(times, "row").select("row.id", F.flatten("parts.ids").alias("ids"), (F.size("parts") / 3).cast("int").alias("n_chunks"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"))
    many = many.drop("copy")
    return one.unionByName(decode_ids(many, model_path) if decoded else many)


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids, and ``ids_crc32`` over them as little-endian uint32."""
    rows = encoded.select(F.struct("*").alias("row"), "ids")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_decoded(model_path), f"row {kind}, decoded string, ids_crc32 long").select("row.*", "decoded", "ids_crc32")


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_model_path()
    d = encode(documents(spark, sf_dir), path, decoded=True)
    return d.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "n_chunks", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
