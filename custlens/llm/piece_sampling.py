"""SentencePiece encoding by forward filtering and backward sampling.

The lattice of a text has a node between any two characters and an arc for each
piece of the vocabulary that spells the characters between two nodes.  Forward
filtering sums the weights of all paths from the left; backward sampling walks
from the right end, drawing each arc by its share.  So every segmentation comes
with its probability under the pieces' weights to the power ALPHA.

No piece holds a space after another character, so each path passes the node
before every word.  The lattice is therefore filtered once per different word and
kept, and all words of an Arrow batch are sampled side by side in numpy.  Draws
come from a hash of (seed, row key, word number, step): a row gives the same
pieces on any machine and in any partition.

A character without a piece, and a literal U+2581, is written as its UTF-8 bytes by
byte pieces, so decoding gives back every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow
from custlens.llm.wordhash import mix

BAR = "▁"
_RUNS = re.compile(r" *[^ ]+| +$")
ALPHA = 0.5


class Lattices:
    """Filtered lattices of the words met so far; beyond ``cap`` words they start anew."""

    def __init__(self, path: str, alpha: float = ALPHA, cap: int = 200_000):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha, self.cap = alpha, cap
        self.pieces: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for k in range(model.get_piece_size()):
            p = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(p[3:5], 16)
                self.byte[value] = k
                self.raw.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.raw.append(b"")
            else:
                p = p.replace(BAR, " ")  # so a literal U+2581 of a text is no piece
                if " " in p.lstrip(" "):
                    raise ValueError(f"piece {p!r} crosses a word")
                self.pieces[p] = k
                self.raw.append(p.encode())
        # merge ranks become weights by Zipf's law
        rank = np.array([min(len(self.raw), max(0.0, -model.get_score(k))) for k in range(len(self.raw))])
        self.weight = -alpha * np.log(rank + 3)
        # a trie over code points: key = state << 21 | code point, sorted
        states: dict[str, int] = {"": 0}
        edges = []
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    edges.append((states[p[:k - 1]] << 21 | ord(p[k - 1]), states[p[:k]]))
        edges.sort()
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*edges))
        self.piece = np.full(len(states), -1)
        for p, k in self.pieces.items():
            self.piece[states[p]] = k
        self._start()

    def _start(self) -> None:
        self.words: dict[str, int] = {}
        self.sizes: list[int] = []
        self.nodes = 0
        self.firsts: list[int] = []
        # per arc: upper end of its share, nodes it spans, place and number of its ids; per node: its first arc
        self.tables = [np.zeros(0, t) for t in (np.float32, np.int16, np.int32, np.int8)]
        self.arcs = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def add(self, words: list[str]) -> None:
        """Filter the lattices of new words, all at once."""
        size = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        stop = np.cumsum(size)[word]
        # every piece from every character on
        at, state, step = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        arcs: list[tuple] = []
        while len(at):
            key = state << 21 | chars[at + step]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            at, state, step = at[ok], self.next[i[ok]], step + 1
            k = self.piece[state]
            whole = k >= 0
            arcs.append((at[whole], np.full(int(whole.sum()), step), k[whole]))
            on = at + step < stop[at]
            at, state = at[on], state[on]
        left, span, ids = (np.concatenate(x) for x in zip(*arcs))
        weight, n = self.weight[ids], np.ones(len(ids), np.int64)
        alone = np.ones(len(chars), bool)
        alone[left[span == 1]] = False
        alone = np.flatnonzero(alone)
        if len(alone):  # as bytes
            raw = [[self.byte[x] for x in chr(c).encode()] for c in chars[alone].tolist()]
            left, span = np.concatenate([left, alone]), np.concatenate([span, np.ones(len(alone), np.int64)])
            weight = np.concatenate([weight, [float(self.weight[r].sum()) for r in raw]])
            n = np.concatenate([n, [len(r) for r in raw]])
            ids = np.concatenate([ids, np.concatenate(raw)])
        place = np.cumsum(n) - n
        source = left + word[left]
        node = source + span
        order = np.lexsort([source, node, left + span - (stop - size[word])[left]])
        source, node, span, weight, n, place = (x[order] for x in (source, node, span, weight, n, place))
        depth = node - (np.cumsum(size) - size + np.arange(len(words)))[word[left[order]]]
        forward, share = np.zeros(len(chars) + len(words)), np.empty(len(node))
        cuts = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]]))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):  # all words' nodes of one depth
            v, to = forward[source[i:j]] + weight[i:j], node[i:j]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            many = np.diff(np.concatenate([first, [j - i]]))
            top = np.maximum.reduceat(v, first)
            e = np.exp(v - np.repeat(top, many))
            total = np.add.reduceat(e, first)
            forward[to[first]] = top + np.log(total)
            c = np.cumsum(e / np.repeat(total, many))
            c -= np.repeat(np.concatenate([[0.0], c[first[1:] - 1]]), many)
            c[np.concatenate([first[1:], [j - i]]) - 1] = 1.0
            share[i:j] = np.clip(c, 0.0, 1.0)
        order = np.argsort(node, kind="stable")
        new = [share[order], span[order], (place + len(self.flat))[order], n[order]]
        first = len(self.tables[0]) + np.searchsorted(node[order], np.arange(len(chars) + len(words)))
        self.arcs = np.concatenate([self.arcs, first.astype(np.int32)])
        self.tables = [np.concatenate([t, x.astype(t.dtype)]) for t, x in zip(self.tables, new)]
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        base = len(self.sizes)
        self.words.update(zip(words, range(base, base + len(words))))
        self.sizes += size.tolist()
        self.firsts += (self.nodes + np.cumsum(size) - size + np.arange(len(words))).tolist()
        self.nodes += len(chars) + len(words)

    def split(self, text: str) -> list[str]:
        """Words of a text that is not empty, each with the spaces before it."""
        if "  " in text or text[0] == " ":
            return _RUNS.findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """Sampled ids of each text; ``keys``: one 64-bit row key per text."""
        if len(self.words) > self.cap:
            self._start()
        cut = [self.split(t) if t else [] for t in texts]
        seen = set().union(*cut)
        new = list(seen.difference(self.words))
        for i in range(0, len(new), 20_000):
            self.add(new[i:i + 20_000])
        number, count = [], [len(own) for own in cut]
        for own in cut:
            number += map(self.words.__getitem__, own)
        if not number:
            return [np.zeros(0, np.int32) for _ in texts]
        share, span, place, size = self.tables
        number = np.array(number, np.int64)
        first = np.array(self.firsts, np.int64)[number]
        node = first + np.array(self.sizes, np.int64)[number]
        count = np.array(count)
        within = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
        state = mix(np.repeat(mix(keys ^ np.uint64(seed)), count) + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, steps = np.arange(len(number)), []
        while len(live):
            state[live] = mix(state[live] + np.uint64(0x632BE59BD9B4E019))
            u = (state[live] >> np.uint64(12)).astype(np.float64) * 2.0**-52
            a = self.arcs[node[live]]
            past = np.flatnonzero(share[a] <= u)
            while len(past):  # the last arc's share ends at 1
                a[past] += 1
                past = past[share[a[past]] <= u[past]]
            steps.append((live, a))
            node[live] -= span[a]
            live = live[node[live] > first[live]]
        # from the last step to the first, word by word
        who = np.concatenate([s[0] for s in steps[::-1]])
        what = np.concatenate([s[1] for s in steps[::-1]])
        what = what[np.argsort(who, kind="stable")]
        n = size[what].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(place[what] - (ends - n), n) + np.arange(int(ends[-1]))]
        per_word = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(number)))])
        cut = np.concatenate([[0], ends])[per_word[np.concatenate([[0], np.cumsum(count)])]]
        return [ids[i:j] for i, j in zip(cut.tolist(), cut[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded: the first piece's leading space is the encoder's own."""
        raw = self.raw
        return b"".join(map(raw.__getitem__, ids.tolist())).decode()[1:]


_LATTICES: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """One per worker process."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(path, alpha)
    return _LATTICES[path, alpha]


def encode_documents(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = 6) -> DataFrame:
    """doc_id and ids (array of int).  The row key is doc_id (null: 0), so rows of one
    doc_id and text get the same pieces.  A null or empty text has no piece; only
    doc_id and text are read; an empty table gives an empty one."""
    types = arrow_types("doc_id long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model, alpha)
        for b in batches:
            if b.num_rows:
                keys = b.column(0).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
                got = lat.sample([t or "" for t in b.column(1).to_pylist()], keys, seed)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
                yield as_batch([b.column(0), ids], types)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit) and
    the decoded text."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, text string"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model, alpha)
        for b in batches:
            if b.num_rows:
                own = b.column(1)
                ends = own.offsets.to_numpy()
                flat = own.values.to_numpy()
                ids = [flat[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]
                yield as_batch([b.column(0), [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [lat.decode(x) for x in ids]], types)

    return map_arrow(encoded.select("doc_id", "ids"), run, schema)
