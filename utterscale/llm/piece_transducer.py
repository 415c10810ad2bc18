"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled transducer chains the normaliser (dummy prefix, blanks to U+2581), the pieces
as one table of trie arcs, and byte fallback, whose arcs take any character that no piece
spells alone and put out its bytes. Composed with a text it is a lattice over the text's
positions; the encoding is its shortest path in the tropical semiring (costs are added, the
smallest wins, an earlier start on ties). In a unigram model an arc costs the negative score
of its piece. In a merge model (BPE) a state also knows the last piece, and an arc costs
nothing if its piece may follow that, that is if merging the two pieces' characters gives back
just these two, and infinitely much otherwise. Exactly one path to each position then stays
finite, so one state per position is enough, and the path is the library's.

A text is cut into units (blanks and the word behind them) that no piece crosses. All distinct
units of a batch are composed and relaxed together, position by position.

Defined cases: a null text has null ids, an empty one no ids; repeated rows are encoded
alike; texts of any length are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from utterscale.llm.common import flat_bytes, ranges, slices

SPACE = "▁"
PIECE = 1 << 20
MEMO = 1 << 18  # distinct units kept per worker, with up to 16 ids each; a bound on memory only
CACHE = 20  # bits of the table of pairs already judged; a fuller one only judges some again
LONG = 1 << 9  # parts of a merge model up to this length are relaxed together, longer ones arc by arc
STEPS = 1 << 16  # units relaxed together, and pairs judged together; bounds on memory


class Transducer:
    """Compiled from the model file's bytes."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.precompiled_charsmap or trainer.model_type not in (1, 2) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with the identity normaliser are supported")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.merges = trainer.model_type == 2
        usual = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        found = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.bytes = np.array([found.get(b, self.unknown) for b in range(256)]) if found else None
        # a piece that holds a mark behind another character would cross units
        self.by_mark = not any(SPACE in p.lstrip(SPACE) for p, _, _ in usual)
        self.text = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6
                     else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self._compile(usual)
        self.names = pa.array([], pa.large_string())  # units encoded before, and their ids
        self.pool, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _compile(self, usual: list[tuple[str, float, int]]) -> None:
        """Arc tables. Symbols: pieces, then characters that pieces hold but none spells alone,
        last the symbol of all other characters."""
        names = [p for p, _, _ in usual]
        symbol = {p: k for k, p in enumerate(names)}
        for c in sorted({c for p in names for c in p}):
            symbol.setdefault(c, len(symbol))
        self.other = len(symbol)
        self.out = np.full(self.other + 1, -1)  # -1: byte fallback
        self.out[:len(names)] = [i for _, _, i in usual]
        scores = np.array([s for _, s, _ in usual], np.float32)
        self.cost = np.full(self.other + 1, 10 - scores.min(initial=0.0), np.float32)
        self.cost[:len(names)] = -scores
        # the alphabet by code point, then trie arcs as sorted numbers of node and character
        chars = [c for c in symbol if len(c) == 1]
        points = np.array(sorted(map(ord, chars)), np.int64)
        self.single = np.array([symbol[chr(c)] for c in points] + [self.other], np.int32)  # last: any other character
        self.width = len(chars)
        self.place = np.full(0x110000, self.width, np.int32)
        self.place[points] = np.arange(self.width)
        place = {chr(c): k for k, c in enumerate(points)}
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for p in names:
            node = 0
            for c in p:
                node = nodes.setdefault(node * self.width + place[c], len(nodes) + 1)
            ends[node] = symbol[p]
        self._pack(nodes)
        self.accept = np.full(len(nodes) + 1, -1)
        self.accept[list(ends)] = list(ends.values())
        self.longest = max(map(len, names), default=1)
        # which two symbols merge, and into what
        self.joins = joins = {symbol[p[:k]] * (self.other + 1) + symbol[p[k:]]: symbol[p] for p in names
                 for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.pairs = np.array(sorted(joins))
        self.pair_to = np.array([joins[k] for k in self.pairs])
        order = np.argsort(-scores, kind="stable")
        self.rank = np.full(self.other + 2, 1 << 40)  # equal scores have equal ranks
        ordered = scores[order]
        self.rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if len(order) else []
        self.rank_of = self.rank.tolist()
        self.pairs_judged: dict[tuple[int, int], bool] = {}
        self.spelled = np.full((self.other + 1, self.longest), -1, np.int32)
        for p, k in symbol.items():
            self.spelled[k, :len(p)] = [symbol[c] for c in p]
        self.spelled[self.other, 0] = self.other
        self.letters = (self.spelled >= 0).sum(1)
        self.judged = np.full(1 << CACHE, -1)
        self.verdict = np.zeros(1 << CACHE, bool)
        alone = np.arange(self.other + 1)
        self.alone = self._unmerged(np.full(len(alone), -1), alone) if self.merges else np.ones(len(alone), bool)

    def _pack(self, nodes: dict[int, int]) -> None:
        """Trie arcs in one array: the arc of ``node`` by character ``c`` is in slot ``base[node] + c`` if
        that slot is owned by ``node``. Nodes with most arcs are placed first, each at the first base that fits."""
        arcs = np.array(sorted(nodes), np.int64)
        to = np.array([nodes[k] for k in arcs.tolist()], np.int64)
        node, char = np.divmod(arcs, max(self.width, 1))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(arcs) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(arcs)])
        room = 2 * len(arcs) + 2 * self.width + 2
        self.base = np.zeros(len(nodes) + 1, np.int32)
        self.owner = np.full(room, -1, np.int32)
        self.target = np.zeros(room, np.int32)
        low = self.width  # no free slot below is tried again by nodes of several arcs
        for k in np.argsort(-sizes, kind="stable").tolist():
            a, c = starts[k], char[starts[k]:starts[k] + sizes[k]]
            while True:
                if low + 4 * self.width + 512 > len(self.owner):
                    more = len(self.owner)
                    self.owner = np.r_[self.owner, np.full(more, -1, np.int32)]
                    self.target = np.r_[self.target, np.zeros(more, np.int32)]
                free = low + np.flatnonzero(self.owner[low:low + 256] < 0)
                fits = free[(self.owner[free[:, None] + (c - c[0])] < 0).all(1)]
                if len(fits):
                    break
                low += 256
            base = int(fits[0]) - int(c[0])
            self.base[node[a]] = base
            self.owner[base + c] = node[a]
            self.target[base + c] = to[a:a + sizes[k]]
            if sizes[k] == 1:
                low = max(low, base + int(c[0]))
        self.owner = np.r_[self.owner, np.full(self.width + 1, -1, np.int32)]

    def _unmerged(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both (no last piece: -1) gives back just these two.

        Merging takes the best score first, leftmost on ties; all pairs go on together.
        """
        if len(last) > STEPS:
            return np.concatenate([self._unmerged(last[a:a + STEPS], piece[a:a + STEPS]) for a in range(0, len(last), STEPS)])
        left = np.where(last >= 0, self.letters[last], 0)
        size = left + self.letters[piece]
        row = np.full((len(last), int(size.max(initial=1)) + 1), -1, np.int64)
        at, k = np.arange(len(last)), np.arange(self.longest)
        for base, who in ((np.zeros(len(last), np.int64), last), (left, piece)):
            some = (who >= 0)[:, None] & (k < self.letters[who][:, None])
            r, c = np.nonzero(some)
            row[r, base[r] + c] = self.spelled[who[r], c]
        to = self._joined(row[:, :-1], row[:, 1:])
        good = np.zeros(len(last), bool)
        while len(at):
            rank = self.rank[to]
            best = rank.argmin(1)
            line = np.arange(len(at))
            stop = rank[line, best] >= 1 << 40
            good[at[stop]] = size[stop] == (left[stop] > 0) + 1
            go_on = ~stop & ~((left > 0) & (best == left - 1))  # a merge across the two ends it
            at, row, to, left, size, best = at[go_on], row[go_on], to[go_on], left[go_on], size[go_on], best[go_on]
            if not len(at):
                break
            line = np.arange(len(at))
            row[line, best] = to[line, best]
            behind = np.arange(row.shape[1])[None, :] > best[:, None]
            row[:, :-1] = np.where(behind[:, :-1], row[:, 1:], row[:, :-1])
            row[:, -1] = -1
            to[:, :-1] = np.where(behind[:, :-2], to[:, 1:], to[:, :-1])
            to[:, -1] = -1
            to[line, best] = self._joined(row[line, best], row[line, best + 1])
            before = np.maximum(best - 1, 0)
            to[line, before] = self._joined(row[line, before], row[line, before + 1])
            left, size = left - (best < left), size - 1
        return good

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol two neighbours merge into, -1 if they don't."""
        if not len(self.pairs):
            return np.full(a.shape, -1)
        key = a * (self.other + 1) + b
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[k] == key) & (a >= 0) & (b >= 0), self.pair_to[k], -1)

    def _follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``_unmerged`` of every pair, remembered in a table of fixed size."""
        out = self.alone[piece]
        some = np.flatnonzero(last >= 0)
        key = last[some] * (self.other + 1) + piece[some]
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE)).astype(np.int64)
        known = self.judged[slot] == key
        result = self.verdict[slot] & known
        new, of = np.unique(key[~known], return_inverse=True)
        if len(new):
            found = self._unmerged(new // (self.other + 1), new % (self.other + 1))
            result[~known] = found[of]
            one = np.full(len(new), -1)
            one[of] = slot[~known]
            self.judged[one] = new  # of several for a slot the last stays, in both tables
            self.verdict[one] = found
        out[some] = result
        return out

    def _lattice(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the units' composition: start, end (places in ``points``) and symbol."""
        char = self.place[points]
        at, node = np.arange(len(points)), np.zeros(len(points), np.int32)
        start, stop, symbol = [at], [at + 1], [self.single[char]]
        for depth in range(self.longest):
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
            slot = self.base[node] + char[at + depth]
            step = self.owner[slot] == node
            at, node = at[step], self.target[slot[step]]
            got = self.accept[node]
            full = (got >= 0) if depth else np.zeros(len(at), bool)  # single characters are there
            start.append(at[full])
            stop.append(at[full] + depth + 1)
            symbol.append(got[full])
        return np.concatenate(start), np.concatenate(stop), np.concatenate(symbol)

    def _paths(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and the number of ids of each."""
        points = np.frombuffer(flat_bytes(units)[0].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = pc.utf8_length(units).to_numpy().astype(np.int64)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        start, stop, symbol = self._lattice(points, begin + np.repeat(sizes, sizes))
        # where no arc crosses from one character to the next, the lattice falls apart
        over = np.cumsum(np.bincount(start + 1, minlength=len(points) + 1) - np.bincount(stop, minlength=len(points) + 1))
        alone = np.flatnonzero(over[:-1] == 0)
        begin = np.repeat(alone, np.diff(np.r_[alone, len(points)]))
        depth = stop - begin[start]
        order = np.argsort(((depth * (len(points) + 1) + stop) * (self.longest + 1)) + self.longest - (stop - start))
        start, stop, symbol, depth = start[order], stop[order], symbol[order], depth[order]
        # the state behind character i is at i + 1; a part starts afresh, with no cost and no last piece
        cost = np.zeros(len(points) + 1, np.float32)
        last = np.full(len(points) + 1, -1)
        first = begin[start] == start
        length = np.repeat(np.diff(np.r_[alone, len(points)]), np.diff(np.r_[alone, len(points)]))
        if self.merges and length.max(initial=0) > LONG:
            far = np.flatnonzero(length[start] > LONG)
            far = far[np.lexsort((start[far], stop[far]))]
            self._walk(start[far], stop[far], symbol[far], first[far], last)
            near = length[start] <= LONG
            start, stop, symbol, depth, first = start[near], stop[near], symbol[near], depth[near], first[near]
        cuts = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            i, j, s = start[a:b], stop[a:b], symbol[a:b]
            before = np.where(first[a:b], -1, last[i])
            if self.merges:
                total = np.where(self._follows(before, s), np.float32(0), np.float32(np.inf))
            else:
                total = np.where(first[a:b], np.float32(0), cost[i]) + self.cost[s]
            new = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
            least = np.minimum.reduceat(total, new)
            group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(j)]))
            hit = np.flatnonzero(total == least[group])
            win = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]
            cost[j[win]], last[j[win]] = total[win], s[win]
        return self._spelled_out(points, sizes, last)

    def _walk(self, start: np.ndarray, stop: np.ndarray, symbol: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """The same for a merge model's arcs in order of their ends, one by one: a state's first free arc is its only one."""
        begins, done = set(start[first].tolist()), -1
        for i, j, s in zip(start.tolist(), stop.tolist(), symbol.tolist()):
            if j == done:
                continue
            before = -1 if i in begins else int(last[i])
            free = self.alone[s] if before < 0 else self.pairs_judged.get((before, s))
            if free is None:
                free = self._unmerged_one(before, s)
                if len(self.pairs_judged) >= MEMO:
                    self.pairs_judged.clear()
                self.pairs_judged[before, s] = free
            if free:
                last[j], done = s, j

    def _unmerged_one(self, last: int, piece: int) -> bool:
        """``_unmerged`` of one pair."""
        row = [int(k) for who in (last, piece) for k in self.spelled[who, :self.letters[who]]]
        left, top = int(self.letters[last]), self.other + 1
        while len(row) > 2:
            found = [self.joins.get(a * top + b) for a, b in zip(row, row[1:])]
            rank, at = min((1 << 40 if k is None else self.rank_of[k], i) for i, k in enumerate(found))
            if rank == 1 << 40 or at == left - 1:
                return False
            row[at:at + 2] = [found[at]]
            left -= at < left
        return row[0] * top + row[1] not in self.joins

    def _spelled_out(self, points: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks back from all ends and puts out ids; fallback arcs put out bytes."""
        ends = np.cumsum(sizes)
        begin, at, who = ends - sizes, ends.copy(), np.arange(len(sizes))
        taken = np.zeros(len(points), bool)
        while len(who):
            size = self.letters[last[at]]
            at = at - size
            taken[at] = True
            go_on = at > begin[who]
            at, who = at[go_on], who[go_on]
        starts = np.flatnonzero(taken)
        unit = np.repeat(np.arange(len(sizes)), sizes)[starts]
        stops = np.r_[starts[1:], len(points)]
        symbol = last[stops]
        ids = self.out[symbol]
        missing = ids < 0
        if not missing.any():
            return ids.astype(np.int32), np.bincount(unit, minlength=len(sizes))
        if self.bytes is None:
            ids = np.where(missing, self.unknown, ids)
            again = np.r_[False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (unit[1:] == unit[:-1])]
            return ids[~again].astype(np.int32), np.bincount(unit[~again], minlength=len(sizes))
        size = np.ones(len(ids), np.int64)
        point = points[starts[missing]]
        size[missing] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        out = np.repeat(ids, size)
        text = "".join(map(chr, point.tolist())).encode("utf-8", "surrogatepass")
        out[np.repeat(missing, size)] = self.bytes[np.frombuffer(text, np.uint8)]
        return out.astype(np.int32), np.bincount(unit, weights=size, minlength=len(sizes)).astype(np.int64)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = f" {text}" if self.prefix else text
        return text.replace(" ", SPACE) if self.escape else text

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        flat, offsets = flat_bytes(pa.array(map(self.normalise, texts), pa.large_string()))
        first = np.zeros(len(flat) + 1, bool)
        first[offsets] = True
        if self.by_mark:
            mark = np.zeros(len(flat), bool)
            for k, b in enumerate(SPACE.encode()):
                mark = (flat == b) if not k else mark & np.r_[flat[k:] == b, np.zeros(min(k, len(flat)), bool)]
            first[3:-1] |= mark[3:] & ~mark[:-3]
        starts = np.flatnonzero(first[:-1])
        edges = np.r_[starts, len(flat)]
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(flat.tobytes())).dictionary_encode()
        ids, counts = self._known(units.dictionary)
        begin, of = np.cumsum(counts) - counts, units.indices.to_numpy()
        sums = np.r_[0, np.cumsum(counts[of])]
        return ids[ranges(begin[of], counts[of])], np.diff(sums[np.searchsorted(starts, offsets)])

    def _known(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct units, from those kept or by their shortest paths."""
        where = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(where < 0)
        if len(self.names) + len(missing) > MEMO or len(self.pool) > 16 * MEMO:  # keeps what this batch needs
            used = where[where >= 0]
            begin = np.cumsum(self.counts) - self.counts
            self.pool, self.counts = self.pool[ranges(begin[used], self.counts[used])], self.counts[used]
            self.names = self.names.take(pa.array(used))
            where[where >= 0] = np.arange(len(used))
        where[missing] = len(self.names) + np.arange(len(missing))
        new = names.take(pa.array(missing))
        size = np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64))
        part = (size - 1) // PIECE + np.arange(len(missing)) // STEPS
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(missing)] if len(missing) else [0]
        found = [self._paths(new.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
        self.names = pa.concat_arrays([self.names, new])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in found)])
        self.counts = np.concatenate([self.counts, *(counts for _, counts in found)])
        begin = np.cumsum(self.counts) - self.counts
        return self.pool[ranges(begin[where], self.counts[where])], self.counts[where]

    @functools.cached_property
    def _texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in self.text], np.int64)
        return np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(lengths) - lengths, lengths

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids, ``counts`` ids each; bytes that are no UTF-8 become U+FFFD."""
        data, starts, lengths = self._texts
        out = data[ranges(starts[ids], lengths[ids])].tobytes()
        ends = np.r_[0, np.cumsum(lengths[ids])][np.r_[0, np.cumsum(counts)]]
        texts = [out[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


_COMPILED: dict[bytes, Transducer] = {}


def compiled(blob: bytes) -> Transducer:
    """One transducer per worker and model."""
    if blob not in _COMPILED:
        _COMPILED[blob] = Transducer(blob)
    return _COMPILED[blob]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file, of fixed size


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column, ids``: the piece ids of every whole text."""
    kind, model = docs.schema[id_column].dataType.simpleString(), _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in slices(batches, "text", PIECE):
            texts = batch.column("text")
            ids, counts = t.encode_all(texts.fill_null("").to_pylist())
            ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), lists], names=[id_column, "ids"])

    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, ids array<int>")


def decode(coded: DataFrame, model_path: str, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``id_column, ids`` with the ``text`` their ids spell."""
    kind, model = coded.schema[id_column].dataType.simpleString(), _model(coded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in batches:
            column = batch.column("ids")
            for a in range(0, len(column), 256):
                part = column.slice(a, 256)
                counts = np.asarray(part.value_lengths().fill_null(0), np.int64)
                texts = t.decode_all(np.asarray(part.flatten(), np.int64), counts)
                texts = pa.array(texts, pa.string(), mask=np.asarray(part.is_null()))
                yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(a, 256), part, texts],
                                                 names=[id_column, "ids", "text"])

    return coded.select(id_column, "ids").mapInArrow(run, f"{id_column} {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column, n_tokens, ids, same``: encoded, decoded from the ids, and compared.

    A text that holds U+2581 itself decodes to a blank there, as in the library.
    """
    kind, model = docs.schema[id_column].dataType.simpleString(), _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in slices(batches, "text", PIECE):
            column = batch.column("text")
            texts = column.fill_null("").to_pylist()
            ids, counts = t.encode_all(texts)
            back = t.decode_all(ids, counts)
            ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
            null = column.is_null()
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=null)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(counts, pa.int64()), lists,
                 pa.array([a == b for a, b in zip(texts, back)])], names=[id_column, "n_tokens", "ids", "same"])

    return docs.select(id_column, "text").mapInArrow(
        run, f"{id_column} {kind}, n_tokens long, ids array<int>, same boolean")
