"""SentencePiece encoding with distinct sampled segmentations, and decoding.

The segmentations of a text are the paths of a lattice of pieces. A path's
probability is the product of its pieces' weights, normalised. The tree of choices
fixes one unit of the text after another (no piece reaches over a unit's
border), and each node of it stands for all paths below. Its key is the greatest
of their Gumbel-perturbed log-probabilities, drawn from the top down: the node's
mass is known from a backward pass over the lattice, and children are drawn
under the condition that the greatest equals their parent's. An A-star walk
that always opens the node with the greatest key emits the k best perturbed
paths, which are k samples without replacement. The next key gives the threshold
from which inclusion scores follow.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.kernels import U64, Chunk, HashTable, RangeHash, ShortHash, chunks, mix64, ranges, row_of, to_list_array, uniform
from quillspark.llm.kernels import BYTE_VALUES as VALUES
from quillspark.llm.runtime import free_name

#: The vocabulary file; any SentencePiece model that takes texts as they are may be named instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Segmentations a text.
SAMPLES = 2

#: Exponent on piece weights: above 1 the samples keep nearer to the likeliest pieces.
SHARPNESS = 1.0

#: Bytes of text, about, whose lattices are searched at once.
_CHUNK = 1 << 18


@dataclass
class Vocabulary:
    """Pieces with a space for U+2581; log weights; the ids of the 256 byte pieces; unk's id."""

    pieces: list[bytes]
    weight: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    prefixed: bool

    @staticmethod
    def load(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
        """A model's vocabulary. Unigram models give log-probabilities; scores that are whole numbers are merge ranks and get the weight 1 / (2 + rank)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, weight, byte_ids = [], np.full(n, -np.inf), np.full(256, model.unk_id())
        scores = np.array([model.get_score(i) for i in range(n)])
        normal = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)])
        ranked = (scores[normal] == np.round(scores[normal])).all()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            pieces.append(piece.replace("▁", " ").encode() if normal[i] else b"")
            if normal[i]:
                weight[i] = sharpness * (-np.log(2 - scores[i]) if ranked else scores[i])
        return Vocabulary(pieces, weight, byte_ids, model.unk_id(), model.encode("a", out_type=str)[0].startswith("▁"))


    def digest(self) -> str:
        return hashlib.sha256(b"\n".join([*self.pieces, self.weight.tobytes(), self.byte_ids.tobytes()])).hexdigest()


class Lattices:
    """What is needed to build lattices: pieces and their prefixes by hash, and byte pairs that no border parts."""

    def __init__(self, v: Vocabulary) -> None:
        self.vocabulary = v
        known: dict[bytes, int] = {}
        joined = np.zeros(65536, dtype=bool)
        for i, p in enumerate(v.pieces):
            for n in range(1, len(p)):
                known.setdefault(p[:n], -1)
                joined[p[n - 1] << 8 | p[n]] = True
            if p:
                known[p] = i
        self.joined = joined
        words = list(known)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        self.table = HashTable(ShortHash(VALUES[data])(starts, ends))
        self.piece = np.array([known[w] for w in words], dtype=np.int32)
        self.weight = v.weight
        self.short, self.pair = np.full(256, -1, dtype=np.int32), np.full(65536, -1, dtype=np.int32)
        for at, w in enumerate(words):
            if len(w) == 1:
                self.short[w[0]] = at
            elif len(w) == 2:
                self.pair[w[0] << 8 | w[1]] = at
        self.longest = max(map(len, words), default=1)
        floor = v.weight[np.isfinite(v.weight)].min() if np.isfinite(v.weight).any() else -1.0
        self.byte_weight = floor - 1.0
        size = np.array([len(p) for p in v.pieces])
        for b, i in enumerate(v.byte_ids):
            if i != v.unknown:
                size[i] = 1
        self.piece_size = size
        flat = [p if p else (bytes([int(np.flatnonzero(v.byte_ids == i)[0])]) if i in set(v.byte_ids.tolist()) and i != v.unknown else b"") for i, p in enumerate(v.pieces)]
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.flat_start = np.concatenate([[0], np.cumsum([len(p) for p in flat])])[:-1]
        self.flat_size = np.array([len(p) for p in flat])


#: Odd, so that a place in a row changes the seed of its draw in every bit.
STEP = U64(0x9E3779B97F4A7C15)


def unit_interval(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each seed."""
    return ((mix64(x) >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0xC0:0xE0] = 2
_CHAR[0xE0:0xF0] = 3
_CHAR[0xF0:] = 4


class Store:
    """Lattices of the distinct units met so far; past its bound it keeps those that were met most often.

    What is drawn doesn't depend on what a store holds, so one serves all tasks of a worker.
    """

    #: Edges, of 28 bytes each.
    BOUND = 2 << 20

    _KINDS = {"first_state": np.int32, "end_state": np.int32, "met": np.int32, "edge0": np.int32, "degree": np.int32, "origin": np.int32, "goal": np.int32, "piece": np.int32, "log_p": np.float64, "cumulative": np.float64}

    def __init__(self, lattices: Lattices) -> None:
        self.lattices = lattices
        self.keys = np.zeros(0, dtype=U64)
        self.places = np.zeros(0, dtype=np.int32)
        self._room = {name: np.zeros(0, dtype=kind) for name, kind in self._KINDS.items()}
        for name, x in self._room.items():
            setattr(self, name, x)

    def _append(self, **new: np.ndarray) -> None:
        for name, x in new.items():
            n = len(getattr(self, name))
            room = self._room[name]
            if n + len(x) > len(room):
                room = np.empty((n + len(x)) * 5 // 4, dtype=room.dtype)
                room[:n] = getattr(self, name)
                self._room[name] = room
            room[n : n + len(x)] = x
            setattr(self, name, room[: n + len(x)])

    def _forget(self) -> None:
        """Half the bound at most stays: the units met most often."""
        states = self.end_state - self.first_state + 1
        edges = np.add.reduceat(self.degree, self.first_state)
        often = np.argsort(-self.met, kind="stable")
        keep = np.sort(often[np.cumsum(edges[often]) <= self.BOUND // 2])
        s = ranges(self.first_state[keep], states[keep])
        e = ranges(self.edge0[self.first_state[keep]], edges[keep])
        new_first = np.cumsum(states[keep]) - states[keep]
        by_edge = np.repeat(new_first - self.first_state[keep], edges[keep])
        held = {"first_state": new_first, "end_state": new_first + states[keep] - 1, "met": self.met[keep] // 2, "edge0": np.cumsum(self.degree[s]) - self.degree[s], "degree": self.degree[s]}
        held |= {"origin": self.origin[e] + by_edge, "goal": self.goal[e] + by_edge, "piece": self.piece[e], "log_p": self.log_p[e], "cumulative": self.cumulative[e]}
        place = np.full(len(states), -1, dtype=np.int32)
        place[keep] = np.arange(len(keep))
        on = place[self.places] >= 0
        self.keys, self.places = self.keys[on], place[self.places[on]]
        for name, x in held.items():
            setattr(self, name, self._room[name][:0])
            self._append(**{name: x})

    def units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The place of each of these distinct units, whose hashes are sorted; new ones are added."""
        if len(self.piece) > self.BOUND:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        out = np.empty(len(keys), dtype=np.int64)
        out[known] = self.places[at[known]]
        if len(new):
            out[new] = len(self.first_state) + np.arange(len(new))
            self._add(data, start[new], end[new])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.places = np.insert(self.places, at[new], out[new].astype(np.int32))
        self.met[out] += 1
        return out

    def _add(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        lat = self.lattices
        size = end - start
        data = text[ranges(start, size)]
        n, units = len(data), len(start)
        base = np.cumsum(size) - size
        first_state = base + np.arange(units)
        end_state = first_state + size
        unit = np.repeat(np.arange(units), size)
        state = np.arange(n) + unit
        last = np.repeat(base + size, size)  # place after the unit's last byte
        head = np.flatnonzero((data & 0xC0) != 0x80)
        left = last[head] - head
        states = n + units
        h = ShortHash(VALUES[data])
        char = np.minimum(_CHAR[data[head]], left)
        single = np.zeros(len(head), dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive = np.arange(len(head))
        for length in range(1, lat.longest + 1):
            alive = alive[left[alive] >= length]
            if not len(alive):
                break
            p = head[alive]
            if length == 1:
                at = lat.short[data[p]]
            elif length == 2:
                at = lat.pair[data[p].astype(np.int64) << 8 | data[p + 1]]
            else:
                at = lat.table.find(h(p, p + length))
            known = at >= 0
            alive, at = alive[known], at[known]
            piece = lat.piece[at]
            whole = piece >= 0
            got = alive[whole]
            found.append((state[head[got]], length, piece[whole]))
            single[got[char[got] == length]] = True
        rest = np.flatnonzero(~single)
        found.append((state[head[rest]], char[rest], np.full(len(rest), -1, np.int32)))
        degree = np.zeros(states, dtype=np.int32)
        for s, _, _ in found:
            degree[s] += 1
        edge0 = np.cumsum(degree) - degree
        fill = edge0.copy()
        edges = int(degree.sum())
        origin, goal, pieces = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32)
        weight = np.empty(edges)
        for s, length, piece in reversed(found):  # long pieces first, as most draws end there
            at = fill[s]
            fill[s] += 1
            origin[at], goal[at], pieces[at] = s, s + length, piece
            weight[at] = np.where(piece >= 0, lat.weight[piece], lat.byte_weight * length)
        # mass of all ways from each state to its unit's end, from the end back
        beta = np.zeros(states)
        log_p = np.empty(edges)
        hs = state[head]
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 65536 else left, kind="stable")
        cut = np.flatnonzero(np.diff(left[order], prepend=0))
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            s = hs[order[a:b]]
            k = degree[s]
            e = ranges(edge0[s], k)
            v = weight[e] + beta[goal[e]]
            begin = np.cumsum(k) - k
            top = np.maximum.reduceat(v, begin)
            total = np.add.reduceat(np.exp(v - np.repeat(top, k)), begin)
            beta[s] = top + np.log(total)
            log_p[e] = v - np.repeat(beta[s], k)
        np.minimum(log_p, 0.0, out=log_p)
        # running sums state by state, so that a state's sums are the same in any company
        cumulative = np.exp(log_p)
        busy = np.flatnonzero(degree > 1)
        step = edge0[busy].astype(np.int64)
        for k in range(1, int(degree.max(initial=0))):
            on = degree[busy] > k
            busy, step = busy[on], step[on]
            cumulative[step + k] += cumulative[step + k - 1]
        cumulative[(edge0 + degree - 1)[degree > 0]] = 2.0
        ns, ne = len(self.edge0), len(self.piece)
        self._append(first_state=first_state + ns, end_state=end_state + ns, met=np.zeros(units, np.int32), edge0=edge0 + ne, degree=degree, origin=origin + ns, goal=goal + ns, piece=pieces, log_p=log_p, cumulative=cumulative)


_STORES: dict[str, Store] = {}


def _store(key: str, vocabulary: Vocabulary) -> Store:
    """A worker's store for a vocabulary that was broadcast, kept from task to task."""
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = Store(Lattices(vocabulary))
    return _STORES[key]


class Batch:
    """The units of a chunk of texts, and the lattices of the distinct ones."""

    def __init__(self, chunk: Chunk, store: Store) -> None:
        self.store, lattices = store, store.lattices
        data, bounds = chunk.data, chunk.bounds
        size = np.diff(bounds)
        extra = (size > 0) & lattices.vocabulary.prefixed
        self.bounds = bounds + np.concatenate([[0], np.cumsum(extra)])
        self.data = np.full(int(self.bounds[-1]), 32, dtype=np.uint8)
        self.data[np.arange(len(data)) + np.repeat(np.cumsum(extra), size)] = data
        d = self.data
        begins = np.zeros(len(d), dtype=bool)
        if len(d):
            pair = d[:-1].astype(np.int64) << 8 | d[1:]
            begins[1:] = ~lattices.joined[pair] & ((d[1:] & 0xC0) != 0x80)
            begins[self.bounds[:-1][size > 0]] = True
        self.start = np.flatnonzero(begins)
        self.row = row_of(self.start, self.bounds)
        self.offset = self.start - self.bounds[self.row]  # in its row
        end = np.append(self.start[1:], len(d))[: len(self.start)]
        h = RangeHash(d)(self.start, end)
        keys, first, unit = np.unique(h, return_index=True, return_inverse=True)
        self.unit = store.units(d, self.start[first], end[first], keys)[unit]
        for name in ("first_state", "end_state", "edge0", "degree", "origin", "goal", "piece", "log_p", "cumulative"):
            setattr(self, name, getattr(store, name))
        self._place = self.start[first], self.unit[first]

    def draw(self, who: np.ndarray, seed: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path through each of the units at places `who`: edges in order, their number, log-probability."""
        unit = self.unit[who]
        state = self.first_state[unit].astype(np.int64)
        end = self.end_state[unit]
        base = mix64(seed ^ U64(stream))[self.row[who]]
        base += (self.offset[who] - state).view(U64) * STEP
        live = np.flatnonzero(state < end)
        state, end, base = state[live], end[live], base[live]
        count = np.zeros(len(who), dtype=np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            e = self.edge0[state].astype(np.int64)
            some = np.flatnonzero(self.degree[state] > 1)
            u = unit_interval(base[some] + state[some].view(U64) * STEP)
            pick = e[some]
            todo = np.flatnonzero(u > self.cumulative[pick])
            while len(todo):
                e[some[todo]] += 1
                todo = todo[u[todo] > self.cumulative[e[some[todo]]]]
            steps.append((live, e))
            count[live] += 1
            state = self.goal[e].astype(np.int64)
            on = np.flatnonzero(state < end)
            live, state, end, base = live[on], state[on], end[on], base[on]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for k, (at, e) in enumerate(steps):
            out[begin[at] + k] = e
        log_p = np.zeros(len(who))
        some = np.flatnonzero(count)
        if len(some):
            log_p[some] = np.add.reduceat(self.log_p[out], begin[some])
        return out, count, log_p

    def draw_other(self, who: int, taken: list[list[int]], seed: int, stream: int) -> tuple[list[int], float, float]:
        """A path through one unit that is none of those taken, by its probability among the rest; and what it leaves untaken."""
        unit = self.unit[who]
        state, end = int(self.first_state[unit]), int(self.end_state[unit])
        shift = int(self.offset[who]) - state
        key = _mix(seed ^ stream)
        ways = [[float(self.log_p[e]) for e in x] for x in taken]
        held = [(x, w, math.fsum(w)) for x, w in zip(taken, ways, strict=True)]
        untaken = 1.0 - math.fsum(math.exp(rest) for _, _, rest in held)
        path: list[int] = []
        total = 0.0
        while state < end:
            e0 = int(self.edge0[state])
            k = int(self.degree[state])
            logs = self.log_p[e0 : e0 + k].tolist()
            free = [math.exp(x) for x in logs]
            n = len(path)
            if held:
                closed = set()
                whole = free.copy()
                for x, _, rest in held:
                    free[x[n] - e0] -= math.exp(rest)
                    if len(x) == n + 1:
                        closed.add(x[n] - e0)
                free = [0.0 if j in closed else max(f, 0.0) for j, f in enumerate(free)]
                if not sum(free) > 0:
                    free = [0.0 if j in closed else f for j, f in enumerate(whole)]
            u = _unit_interval(key + (shift + state) * int(STEP)) * sum(free)
            j = next(j for j in reversed(range(k)) if free[j] > 0)
            for i, f in enumerate(free):
                u -= f
                if u < 0 and f > 0:
                    j = i
                    break
            path.append(e0 + j)
            total += logs[j]
            held = [(x, w, rest - w[n]) for x, w, rest in held if x[n] == e0 + j]
            state = int(self.goal[e0 + j])
        return path, total, untaken - math.exp(total)

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each gives: a character without a piece gives its bytes."""
        piece = self.piece[edges]
        bare = np.flatnonzero(piece < 0)
        count = np.ones(len(edges), dtype=np.int64)
        if not len(bare):
            return piece, count
        count[bare] = self.goal[edges[bare]] - self.origin[edges[bare]]
        out = np.repeat(piece, count)
        at = np.cumsum(count) - count
        # the bytes of a bare character, from the first place of its unit in the chunk
        place = self._byte_of(self.origin[edges[bare]])
        out[ranges(at[bare], count[bare])] = self.store.lattices.vocabulary.byte_ids[self.data[ranges(place, count[bare])]]
        return out, count

    def _byte_of(self, state: np.ndarray) -> np.ndarray:
        """A place in this chunk for states of its units."""
        unit = np.searchsorted(self.first_state, state, side="right") - 1
        start, known = self._place
        order = np.argsort(known)
        return start[order[np.searchsorted(known[order], unit)]] + state - self.first_state[unit]


def _mix(x: int) -> int:
    """mix64 for one number."""
    z = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return z ^ (z >> 31)


def _unit_interval(x: int) -> float:
    """unit_interval for one number."""
    return ((_mix(x & (2**64 - 1)) >> 11) + 0.5) / (1 << 53)


def _truncated(loc: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel draw at loc under the condition that it is at most `most`."""
    return loc - np.logaddexp(loc - most, np.log(-np.log(u)))


@dataclass
class Sampled:
    """Samples of a chunk: row, rank from 1, ids with their number, log-probability, key, inclusion score."""

    row: np.ndarray
    rank: np.ndarray
    ids: np.ndarray
    count: np.ndarray
    log_p: np.ndarray
    key: np.ndarray
    inclusion: np.ndarray


def sample(b: Batch, rows: int, seed: np.ndarray, k: int) -> Sampled:
    """Up to k distinct segmentations of every row that has a text."""
    units = len(b.unit)
    used = np.unique(b.row)
    first = np.searchsorted(b.row, used)
    nrows = len(used)
    nth = np.searchsorted(used, b.row)
    own = seed[used]
    gumbel = lambda stream: -np.log(-np.log(uniform(own ^ U64(stream), 1 << 40)))
    counter = b.offset
    pool, count, log_p = b.draw(np.arange(units), seed, 1)
    pointer = np.cumsum(count) - count
    pools, held = [pool], len(pool)
    paths = [(pointer, count, log_p)]
    key = [gumbel(3)]
    alive = [np.ones(nrows, dtype=bool)]

    def before(log_p: np.ndarray) -> np.ndarray:
        run = np.cumsum(log_p) - log_p
        return run - run[first][nth]

    def spare(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(x > -1e-12, -np.inf, np.log(-np.expm1(np.minimum(x, 0.0))))

    noise = unit_interval(mix64(own ^ U64(7))[nth] + counter.view(U64) * STEP)
    fringe = [_truncated(before(log_p) + spare(log_p), key[0][nth], noise)]
    fringe[0][~np.isfinite(fringe[0])] = -np.inf
    taken: dict[tuple[int, int], list[list[int]]] = {}
    totals = [np.add.reduceat(log_p, first)] if nrows else [np.zeros(0)]
    bar = np.full(nrows, -np.inf)
    for rank in range(2, k + 2):
        if not nrows:
            break
        stack = np.stack(fringe)
        best_of = stack.argmax(axis=0)
        best = stack[best_of, np.arange(units)]
        top = np.maximum.reduceat(best, first)
        if rank == k + 1:
            bar = top
            break
        go = np.isfinite(top)
        hit = np.flatnonzero(best == top[nth])
        hit = hit[np.unique(nth[hit], return_index=True)[1]]
        at = np.full(nrows, -1, dtype=np.int64)
        at[nth[hit]] = hit
        at[~go] = units  # nothing of these rows changes
        parent = np.zeros(nrows, dtype=np.int64)
        parent[go] = best_of[at[go]]
        source = parent[nth]
        place = np.arange(units)
        pointer = np.stack([p[0] for p in paths])[source, place]
        count = np.stack([p[1] for p in paths])[source, place]
        log_p = np.stack([p[2] for p in paths])[source, place]
        fresh = np.flatnonzero(place > at[nth])
        pool, n, lp = b.draw(fresh, seed, 10 + rank)
        pointer[fresh], count[fresh], log_p[fresh] = held + np.cumsum(n) - n, n, lp
        pools.append(pool)
        held += len(pool)
        whole = np.concatenate(pools)
        extra: list[int] = []
        branched = np.full(units, -np.inf)
        fringe_new = np.full(units, -np.inf)
        for r in np.flatnonzero(go).tolist():
            u, q = int(at[r]), int(parent[r])
            known = taken.get((u, q))
            if known is None:
                a = int(paths[q][0][u])
                known = taken[u, q] = [whole[a : a + int(paths[q][1][u])].tolist()]
            path, total, left = b.draw_other(u, known, int(own[r]), 10 + rank)
            known.append(path)
            pointer[u], count[u], log_p[u] = held + len(extra), len(path), total
            extra += path
            branched[u] = math.log(left) if left > 1e-12 else -np.inf
        pools.append(np.array(extra, dtype=np.int64))
        held += len(extra)
        lead = before(log_p)
        open_ = np.flatnonzero(np.isfinite(branched))
        moved = at[go]
        noise = unit_interval(mix64(own ^ U64(7 + rank))[nth] + counter.view(U64) * STEP)
        for u in moved.tolist():
            fringe[int(parent[nth[u]])][u] = -np.inf
        again = _truncated(lead[open_] + branched[open_], top[nth[open_]], noise[open_])
        for u, x in zip(open_.tolist(), again.tolist(), strict=True):
            fringe[int(parent[nth[u]])][u] = x
        if len(fresh):
            new = _truncated(lead[fresh] + spare(log_p[fresh]), top[nth[fresh]], noise[fresh])
            fringe_new[fresh] = np.where(np.isfinite(new), new, -np.inf)
        fringe.append(fringe_new)
        paths.append((pointer, count, log_p))
        key.append(top)
        alive.append(go)
        totals.append(np.add.reduceat(log_p, first))
    whole = np.concatenate(pools)
    out: list[list[np.ndarray]] = []
    for rank, ((pointer, count, _), top, live, total) in enumerate(zip(paths, key, alive, totals, strict=True), 1):
        on = np.flatnonzero(live[nth]) if nrows else np.zeros(0, np.int64)
        edges = whole[ranges(pointer[on], count[on])]
        ids, size = b.ids(edges)
        per_row = np.bincount(np.repeat(nth[on], count[on]), weights=size, minlength=nrows).astype(np.int64)[live]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(total - bar))
        out.append([used[live], np.full(int(live.sum()), rank), ids, per_row, total[live], top[live], np.where(np.isfinite(bar), inclusion, 1.0)[live]])
    return Sampled(*(np.concatenate(x) for x in zip(*out, strict=True)))


def decode_rows(ids: np.ndarray, count: np.ndarray, lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that runs of ids stand for, dummy prefix included, and the bounds of each run's."""
    size = lattices.flat_size[ids]
    data = lattices.flat[ranges(lattices.flat_start[ids], size)]
    total = np.concatenate([[0], np.cumsum(size)])
    return data, total[np.concatenate([[0], np.cumsum(count)])]


def _plain(texts: pa.Array) -> pa.Array:
    """U+2581 is the vocabulary's own sign for a space and is read as one."""
    return pa.compute.replace_substring(texts, "▁", " ")


def sampled_segmentations(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, ids, log_prob, key, inclusion, decodes): up to `samples` distinct segmentations of every text, best key first.

    log_prob is the segmentation's normalised log-probability, key its perturbed
    value, inclusion the chance that its key passes the next one after the last
    sample (1 if there is none), so that exp(log_prob) / inclusion are weights
    for estimates; decodes tells whether the ids give the text back. The three
    numbers are rounded to 6 decimals. A text with fewer segmentations has fewer
    rows, as has one whose other segmentations in a unit hold less than 1e-12 of
    the probability, which double precision can't tell from none; a null or empty text has one row of no
    ids, log_prob 0 and inclusion 1 (a null one as null ids, decodes null).
    Draws depend on seed and id alone, so repeated rows give equal rows, and
    null ids share their draws. An id column with the name of a result's gets "_" after it. Other
    columns are ignored. An empty table gives no rows. A text with U+2581 decodes to spaces there, decodes false.
    """
    import pyarrow.compute  # noqa: F401

    vocabulary = Vocabulary.load(model, sharpness)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the model's file
    key = vocabulary.digest()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute

        store = _store(key, shared.value)
        for batch in batches:
            texts = batch.column(2)
            plain = _plain(texts)
            same = pyarrow.compute.fill_null(pyarrow.compute.equal(plain, texts), True).to_numpy(zero_copy_only=False).astype(bool)
            seeds = mix64(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            for c in chunks(plain, _CHUNK):
                b = Batch(c, store)
                s = sample(b, c.rows, seeds[c.lo : c.hi], samples)
                data, at = decode_rows(s.ids, s.count, store.lattices)
                good = np.diff(at) == np.diff(b.bounds)[s.row]
                if good.all():
                    expected = b.data[ranges(b.bounds[s.row], np.diff(b.bounds)[s.row])]
                    wrong = np.flatnonzero(expected != data)
                    good[np.unique(np.searchsorted(at, wrong, side="right") - 1)] = False
                good &= same[c.lo + s.row]
                bare = np.flatnonzero(np.diff(c.bounds) == 0)
                row = np.concatenate([s.row, bare])
                lists = to_list_array(s.ids.astype(np.int32), np.concatenate([s.count, np.zeros(len(bare), np.int64)]), pa.int32())
                none = np.concatenate([np.zeros(len(s.row), bool), ~c.valid[bare]])
                if none.any():
                    lists = pyarrow.compute.if_else(pa.array(none), pa.scalar(None, lists.type), lists)
                pad = np.zeros(len(bare))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(c.lo + row)),
                        pa.array(np.concatenate([s.rank, pad + 1]).astype(np.int32)),
                        lists,
                        pa.array(np.concatenate([np.round(s.log_p, 6), pad])),
                        pa.array(np.concatenate([np.round(s.key, 6), pad])),
                        pa.array(np.concatenate([np.round(s.inclusion, 6), pad + 1])),
                        pa.array(np.concatenate([good, pad == 0]), mask=none),
                    ],
                    names=["_id", "rank", "ids", "log_prob", "key", "inclusion", "decodes"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("_seed"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, f"_id {kind}, rank int, ids array<int>, log_prob double, key double, inclusion double, decodes boolean")
    return out.withColumnRenamed("_id", free_name(id_col, "rank", "ids", "log_prob", "key", "inclusion", "decodes"))


def decoder(model: str = MODEL) -> Column:
    """An Arrow function from arrays of ids to texts; ids outside the vocabulary and control pieces give nothing, null gives null."""
    vocabulary = Vocabulary.load(model)
    key = vocabulary.digest()

    def run(ids: pa.Array) -> pa.Array:
        lattices = _store(key, vocabulary).lattices
        out = []
        for x in ids.to_pylist():
            if x is None:
                out.append(None)
                continue
            a = np.array([i for i in x if i is not None and 0 <= i < len(vocabulary.pieces)], dtype=np.int64)
            data, _ = decode_rows(a, np.array([len(a)]), lattices)
            text = data.tobytes().decode("utf-8", "replace")
            out.append(text[1:] if vocabulary.prefixed and text.startswith(" ") else text)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR)


def encoder(model: str = MODEL) -> Column:
    """An Arrow function from texts to the ids of the model's own segmentation; null gives null."""
    import sentencepiece

    proto = sentencepiece.SentencePieceProcessor(model_file=model).serialized_model_proto()

    def run(texts: pa.Array) -> pa.Array:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        return pa.array([None if t is None else p.encode(t, num_threads=1) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>", F.ArrowUDFType.SCALAR)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
