"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A text's segmentations into the pieces of a given vocabulary are the paths of a lattice; a piece's
probability falls with its rank (Zipf's law: the vocabulary itself brings ranks, not probabilities, and
is not trained). The k segmentations of highest Gumbel-perturbed log probability are a sample without
replacement. They are found by A* over perturbed values: a queue holds sets of paths (a common start, and
pieces that may not follow it), each with the exact maximum of its members' perturbed values, drawn top
down: the start of the search is one Gumbel variable; taking the best set, a path is drawn from it, and
what is left of it falls apart into one set for each place where a path may part from that one, whose
maximum is a Gumbel variable of the set's mass, truncated at the maximum above. Sums over path ends
(the lattice's backward probabilities) make these masses exact, so that the first k paths taken from the
queue are the sample; the next maximum is the threshold that gives their inclusion scores.

Lattices are built per stretch of spaces and letters, which no piece crosses, once for equal stretches,
and kept from batch to batch while there is room (``ROOM`` characters); sums and draws run over all
stretches of a batch of rows at once. A text is treated whole: beside it there are some tens of bytes for
each of its characters (its paths), while its lattices are drawn from piece by piece. Random numbers are
seeded by a row's key, so reruns and other partitionings give the same. Every segmentation is decoded and
compared with its text.

Defined cases: null and empty texts have one segmentation, the empty one; a text with fewer than k
segmentations gives all it has; characters without a piece become bytes, as does U+2581 itself, so that
decoding gives back every text exactly (``round_trip``); rows of one key and text give the same rows;
an empty table gives an empty result; other columns pass through ``sample``, except those named like its
outputs, which it replaces.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procure_spark.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

K, SEED = 2, 2

#: Zipf's law: a piece of rank r weighs 1 / (r + OFFSET) ** POWER; of a byte: this share of the least.
OFFSET, POWER, BYTE_SHARE = 20.0, 1.0, 0.1

#: Characters that are drawn for at once (a longer text is one batch, in several draws); characters of
#: stretches whose lattices are kept.
AT_ONCE, ROOM = 200_000, 1_000_000

SPACE, HELD = 0x2581, 0xDFFF  # a lone surrogate stands for U+2581 of the text: no text holds one

#: A code point has so many bits; shares under this are rounding.
CODE_BITS, LEAST_LEFT = 21, 1e-15

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = np.multiply.accumulate(step)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, *salts: int | np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) of seeds and salts, the same in any batch."""
    x = seed
    for salt in salts:
        x = _mix(x + np.asarray(salt).astype(np.uint64) * GOLDEN + np.uint64(0x632BE59BD9B4E019))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of which a substring's hash follows."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(codes)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _power(pow(_BASE, -1, 2**64), len(sums))[start] + (end - start).astype(np.uint64))


def vocabulary(model: str = MODEL) -> dict:
    """What sampling and decoding need of a model: a fixed number of pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    weight = {i: (r + OFFSET) ** -POWER for r, i in enumerate(ranked)}
    total = sum(weight.values())
    # A trie of all pieces: node 0 is the root; of each other one its piece's id (-1 for a mere start) and probability.
    steps: dict[int, int] = {}
    node_ids, probs = [-1], [0.0]
    for i in plain:
        node = 0
        for c in map(ord, sp.id_to_piece(i)):
            step = node << CODE_BITS | c
            if step not in steps:
                steps[step] = len(node_ids)
                node_ids.append(-1)
                probs.append(0.0)
            node = steps[step]
        node_ids[node], probs[node] = i, weight[i] / total
    # Its steps (node, character) -> node in a hash table with open addresses.
    bits = (4 * len(steps)).bit_length()
    keys, nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
    for step, slot in zip(steps, step_slots(np.array(list(steps), np.int64), bits).tolist(), strict=True):
        while keys[slot] >= 0:
            slot = (slot + 1) & ((1 << bits) - 1)
        keys[slot], nodes[slot] = step, steps[step]
    decoded = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(chr(SPACE), " ").encode() if i in weight else b"" for i in ids]
    lens = np.array([len(x) for x in decoded], np.int64)
    # Two characters that no piece holds next to each other part stretches: numbers of the others' characters, and which meet.
    meet = {(a, b) for i in plain for p in [sp.id_to_piece(i)] for a, b in zip(p, p[1:], strict=False)}
    letters = np.zeros(0x110000, np.uint16)
    letters[[ord(c) for c in sorted({c for pair in meet for c in pair})]] = np.arange(1, len({c for pair in meet for c in pair}) + 1)
    pairs = np.zeros((int(letters.max()) + 1,) * 2, bool)
    for a, b in meet:
        pairs[letters[ord(a)], letters[ord(b)]] = True
    return {
        "letters": letters, "pairs": pairs,
        "keys": keys, "nodes": nodes, "bits": bits, "ids": np.array(node_ids, np.int32), "probs": np.array(probs),
        "longest": max(len(sp.id_to_piece(i)) for i in plain), "byte": min(weight.values()) / total * BYTE_SHARE,
        "bytes": np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32),
        "table": dict(enumerate(decoded)), "blob": np.frombuffer(b"".join(decoded), np.uint8), "lens": lens, "starts": np.cumsum(lens) - lens,
    }


def step_slots(steps: np.ndarray, bits: int) -> np.ndarray:
    return ((steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def utf8_bytes(c: np.ndarray) -> np.ndarray:
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


class Known(dict):
    """Where the places of known stretches begin; -1 for others."""

    def __missing__(self, key: int) -> int:
        return -1


class Lattices:
    """Lattices of stretches, each solved once and kept as long as there is room.

    A stretch's places (its characters) begin at ``known[hash]``; ``node[place]`` numbers them in the order
    in which they were solved. The edges from a node n are ``first[n]`` to ``first[n + 1]``, shorter ones
    first: their sizes, probabilities given that a path comes by (``prob``; ``cum`` sums them up), pieces
    (``code``; -1 - c for character c in bytes) and the nodes that they lead to (-1: the stretch's end)."""

    EDGES = {"size": np.int8, "prob": np.float64, "cum": np.float64, "code": np.int32, "to": np.int32}

    def __init__(self, vocab: dict, room: int = ROOM):
        self.vocab, self.room = vocab, room
        self.node, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)
        for name, kind in self.EDGES.items():
            setattr(self, name, np.empty(0, kind))
        self.clear()

    def clear(self) -> None:
        self.known, self.places, self.edges = Known(), 0, 0
        self.times = getattr(self, "times", 0) + 1  # cleared

    def _fit(self, name: str, n: int) -> np.ndarray:
        held = getattr(self, name)
        if len(held) < n:
            held = np.concatenate([held, np.empty(max(n, 2 * len(held)) - len(held), held.dtype)])
            setattr(self, name, held)
        return held

    def of(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where the places of different stretches begin, until they are cleared."""
        found = np.fromiter(map(self.known.__getitem__, hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        size = (end - start)[new]
        ends = np.cumsum(size)
        if self.places and self.places + int(ends[-1]) > self.room:
            self.clear()
            return self.of(codes, start, end, hashes)
        found[new] = self.places + ends - size
        self.known.update(zip(hashes[new].tolist(), found[new].tolist(), strict=True))
        self._solve(codes[np.repeat(start[new] - (ends - size), size) + np.arange(int(ends[-1]))], size, ends)
        return found

    def _steps(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The trie's nodes after a character each, -1 where there is none."""
        v = self.vocab
        step = node << CODE_BITS | c
        slot = step_slots(step, v["bits"])
        key = v["keys"][slot]
        wrong = np.flatnonzero((key != step) & (key >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(v["keys"]) - 1)
            key[wrong] = v["keys"][slot[wrong]]
            wrong = wrong[(key[wrong] != step[wrong]) & (key[wrong] >= 0)]
        return np.where(key >= 0, v["nodes"][slot], -1)

    def _solve(self, chars: np.ndarray, size: np.ndarray, ends: np.ndarray) -> None:
        """Stretches one after another: their edges, and the edges' probabilities."""
        v, m = self.vocab, len(chars)
        chars = chars.astype(np.int64)
        left = np.repeat(ends, size) - np.arange(m)
        order = np.argsort(left.astype(np.uint16) if int(left.max()) < 1 << 16 else left, kind="stable")
        left, rank = left[order], np.empty(m + 1, np.int64)
        rank[order] = np.arange(m)
        count, found = np.zeros(m, np.int64), []
        alive, node = np.arange(m), np.zeros(m, np.int64)
        for l in range(v["longest"]):  # noqa: E741
            if l:
                on = left[alive] > l
                alive, node = alive[on], node[on]
            if not len(alive):
                break
            c = chars[order[alive] + l]
            node = self._steps(node, c)
            code, prob = v["ids"][node], v["probs"][node]
            piece = (node >= 0) & (code >= 0)
            if l == 0:  # a character without a piece becomes bytes
                c[c == HELD] = SPACE
                code, prob = np.where(piece, code, -1 - c), np.where(piece, prob, v["byte"] ** utf8_bytes(c))
                some = alive
            else:
                some, code, prob = alive[piece], code[piece], prob[piece]
            found.append((some, l + 1, prob, code, count[some]))
            count[some] += 1
            on = node >= 0
            alive, node = alive[on], node[on]
        first = np.concatenate([[0], np.cumsum(count)])
        n = int(first[-1])
        p, sizes, codes, to = np.empty(n), np.empty(n, np.int8), np.empty(n, np.int32), np.empty(n, np.int64)
        for some, l, prob, code, nth in found:  # noqa: E741
            at = first[some] + nth
            p[at], sizes[at], codes[at] = prob, l, code
            to[at] = np.where(left[some] > l, rank[np.minimum(order[some] + l, m)], m)
        # Logarithms of the sums over all ways from a place to its end, the places nearest to theirs first;
        # an edge's share of them is its probability, which is exactly 1 where it is the only one.
        total, own = np.zeros(m + 1), np.repeat(np.arange(m), count)
        bounds = np.searchsorted(left, np.arange(1, int(left[-1]) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            ea, eb = int(first[a]), int(first[b])
            starts, on = first[a:b] - ea, own[ea:eb] - a
            near = total[to[first[a:b]]]
            share = p[ea:eb] * np.exp(total[to[ea:eb]] - near[on])
            acc = np.add.reduceat(share, starts)
            p[ea:eb] = share / acc[on]
            total[a:b] = near + np.log(acc)
        cum = p.copy()
        for nth in range(1, int(count.max())):
            at = first[:-1][count > nth] + nth
            cum[at] += cum[at - 1]
        cum[first[1:] - 1] = np.inf  # the last edge takes what rounding leaves
        places, edges = self.places, self.edges
        self._fit("node", places + m)[places : places + m] = rank[:m] + places
        self._fit("first", places + m + 1)[places : places + m + 1] = first + edges
        for name, x in (("size", sizes), ("prob", p), ("cum", cum), ("code", codes), ("to", np.where(to < m, to + places, -1))):
            self._fit(name, edges + n)[edges : edges + n] = x
        self.places, self.edges = places + m, edges + n

    def walk(self, node: np.ndarray, at: np.ndarray, seed: np.ndarray, size: np.ndarray, prob: np.ndarray, code: np.ndarray) -> None:
        """From each node, which stands for a character ``at`` of the batch, to the end of its stretch:
        writes the drawn edges to where they begin. Seeds make up for where their texts begin."""
        while len(node):
            r = uniform(seed, at)
            edge = self.first[node]
            more = np.flatnonzero(self.cum[edge] <= r)
            r = r[more]
            while len(more):
                edge[more] += 1
                on = self.cum[edge[more]] <= r
                more, r = more[on], r[on]
            drawn = self.size[edge]
            size[at], prob[at], code[at] = drawn, self.prob[edge], self.code[edge]
            node = self.to[edge]
            on = np.flatnonzero(node >= 0)
            node, at, seed = node[on], at[on] + drawn[on], seed[on]


class Batch:
    """Texts as one array of characters, cut into stretches."""

    def __init__(self, texts: list[str], lattices: Lattices):
        self.lattices = lattices
        whole = [code_points(" " + t) if t else np.empty(0, np.uint32) for t in texts]
        self.ends = np.cumsum([len(w) for w in whole]).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        codes = np.concatenate(whole)
        codes[codes == SPACE] = HELD
        codes[codes == 32] = SPACE
        n = len(codes)
        kinds = lattices.vocab["letters"][codes]
        first = np.ones(n, bool)
        np.logical_not(lattices.vocab["pairs"][kinds[:-1], kinds[1:]], out=first[1:])
        first[self.begins[self.ends > self.begins]] = True
        #: Of each stretch, where it starts and ends in the batch, its hash and its text.
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], n) if n else self.start
        self.text = np.searchsorted(self.ends, self.start, "right")
        self.codes = codes
        #: Of each kind of stretch its hash and first one; of each stretch its kind.
        self.hashes, self.first, self.kind = np.unique(_hashes(_sums(codes), self.start, self.end), return_index=True, return_inverse=True)
        #: Where kinds' places begin, as long as the lattices aren't cleared; -1: not asked for yet.
        self.places, self.times = np.full(len(self.hashes), -1), lattices.times

    def nodes(self, stretch: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The lattices' nodes, until the next call, of characters that lie in these stretches."""
        held, kind = self.lattices, self.kind[stretch]
        if self.times != held.times or (self.places[kind] < 0).any():
            asked = np.unique(kind)
            places = held.of(self.codes, self.start[self.first[asked]], self.end[self.first[asked]], self.hashes[asked])
            if self.times != held.times:
                self.places[:], self.times = -1, held.times
            self.places[asked] = places
        return held.node[self.places[kind] + at - self.start[stretch]]

    def stretches(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def walk(self, stretch: np.ndarray, at: np.ndarray, seed: np.ndarray, size: np.ndarray, prob: np.ndarray, code: np.ndarray) -> None:
        """Paths from characters of stretches to the stretches' ends, as many at once as there is room for."""
        sizes = np.cumsum(self.end[stretch] - self.start[stretch])
        a = 0
        while a < len(stretch):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + AT_ONCE, "right")))
            self.lattices.walk(self.nodes(stretch[a:b], at[a:b]), at[a:b], seed[a:b], size, prob, code)
            a = b


def whole_ids(code: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of edges' codes, characters in bytes written out; where each edge's ids begin, and their end."""
    raw = np.flatnonzero(code < 0)
    if not len(raw):
        return code, np.arange(len(code) + 1)
    c = -1 - code[raw].astype(np.int64)
    counts = np.ones(len(code), np.int64)
    counts[raw] = utf8_bytes(c)
    out, ends = np.repeat(code, counts), np.concatenate([[0], np.cumsum(counts)])
    for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        own = counts[raw] == n
        for i in range(n):
            b = (c[own] >> (6 * (n - 1 - i))) & (0x7F if n == 1 else 0x3F if i else 0x1F >> (n - 2))
            out[ends[raw[own]] + i] = byte_ids[b | (0x80 if i else lead)]
    return out, ends


def decoded_bytes(ids: np.ndarray, vocab: dict) -> tuple[bytes, np.ndarray]:
    """Bytes of ids; where each id's begin, and their end."""
    lens = vocab["lens"][ids]
    ends = np.concatenate([[0], np.cumsum(lens)])
    return vocab["blob"][np.repeat(vocab["starts"][ids] - ends[:-1], lens) + np.arange(int(ends[-1]))].tobytes(), ends


def decode_ids(ids, table: dict[int, bytes]) -> str:
    """The text of ids; malformed bytes become U+FFFD. The first piece's leading space is the encoder's."""
    data = b"".join(map(table.__getitem__, ids))
    return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def top_segmentations(texts: list[str], vocab: dict, k: int, seeds: list[int], lattices: Lattices | None = None) -> list[list[tuple[float, float, float, np.ndarray, bool]]]:
    """Of each text its segmentations' (log probability given the text, perturbed, log inclusion score,
    ids, whether these decode to the text), best perturbed first."""
    batch = Batch(texts, lattices or Lattices(vocab))
    begins, ends, n = batch.begins, batch.ends, len(texts)
    seed = _mix(np.array([s & (2**64 - 1) for s in seeds], np.uint64))
    best = -np.log(-np.log(uniform(seed, 2**40)))
    #: Of each text, sets of paths: (-maximum, order, path, edge at which they part from it, sizes that may not follow).
    queues: list[list[tuple[float, int, int, int, tuple[int, ...]]]] = [[(-float(b), 0, -1, 0, ())] for b in best]
    paths: list[list[tuple[np.ndarray, ...]]] = [[] for _ in texts]
    out: list[list[tuple[float, float, np.ndarray, bool]]] = [[] for _ in texts]
    for turn in range(k):
        size, prob, code = np.zeros(int(ends[-1]), np.int8), np.zeros(int(ends[-1])), np.zeros(int(ends[-1]), np.int32)
        taken = {i: heapq.heappop(q) for i, q in enumerate(queues) if q}
        #: Where each text's free part begins: its start, or behind the edge that the set prescribes; what
        #: is left of the choice at that edge.
        free, left_over = np.full(n, np.iinfo(np.int64).max), {}
        free[list(taken)] = begins[list(taken)]
        bound = [i for i, x in taken.items() if x[2] >= 0]
        parted = np.array([paths[i][taken[i][2]][0][taken[i][3]] for i in bound], np.int64)
        held, draws = batch.lattices, uniform(seed[bound], 2**41 + turn)
        for i, at, node, r in zip(bound, parted.tolist(), batch.nodes(batch.stretches(parted), parted).tolist(), draws.tolist(), strict=True):
            _, _, parent, edge, barred = taken[i]
            where, sizes, probs, codes = paths[i][parent]
            size[where[:edge]], prob[where[:edge]], code[where[:edge]] = sizes[:edge], probs[:edge], codes[:edge]
            first, last = int(held.first[node]), int(held.first[node + 1])
            choices, choice = held.size[first:last].tolist(), held.prob[first:last].tolist()
            choice = [0.0 if x in barred else p for x, p in zip(choices, choice, strict=True)]
            r *= sum(choice)
            drawn = max(j for j, p in enumerate(choice) if p)  # where rounding leaves a rest
            for j, p in enumerate(choice[:drawn]):
                r -= p
                if p and r < 0:
                    drawn = j
                    break
            size[at], prob[at], code[at] = choices[drawn], choice[drawn], held.code[first + drawn]
            left_over[i] = sum(choice[:drawn]) + sum(choice[drawn + 1 :])
            free[i] = at + choices[drawn]
        # Whole stretches behind, and rests of the stretches that free parts begin in.
        whole = np.flatnonzero(batch.start >= free[batch.text])
        rest = np.array([free[i] for i in bound if free[i] < ends[i]], np.int64)
        within = batch.stretches(rest)
        inside = rest > batch.start[within]
        stretch, at = np.concatenate([within[inside], whole]), np.concatenate([rest[inside], batch.start[whole]])
        salted = _mix(seed + np.uint64(turn + 1)) - begins.astype(np.uint64) * GOLDEN
        batch.walk(stretch, at, salted[batch.text[stretch]], size, prob, code)
        where = np.flatnonzero(size)
        sizes, probs, codes = size[where], prob[where], code[where]
        bounds = np.searchsorted(where, np.concatenate([begins, ends[-1:]]))
        ids, id_ends = whole_ids(codes, vocab["bytes"])
        data, data_ends = decoded_bytes(ids, vocab)
        logs, left = np.log(probs), 1.0 - probs
        for i, rest_of in left_over.items():
            left[int(bounds[i]) + taken[i][3]] = rest_of
        # Gumbel variables of what parts from the paths at each edge, less the logarithm of the mass before it.
        salted = salted_seed(seed, turn) - begins.astype(np.uint64) * GOLDEN
        some = np.flatnonzero(left > LEAST_LEFT)
        parting = np.full(len(left), -np.inf)
        parting[some] = np.log(left[some] / -np.log(uniform(np.repeat(salted, np.diff(bounds))[some], where[some])))
        for i, (low, _, _, edge, barred) in taken.items():
            a, b, top = int(bounds[i]), int(bounds[i + 1]), -low
            own, own_ids = slice(a, b), slice(int(id_ends[a]), int(id_ends[b]))
            before = np.concatenate([[0.0], np.cumsum(logs[own])])
            same = data[data_ends[own_ids.start] : data_ends[own_ids.stop]] == (" " + texts[i] if texts[i] else "").encode("utf-8", "surrogatepass")
            out[i].append((float(before[-1]), top, ids[own_ids], same))
            paths[i].append((where[own], sizes[own], probs[own], codes[own]))
            if edge >= b - a:
                continue
            # What parts from this path at ``edge`` or later, as far as it was not barred before; truncated at ``top``.
            drawn = before[edge:-1] + parting[a + edge : b]
            most = k - turn
            for j in (np.argpartition(-drawn, most)[:most] if most < len(drawn) else np.arange(len(drawn))).tolist():
                if drawn[j] > -math.inf:
                    e = edge + j
                    heapq.heappush(queues[i], (float(np.logaddexp(-top, -drawn[j])), (turn << 40) + e, turn, e, (*(barred if e == edge else ()), int(sizes[a + e]))))
    thresholds = [-q[0][0] if q else -math.inf for q in queues]
    return [[(p, g, _log_inclusion(p - t), ids, same) for p, g, ids, same in own] for own, t in zip(out, thresholds, strict=True)]


def salted_seed(seed: np.ndarray, turn: int) -> np.ndarray:
    return _mix(seed) + np.uint64(2**42 + turn)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 30:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


OUTPUTS = {"rank": "int", "log_prob": "double", "perturbed": "double", "log_inclusion": "double", "ids": "array<int>", "round_trip": "boolean"}


def sample(df: DataFrame, key_col="doc_id", text_col="text", k: int = K, seed: int = SEED, model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """Up to k rows for each row of df: rank (from 1), log_prob, perturbed, log_inclusion, ids, round_trip."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(model))  # a vocabulary's size is fixed
    rows = df.drop(*OUTPUTS).withColumn("__seed", F.xxhash64(F.lit(seed), F.col(key_col)))
    kept = [c for c in rows.columns if c != "__seed" and (keep_text or c != text_col)]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(c, T._parse_datatype_string(t)) for c, t in OUTPUTS.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = Lattices(vocab.value)
        for b in batches:
            texts = [t or "" for t in b[text_col]]
            ends = np.cumsum([len(t) + 1 for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                drawn = top_segmentations(texts[at:to], vocab.value, k, [int(s) for s in b["__seed"].iloc[at:to]], lattices)
                where, found = [], []
                for i, own in enumerate(drawn, at):
                    found += [(rank, *x) for rank, x in enumerate(own, 1)]
                    where += [i] * len(own)
                yield joined(b, where, found)
                at = to

    def joined(b: pd.DataFrame, where: list[int], found: list) -> pd.DataFrame:
        return pd.concat([b[kept].iloc[where].reset_index(drop=True), pd.DataFrame(found, columns=list(OUTPUTS))], axis=1)

    return rows.mapInPandas(run, schema)


def decode(df: DataFrame, ids_col="ids", text_col="text", model: str = MODEL) -> DataFrame:
    """df with the text of an array of ids; null for null; ids that the vocabulary lacks are left out."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(model)["table"])

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode_ids([i for i in x.tolist() if i in vocab.value], vocab.value))

    return df.withColumn(text_col, texts(F.col(ids_col)))


def op2_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = sample(docs, keep_text=False)
    return drawn.select("doc_id", "rank", "log_prob", "perturbed", "log_inclusion", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
