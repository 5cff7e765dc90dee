"""SentencePiece segmentations sampled without replacement, and decoding.

A text is a lattice of vocabulary pieces. Its words (a blank and what follows; long ones cut every ``MAX_UNIT`` characters)
are independent parts of it, and each distinct word's part is built once for a block of texts: edges by a walk down the
piece trie, backward sums, and from them for each node the probabilities of its edges.

Gumbel top-k by perturbed A-star search over the tree of prefixes: the root's perturbed maximum is a Gumbel variable; a
node's maximum is that of one child, drawn by its probability, and the maximum of all its other children together is a
Gumbel variable truncated at the node's, which bounds what is below them. The search follows the best child to a leaf, which
is the first sample, and then takes up the set of children with the highest bound, until it has ``samples`` leaves. They are
distinct, and distributed as draws without replacement. Bounds that can't be highest any more, however they are drawn, are
not drawn (``_WEAKEST``). The best bound left over is the threshold of the inclusion probabilities.

All random numbers follow from the row's key, the sample and the place in the text, so they do not depend on how rows are
dealt to tasks. The vocabulary is a given model; its pieces have the Zipf probabilities of their merge ranks, as the model
itself has ranks only. Characters without a piece are written as the model's byte pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import text_hash
from riskframe.llm.textvec import blocks, mix, span_hashes

MAX_UNIT = 64
BLOCK = 768 << 10  # larger ones find more equal words but leave the processor's caches
BLANK_MARK = 0x2581
_LITERAL_MARK = 0x110000  # a blank mark that is part of the text
_SCALE = 5.0  # logarithm by which each character's weight is raised, against underflow
_WEAKEST = 45.0
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


class Vocabulary:
    """Trie, log probabilities and bytes of a model's pieces."""

    _loaded: dict[str, Vocabulary] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i) for i in range(size)]
        texts = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes: list[bytes] = []
        usable = []
        for i, text in enumerate(texts):
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            else:
                self.bytes.append(b"" if special[i] else text.replace(chr(BLANK_MARK), " ").encode())
                if not special[i] and chr(BLANK_MARK) not in text[1:]:
                    usable.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        ranked = sorted(usable, key=lambda i: (-model.get_score(i), i))
        total = sum(1.0 / r for r in range(1, len(ranked) + 1))
        self.log_p = np.full(size, -math.inf)
        self.log_p[ranked] = -np.log(np.arange(1, len(ranked) + 1)) - math.log(total)
        self.log_byte = float(self.log_p[ranked[-1]])
        self.chars = np.array(sorted({ord(c) for i in usable for c in texts[i]}), np.int64)
        symbol = {int(c): k for k, c in enumerate(self.chars)}
        children: dict[int, int] = {}
        ends = [-1]
        for i in usable:
            node = 0
            for c in texts[i]:
                key = node << 16 | symbol[ord(c)]
                if key not in children:
                    children[key] = len(ends)
                    ends.append(-1)
                node = children[key]
            ends[node] = i
        self.steps = Steps(np.array(list(children), np.int64), np.array(list(children.values()), np.int32))
        self.piece = np.array(ends, np.int32)
        self.root = np.full(len(self.chars) + 1, -1, np.int32)  # the last for characters of no piece
        for key, node in children.items():
            if key >> 16 == 0:
                self.root[key] = node
        self.longest = max(len(texts[i]) for i in usable)
        self.weight = np.exp(self.log_p + _SCALE * np.array([len(x) for x in texts]))
        self.n_bytes = np.array([len(x) for x in self.bytes], np.int64)
        self.from_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; ids of no piece give nothing."""
        known = [i for i in ids if 0 <= i < len(self.bytes)]
        return b"".join(map(self.bytes.__getitem__, known)).decode("utf-8", "replace")[1:]

    def gives(self, ids: np.ndarray, text: np.ndarray) -> bool:
        """Whether the known ids decode to the UTF-8 text, a blank before it."""
        sizes = self.n_bytes[ids]
        total = int(sizes.sum())
        if total != (len(text) + 1 if len(text) else 0):
            return False
        at = np.repeat(self.from_byte[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return np.array_equal(self.flat[at[1:]], text)


class Steps:
    """Children in the piece trie by (node, symbol), in a hashed table with open places."""

    def __init__(self, keys: np.ndarray, child: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at = self._place(keys)
        while len(keys):
            open_ = np.flatnonzero(self.keys[at] < 0)
            slots, lead = np.unique(at[open_], return_index=True)
            taken = open_[lead]
            self.keys[slots], self.child[slots] = keys[taken], child[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, child, at = keys[left], child[left], at[left] + 1 & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _A >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that have a child, and the children."""
        at = self._place(keys)
        held = self.keys[at]
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            at[other] = at[other] + 1 & self.mask
            held[other] = self.keys[at[other]]
            other = other[(held[other] != keys[other]) & (held[other] >= 0)]
        hit = np.flatnonzero(held == keys)
        return hit, self.child[at[hit]]


class Lattice:
    """The parts of a block's distinct words. Nodes are characters and each word's end; a node's edges are consecutive."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray) -> None:
        n = len(codes)
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        ends = np.cumsum(lengths).astype(np.int32)
        end = ends[word]
        self.start = ends - lengths + np.arange(len(lengths))  # node of each word's first character
        at = np.minimum(np.searchsorted(vocabulary.chars, codes), len(vocabulary.chars) - 1)
        symbol = np.where(vocabulary.chars[at] == codes, at, len(vocabulary.chars))
        place, state = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        found = []
        for length in range(1, vocabulary.longest + 1):
            if length == 1:
                state = vocabulary.root[symbol]
                hit = state >= 0
                place, state = place[hit], state[hit]
            else:
                key = state.astype(np.int64) << 16 | symbol[place + length - 1]
                hit, state = vocabulary.steps.find(key)
                place = place[hit]
            piece = vocabulary.piece[state]
            done = piece >= 0
            if length == 1:
                lone = np.ones(n, bool)
                lone[place[done]] = False
                lone = np.flatnonzero(lone).astype(np.int32)
                found.append((lone, length, np.full(len(lone), -1, np.int32)))
            found.append((place[done], length, piece[done]))
            more = place + length < end[place]
            place, state = place[more], state[more]
            if not len(place):
                break
        edges = sum(len(p) for p, _, _ in found)
        count = np.zeros(n, np.int64)
        for p, _, _ in found:
            count[p] += 1
        offset = np.cumsum(count) - count
        source = np.repeat(np.arange(n, dtype=np.int32), count)
        self.target, self.piece = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for p, length, piece in found:
            slot = offset[p]
            self.target[slot] = p + length + word[p]
            self.piece[slot] = piece
            offset[p] += 1
        self.source = source + word[source]
        self.width = np.ones(edges, np.int32)  # ids that the edge stands for
        weight = vocabulary.weight[self.piece]
        lone = np.flatnonzero(self.piece < 0)
        code = codes[source[lone]]
        size = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where((code < 0x10000) | (code == _LITERAL_MARK), 3, 4)))
        self.width[lone] = size
        self.code = dict(zip(lone.tolist(), code.tolist(), strict=True))
        weight[lone] = np.exp(size * vocabulary.log_byte + _SCALE)

        nodes = n + len(lengths)
        self.last = np.zeros(nodes, bool)
        self.last[ends + np.arange(len(lengths))] = True
        behind = np.zeros(nodes)
        behind[self.last] = 1.0
        left = (end[source] - source).astype(np.uint8)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, MAX_UNIT + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi > lo:
                own = order[lo:hi]
                src = self.source[own]
                begins = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
                behind[src[begins]] = np.add.reduceat(weight[own] * behind[self.target[own]], begins)
        share = weight * behind[self.target] / behind[self.source]
        self.share = share
        self.first = np.zeros(nodes + 1, np.int64)
        per_node = np.bincount(self.source, minlength=nodes)
        self.first[1:] = np.cumsum(per_node)
        total = np.cumsum(share)
        before = np.concatenate([[0.0], total])[self.first[self.source]]
        self.upto = total - before
        self.upto[self.first[1:][per_node > 0] - 1] = 2.0


def _uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1) from 64-bit keys."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _stream(seed: np.ndarray, sample: int, kind: int) -> np.ndarray:
    return mix(seed + np.uint64((4 * sample + kind) * int(_A) & 0xFFFFFFFFFFFFFFFF))


def _drawn(seed: np.ndarray, sample: int, place: np.ndarray, kind: int) -> np.ndarray:
    return _uniform(_stream(seed, sample, kind) ^ (place.astype(np.uint64) * _B))


def _walk(lattice: Lattice, node: np.ndarray, seed: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws edges from each given node to its word's end; ``place`` is the node's place in its text. All edges, walk by
    walk, and the walks' lengths."""
    walk = np.flatnonzero(~lattice.last[node])
    node, stream, place, steps = node[walk], _stream(seed[walk], sample, 0), place[walk], []
    lengths = np.zeros(walk[-1] + 1 if len(walk) else 0, np.int64)
    total = len(lengths)
    while len(walk):
        u = _uniform(stream ^ (place.astype(np.uint64) * _B))
        edge = lattice.first[node]
        over = np.flatnonzero(u >= lattice.upto[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= lattice.upto[edge[over]]]
        steps.append((walk, edge))
        lengths[walk] += 1
        target = lattice.target[edge]
        place = place + (target - node)
        go = ~lattice.last[target]
        walk, node, stream, place = walk[go], target[go], stream[go], place[go]
    offset = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.int64)
    for step, (walk, edge) in enumerate(steps):
        out[offset[walk] + step] = edge
    return out, np.concatenate([lengths, np.zeros(0, np.int64)])[:total]


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at ``location``, given that it is below ``bound``."""
    return location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(u))


class Block:
    """The search over the texts of one block."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> None:
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        self.rows = len(offsets) - 1
        some = np.diff(chars) > 0
        shift = np.concatenate([[0], np.cumsum(some)])
        line = np.empty(len(codes) + int(shift[-1]), np.int64)
        marks = (chars[:-1] + shift[:-1])[some]
        inside = np.ones(len(line), bool)
        inside[marks] = False
        line[inside] = np.where(codes == BLANK_MARK, _LITERAL_MARK, np.where(codes == 32, BLANK_MARK, codes))
        line[marks] = BLANK_MARK
        begins = line == BLANK_MARK
        begun = np.maximum.accumulate(np.where(begins, np.arange(len(line)), 0)) if len(line) else np.zeros(0, np.int64)
        begins |= (np.arange(len(line)) - begun) % MAX_UNIT == 0
        self.unit = np.flatnonzero(begins)
        lengths = np.diff(np.concatenate([self.unit, [len(line)]]))
        text_at = chars + shift
        self.units = np.searchsorted(self.unit, text_at)  # per text the range of its words
        text = np.repeat(np.arange(self.rows), np.diff(self.units))
        _, lead, self.distinct = np.unique(span_hashes(line, lengths), return_index=True, return_inverse=True)
        taken = lengths[lead]
        spans = np.repeat(self.unit[lead] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
        self.lattice = Lattice(vocabulary, line[spans], taken)
        self.seed = mix(seeds)
        self.unit_seed = self.seed[text]
        self.unit_place = self.unit - text_at[:-1][text]
        self.node = self.lattice.start[self.distinct]

    def first_paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges of every text's first sample, and the texts' bounds."""
        edges, lengths = _walk(self.lattice, self.node, self.unit_seed, self.unit_place, 0)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        self.per_unit = lengths
        return edges, upto[self.units]

    def sampled(self, samples: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """Per text up to ``samples`` of (edges, log probability, perturbed value), and last the threshold in place of one."""
        lattice, self.samples = self.lattice, samples
        edges, bounds = self.first_paths()
        unit_of = np.repeat(np.arange(len(self.unit)), self.per_unit)
        texts = np.arange(self.rows)
        top = -np.log(-np.log(_drawn(self.seed, 0, np.zeros(self.rows, np.int64), 1)))
        out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
        # Agenda per text: bound, sample it hangs off, place on that sample's path, log probability above, edges taken there.
        agenda: list[list[tuple[float, int, int, float, tuple[int, ...]]]] = [[] for _ in texts]
        paths: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        self._enter(edges, unit_of, bounds, np.zeros(self.rows, np.int64), np.zeros(self.rows), top, texts, 0, out, agenda, paths)
        for sample in range(1, samples):
            heads, nodes, starts, seeds, places, owners = [], [], [], [], [], []
            for t in texts.tolist():
                if not agenda[t]:
                    continue
                best = max(range(len(agenda[t])), key=lambda i: agenda[t][i][0])
                bound, of, at, above, taken = agenda[t].pop(best)
                path, units = paths[t][of]
                source = int(lattice.source[path[at]])
                lo, hi = int(lattice.first[source]), int(lattice.first[source + 1])
                rest = [e for e in range(lo, hi) if e not in taken]
                weights = lattice.share[rest]
                u = float(_drawn(self.seed[t : t + 1], sample, np.array([at]), 2)[0]) * weights.sum()
                chosen = rest[min(int(np.searchsorted(np.cumsum(weights), u, "right")), len(rest) - 1)]
                left = [e for e in rest if e != chosen]
                mass = float(lattice.share[left].sum()) if left else 0.0
                if mass > 0:
                    u = _drawn(self.seed[t : t + 1], sample, np.array([at]), 3)
                    value = _truncated(np.array([above + math.log(mass)]), np.array([bound]), u)[0]
                    agenda[t].append((float(value), of, at, above, (*taken, chosen)))
                unit = int(units[at])
                target = int(lattice.target[chosen])
                after = np.arange(unit + 1, self.units[t + 1])
                heads.append((t, path[:at], chosen, units[:at], unit, at + 1, above + math.log(lattice.share[chosen]), bound, len(after) + 1))
                nodes.append(np.concatenate([[target], self.node[after]]))
                starts.append(np.concatenate([[unit], after]))
                seeds.append(np.full(len(after) + 1, self.seed[t]))
                places.append(np.concatenate([[self.unit_place[unit] + target - int(self.node[unit])], self.unit_place[after]]))
                owners.append(t)
            if not heads:
                break
            node, unit = np.concatenate(nodes), np.concatenate(starts)
            found, lengths = _walk(lattice, node, np.concatenate(seeds), np.concatenate(places), sample)
            lengths = np.concatenate([lengths, np.zeros(len(node) - len(lengths), np.int64)])
            units = np.repeat(unit, lengths)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            whole, whole_units, sizes, walked = [], [], [], 0
            for t, head, chosen, head_units, unit_at, _, _, _, walks in heads:
                lo, hi = upto[walked], upto[walked + walks]
                walked += walks
                whole += [head, [chosen], found[lo:hi]]
                whole_units += [head_units, [unit_at], units[lo:hi]]
                sizes.append(len(head) + 1 + hi - lo)
            begin = np.array([h[5] for h in heads])
            self._enter(
                np.concatenate(whole).astype(np.int64), np.concatenate(whole_units).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]),
                begin, np.array([h[6] for h in heads]), np.array([h[7] for h in heads]), np.array(owners), sample, out, agenda, paths,
            )
        for t in texts.tolist():
            out[t].append((np.zeros(0, np.int64), 0.0, max((x[0] for x in agenda[t]), default=-math.inf)))
        return out

    def _enter(self, edges, unit_of, bounds, begin, above, value, texts, sample, out, agenda, paths) -> None:
        """Takes up one sample of each given text: its path, and the bounds of what branches off from ``begin`` on."""
        lattice = self.lattice
        share = lattice.share[edges]
        total = np.concatenate([[0.0], np.cumsum(np.log(share))])
        ends, origin = bounds[1:], total[bounds[:-1]]
        first = bounds[:-1] + begin
        keep = self.samples - sample  # more can't be taken up any more, the threshold included
        for weakest in (_WEAKEST, math.inf):
            # What lies above falls along a path, so the places in question are the first ones of each.
            upto = ends if weakest == math.inf else np.clip(np.searchsorted(-total, weakest - origin, "right"), first, ends)
            taken = upto - first
            owner = np.repeat(np.arange(len(texts)), taken)
            pick = np.arange(len(owner)) + np.repeat(first - (np.cumsum(taken) - taken), taken)
            rest = 1.0 - share[pick]
            pick, owner, rest = (x[rest > 1e-12] for x in (pick, owner, rest))
            prefix = total[pick] - origin[owner]
            place = pick - bounds[:-1][owner]
            location = prefix + np.log(rest)
            u = _drawn(self.seed[texts[owner]], sample, place + 1, 1)
            drawn = _truncated(location, value[owner], u)
            order = np.lexsort((-drawn, owner))
            have = np.bincount(owner, minlength=len(texts))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(have) - have, have)
            order = order[rank < keep]
            drawn, owner, place, prefix = drawn[order], owner[order], place[order], prefix[order]
            # No draw lies more than 37 above its location. What is left out is below the last one kept, if that is above this.
            have = np.minimum(have, keep)
            least = np.full(len(texts), -math.inf)
            full = have == keep
            least[full] = drawn[np.cumsum(have)[full] - 1]
            if not ((upto < ends) & (least < 37 - weakest)).any():
                break
        for i, t in enumerate(texts.tolist()):
            own = edges[bounds[i] : bounds[i + 1]]
            out[t].append((own, float(total[bounds[i + 1]] - total[bounds[i]]), float(value[i])))
            paths[t].append((own, unit_of[bounds[i] : bounds[i + 1]]))
        for i, at, bound, high in zip(owner.tolist(), place.tolist(), drawn.tolist(), prefix.tolist(), strict=True):
            agenda[int(texts[i])].append((bound, sample, at, high, (int(edges[bounds[i] + at]),)))

    def ids(self, vocabulary: Vocabulary, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the edges, and how many each stands for."""
        lattice = self.lattice
        width = lattice.width[edges]
        out = np.repeat(lattice.piece[edges], width)
        fallback = np.flatnonzero(lattice.piece[edges] < 0)
        if len(fallback):
            begin = np.cumsum(width) - width
            for i in fallback.tolist():
                code = lattice.code[int(edges[i])]
                raw = chr(BLANK_MARK if code == _LITERAL_MARK else code).encode("utf-8", "surrogatepass")
                out[begin[i] : begin[i] + len(raw)] = vocabulary.byte_ids[list(raw)]
        return out, width


RESULT_SCHEMA = (
    "doc_id long, _th long, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
)


def _log_inclusion(log_prob: float, threshold: float) -> float:
    """Logarithm of the probability that a sample's perturbed value is above the threshold."""
    if threshold == -math.inf:
        return 0.0
    gap = log_prob - threshold
    return gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 700.0))))


def _encoded(path: str, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            keys = batch.column("_seed").to_numpy().view(np.uint64)
            for lo, hi, data, offsets in blocks(batch.column("_text"), BLOCK):
                block = Block(vocabulary, data, offsets, keys[lo:hi])
                rows, numbers, ids, facts = [], [], [], []
                size = 0
                for t, found in enumerate(block.sampled(samples)):
                    text = data[offsets[t] : offsets[t + 1]]
                    for sample, (edges, log_prob, value) in enumerate(found[:-1]):
                        own, _ = block.ids(vocabulary, edges)
                        rows.append(lo + t)
                        numbers.append(sample + 1)
                        ids.append(own.astype(np.int32))
                        facts.append((round(log_prob, 6), round(value, 6), round(_log_inclusion(log_prob, found[-1][2]), 6), vocabulary.gives(own, text)))
                        size += len(own)
                    if size > 1 << 19:
                        yield _rows(batch, rows, numbers, ids, facts)
                        rows, numbers, ids, facts, size = [], [], [], [], 0
                if rows:
                    yield _rows(batch, rows, numbers, ids, facts)

    return run


def _rows(batch: pa.RecordBatch, rows: list[int], numbers: list[int], ids: list[np.ndarray], facts: list[tuple]) -> pa.RecordBatch:
    at = pa.array(rows)
    sizes = np.array([len(x) for x in ids])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(at),
            batch.column("_th").take(at),
            pa.array(numbers, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
            pa.array(sizes.astype(np.int64)),
            *(pa.array(x, pa.float64()) for x in list(zip(*facts, strict=True))[:3]),
            pa.array([x[3] for x in facts], pa.bool_()),
        ],
        ["doc_id", "_th", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"],
    )


def encode_samples(docs: DataFrame, model_path: str, samples: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Up to ``samples`` distinct segmentations a document, a row each: doc_id, _th, sample (from 1), ids, n_pieces, log_prob,
    perturbed, log_inclusion, round_trip.

    ``log_prob`` is the segmentation's share among all of the text's, ``perturbed`` its Gumbel value (falling with the
    sample), ``log_inclusion`` the logarithm of its probability to be among the samples given the threshold, and
    ``round_trip`` tells that decoding gives the text. A text with fewer segmentations has fewer rows. Seeds come from the
    id and the text, so repeated rows are sampled alike, and a null id is a seed as well. Null and empty texts have one
    segmentation, without pieces. Other columns are not read; an empty table gives no rows.
    """
    named = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_hash(text_column).alias("_th"),
        F.xxhash64(F.col(id_column).cast("long"), text_column).alias("_seed"), F.col(text_column).alias("_text"),
    )
    return named.mapInArrow(_encoded(model_path, samples), RESULT_SCHEMA)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column("ids").to_pylist()]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return run


def decode_ids(rows: DataFrame, model_path: str) -> DataFrame:
    """The rows with the text of their ``ids`` as column ``decoded``; null ids give null, no ids the empty text."""
    return rows.mapInArrow(_decoded(model_path), rows.drop("decoded").schema.add("decoded", "string"))
