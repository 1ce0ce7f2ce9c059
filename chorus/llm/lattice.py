"""Sampled segmentations without replacement over a SentencePiece lattice, and decoding.

The lattice of a text holds every way to tile it with pieces of the vocabulary (a character
without a piece of its own is its UTF-8 byte pieces).  A piece of rank r scores
``-log(r + ZIPF)``, and a segmentation's probability is proportional to the exponential of
its summed scores.  Summing backwards makes the lattice a tree of choices, and a search over
partial segmentations ordered by perturbed log-probability returns, one after the other, the
k segmentations with the largest perturbed log-probability: the first complete one below
the root's Gumbel value, then the best branch that was left aside, whose value bounds all that
lies below it (the A* bound).  That is sampling without replacement.  The next value after the
k-th gives each sample's inclusion score, log(1 - exp(-exp(log p - next))).

No piece crosses from a non-space into a space, so the lattice is a chain of word lattices.
Those of distinct words are built once per worker; beyond ``MAX_NODES`` those of rare
words go and the frequent ones stay.  Whole groups of texts are walked together, one choice of every word at a time.
What is left aside is valued only as far into a text as it can be among the best.  Random numbers are hashes of (seed, row key,
sample, place): a row gives the same samples wherever it is computed.

Defined results: a null or empty text has one segmentation without pieces; a text with fewer
than k segmentations returns all of them (inclusion 0 in logarithms); rows that repeat a
doc_id and text give the same samples; a null doc_id is keyed by its text alone.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 2
SEED = 20240229
ZIPF = 10.0
SPACE = "▁"
GROUP_CHARS = 400_000
MAX_NODES = 6_000_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_P = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(42)
_GOLD = np.uint64(0xBF58476D1CE4E5B9)
_GOLD2 = np.uint64(0x94D049BB133111EB)


def mixed(*parts, start=np.uint64(0)) -> np.ndarray:
    """64-bit hashes of the given integers (splitmix64), going on from the hash of those before."""
    x = start
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.uint64)) * _P
            x += np.uint64(0x632BE59BD9B4E019)
            x ^= x >> np.uint64(30)
            x *= _GOLD
            x ^= x >> np.uint64(27)
            x *= _GOLD2
            x ^= x >> np.uint64(31)
    return x


def uniform(*parts, start=np.uint64(0)) -> np.ndarray:
    """Numbers in (0, 1) that depend on the given integers only."""
    out = (mixed(*parts, start=start) >> np.uint64(11)).astype(float)
    out += 0.5
    out *= 2.0**-53
    return out


def below(mean, top, u):
    """Gumbel values of location ``mean``, truncated at ``top``."""
    return truncated(np.log(-np.log(u)) - mean, top)


def truncated(exponent, top):
    """Gumbel values from their exponents: the smaller the exponent, the larger the value."""
    return -np.logaddexp(-top, exponent)


class Pieces:
    """Vocabulary of a SentencePiece model: pieces by length as sorted hash arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        byte = {}
        plain: list[tuple[str, int]] = []
        score = np.zeros(n)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((p, i))
                score[i] = -np.log(max(-sp.get_score(i), 0.0) + ZIPF)
        self.byte = np.array([byte[k] for k in range(256)], np.int32) if len(byte) == 256 else None
        self.byte_score = -np.log(n + ZIPF)
        self.score = score
        self.text = [""] * n
        self.raw = [b""] * n  # what a piece stands for in the text
        for p, i in plain:
            self.text[i] = p
            self.raw[i] = p.replace(SPACE, " ").encode()
        for k, i in byte.items():
            self.raw[i] = bytes([k])
        self.raw = np.array([*self.raw, None], object)[:-1]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.seen = np.zeros(1 << 22, bool)  # leading bits of the pieces' hashes
        for length in sorted({len(p) for p, _ in plain}):
            group = [(p, i) for p, i in plain if len(p) == length]
            codes = np.frombuffer("".join(p for p, _ in group).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)
            h = codes[:, 0]
            for j in range(1, length):
                h = h * _P + codes[:, j]
            o = np.argsort(h)
            self.seen[(h >> _SHIFT).astype(np.int64)] = True
            self.by_length[length] = h[o], np.array([i for _, i in group], np.int32)[o]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edge labels; a label beyond the vocabulary is a character in bytes."""
        over = np.flatnonzero(edges >= self.size)
        if not len(over):
            return edges
        out, last = [], 0
        for i in over:
            raw = chr(int(edges[i]) - self.size).encode("utf-8", "surrogatepass")
            out += [edges[last:i], self.byte[list(raw)]]
            last = i + 1
        return np.concatenate([*out, edges[last:]])

    def decode(self, ids: np.ndarray) -> str:
        """Text of piece ids; the space put before the text is dropped."""
        return b"".join(self.raw[ids].tolist()).decode("utf-8", "surrogatepass")[1:]


class Lattices:
    """Lattices of distinct chunks in flat arrays: a chunk's nodes are numbered in a row, a
    node's edges lie together, the likeliest first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.start: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first = np.zeros(1 << 16, np.int32)  # first edge of a node
        self.left = np.zeros(1 << 16, np.int32)  # characters to the chunk's end
        self.uses = np.zeros(1 << 16, np.int32)  # groups of texts that held a chunk, at its first node
        self.cum = np.zeros(1 << 17, np.float32)  # cumulated conditional probability inside the node
        self.logp = np.zeros(1 << 17)
        self.to = np.zeros(1 << 17, np.int32)
        self.label = np.zeros(1 << 17, np.int32)

    def _room(self, names: tuple[str, ...], need: int) -> None:
        for n in names:
            a = getattr(self, n)
            if need > len(a):
                more = np.zeros(max(need, 2 * len(a)), a.dtype)  # what is not written takes no memory yet
                more[: len(a)] = a
                setattr(self, n, more)

    def add(self, chunks: list[str]) -> None:
        size = np.array([len(c) for c in chunks])
        cp = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        # characters left in the chunk, from each character on
        left = np.repeat(np.cumsum(size), size) - np.arange(len(cp))
        wide = min(max(self.pieces.by_length, default=1), int(left.max()))
        # (places, characters, scores, labels) of edges, length by length
        found = []
        bare = np.ones(len(cp), bool)  # characters without a piece of their own
        start, h = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        for n in range(1, wide + 1):
            if n > 1:
                fits = left[start] >= n
                start, h = start[fits], h[fits]
            h = h * _P + cp[start + n - 1]
            if n not in self.pieces.by_length:
                continue
            known, ids = self.pieces.by_length[n]
            likely = np.flatnonzero(self.pieces.seen[(h >> _SHIFT).astype(np.int64)])
            at, want = start[likely], h[likely]
            k = np.searchsorted(known, want)
            k[k == len(known)] = 0
            hit = known[k] == want
            at, piece = at[hit], ids[k[hit]]
            if n == 1:
                bare[at] = False
            found.append((at, n, self.pieces.score[piece], piece))
        found.reverse()
        rest = np.flatnonzero(bare)
        if len(rest):
            code = cp[rest].astype(np.int64)
            weight = self.pieces.byte_score * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
            found.append((rest, 1, weight, np.where(code < 128, self.pieces.byte[np.minimum(code, 127)], code + self.pieces.size)))
        # place by place, the longest first: a length has one edge at most at a place
        count = np.zeros(len(cp), np.int64)
        for at, *_ in found:
            count[at] += 1
        heads = np.cumsum(count) - count
        src, free = np.repeat(np.arange(len(cp)), count), heads.copy()
        step, logp, label = np.empty(len(src), np.int64), np.empty(len(src)), np.empty(len(src), np.int32)
        for at, n, score, piece in found:
            to = free[at]
            step[to], logp[to], label[to] = n, score, piece
            free[at] += 1
        # every chunk has one node more than characters: its end.  total: log of the summed
        # weight of all ways from a node to the end, from the ends backwards, by distance to it
        node = np.arange(len(cp)) + np.repeat(np.arange(len(chunks)), size)
        far = left.astype(np.uint16) if left.max() < 1 << 16 else left  # short numbers sort in one go
        places = np.argsort(far, kind="stable")
        ends = np.r_[0, np.cumsum(count[places])]
        o = np.arange(len(src)) + np.repeat(heads[places] - ends[:-1], count[places])
        score, to = logp[o], node[src[o]] + step[o]
        total = np.zeros(len(cp) + len(chunks))
        levels = np.r_[0, np.flatnonzero(np.diff(far[places])) + 1, len(places)]
        for lo, hi in zip(levels[:-1], levels[1:]):
            e = slice(ends[lo], ends[hi])
            v = score[e] + total[to[e]]
            cut = ends[lo:hi] - ends[lo]
            most = np.maximum.reduceat(v, cut)
            summed = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, count[places[lo:hi]])), cut))
            total[node[places[lo:hi]]] = summed
            score[e] = v - np.repeat(summed, count[places[lo:hi]])
        logp[o] = score
        c = np.cumsum(np.exp(logp))
        c -= np.repeat(np.r_[0.0, c[heads[1:] - 1]], count)
        c[heads + count - 1] = 2.0  # the last edge takes the rest
        self._room(("first", "left", "uses"), self.nodes + len(cp) + len(chunks) + 1)
        self._room(("cum", "logp", "to", "label"), self.edges + len(src))
        node += self.nodes
        self.first[node] = self.edges + heads
        self.left[self.nodes : self.nodes + len(cp) + len(chunks)] = 0
        self.uses[self.nodes : self.nodes + len(cp) + len(chunks)] = 0
        self.left[node] = left
        part = slice(self.edges, self.edges + len(src))
        self.cum[part], self.logp[part], self.label[part] = c, logp, label
        self.to[part] = node[src] + step
        begin = self.nodes + np.cumsum(size) - size + np.arange(len(chunks))
        self.start.update(zip(chunks, begin.tolist()))
        self.nodes += len(cp) + len(chunks)
        self.edges += len(src)

    def keep_frequent(self) -> None:
        """Drop the lattices of chunks that one group of texts held, and the rarest of the others beyond
        half of the room; what stays moves together and its counts are halved."""
        names = list(self.start)
        begin = np.fromiter(self.start.values(), np.int64, len(names))
        size = np.diff(np.r_[begin, self.nodes])
        edge = self.first[begin].astype(np.int64)
        edges = np.diff(np.r_[edge, self.edges])
        uses = self.uses[begin]
        o = np.argsort(-uses, kind="stable")
        o = np.sort(o[(np.cumsum(size[o]) <= MAX_NODES // 2) & (uses[o] > 1)])
        begin, size, edge, edges = begin[o], size[o], edge[o], edges[o]
        at, eat = np.cumsum(size) - size, np.cumsum(edges) - edges
        self.nodes, self.edges = int(size.sum()), int(edges.sum())
        nodes = np.arange(self.nodes) + np.repeat(begin - at, size)
        taken = np.arange(self.edges) + np.repeat(edge - eat, edges)
        self.first = (self.first[nodes] - np.repeat(edge - eat, size)).astype(np.int32)
        self.left, self.uses = self.left[nodes], self.uses[nodes] // 2
        self.to = (self.to[taken] - np.repeat(begin - at, edges)).astype(np.int32)
        for n in ("cum", "logp", "label"):
            setattr(self, n, getattr(self, n)[taken])
        self.start = dict(zip([names[i] for i in o], at.tolist()))

    def starts(self, chunks: list[str]) -> np.ndarray:
        if self.nodes > MAX_NODES:
            self.keep_frequent()
        out = np.fromiter(map(self.start.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            self.add(list(dict.fromkeys(chunks[i] for i in new)))
            out[new] = [self.start[chunks[i]] for i in new]
        self.uses[out] += 1  # once a group of texts
        return out

    def walk(self, node: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """Random edges from each node to its chunk's end: (walker, edge), walkers in order and
        each walker's edges in order."""
        who, took = [], []
        active = np.arange(len(node))
        active = active[self.left[node] > 0]
        step = 0
        while len(active):
            u = draw(active, step)
            e = self.first[node[active]]
            more = np.flatnonzero(self.cum[e] < u)
            while len(more):
                e[more] += 1
                more = more[self.cum[e[more]] < u[more]]
            who.append(active), took.append(e)
            node[active] = self.to[e]
            active = active[self.left[node[active]] > 0]
            step += 1
        count = np.zeros(len(node), np.int64)
        for a in who:
            count[a] += 1
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for step, (a, e) in enumerate(zip(who, took)):
            out[first[a] + step] = e
        return np.repeat(np.arange(len(node)), count), out

    def siblings(self, edge: int) -> np.ndarray:
        """Edges of the node that an edge leaves."""
        lo = edge
        while lo and self.cum[lo - 1] < 2.0:
            lo -= 1
        hi = edge
        while self.cum[hi] < 2.0:
            hi += 1
        return np.arange(lo, hi + 1)


class _Branch:
    """What is left aside at one place: the texts that start with ``edges`` and go on with an
    edge that is not in ``used``.  ``value`` bounds their perturbed log-probabilities."""

    __slots__ = ("value", "edges", "used", "before")

    def __init__(self, value, edges, used, before):
        self.value, self.edges, self.used, self.before = value, edges, used, before


def chunks_of(text: str) -> list[str]:
    """Words with the spaces before them; trailing spaces are a chunk."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", " " + SPACE)).split(" ")


def exponents(logp: np.ndarray, before: np.ndarray, at: np.ndarray, free: np.ndarray, first: np.ndarray, least: int, draw) -> np.ndarray:
    """What ``truncated`` takes of each place that is free, infinite where no other edge is or where
    ``least`` places of the text have smaller ones whatever is drawn: log(-log(u)) is within -36.8 and
    3.7, and what was passed before a place only gets less likely.  first: of each text, ``before`` at
    its first free place."""
    out = np.full(len(logp), np.inf)
    some = np.flatnonzero(free & (before >= first[at] - 80))
    for left in (True, False):
        with np.errstate(divide="ignore"):
            other = before[some] + np.log(np.maximum(-np.expm1(logp[some]), 0.0))
        if not left:
            break
        few = np.bincount(at[some[other >= first[at[some]] - 39]], minlength=len(first)) < least
        if not (rest := free & few[at]).any():
            break
        rest[some] = True
        some = np.flatnonzero(rest)
    some, other = some[np.isfinite(other)], other[np.isfinite(other)]
    out[some] = np.log(-np.log(draw(some))) - other
    return out


def sample_group(lat: Lattices, texts: list[str], row_keys: np.ndarray, k: int, seed: int):
    """For each text, its samples as (labels, log-probability, perturbed), best first, and the
    perturbed value of the next one (-inf if there is none)."""
    split = [chunks_of(t) for t in texts]
    count = np.array([len(s) for s in split], np.int64)
    start = lat.starts([c for s in split for c in s])
    first = np.cumsum(count) - count
    samples: list[list[tuple]] = [[] for _ in texts]
    branches: list[list[_Branch]] = [[] for _ in texts]
    following = np.full(len(texts), -np.inf)
    top = -np.log(-np.log(uniform(seed, row_keys)))  # the root's Gumbel value
    # what is walked next: per text the edges so far; the word lattices that remain follow
    going = [(i, np.empty(0, np.int64)) for i in range(len(texts))]
    for r in range(k):
        if not going:
            break
        seeds = mixed(seed, row_keys, r + 1)
        nodes, place = [], []
        for i, head in going:
            done = int((lat.left[lat.to[head]] == 0).sum())  # word lattices that the head has finished
            rest = start[first[i] + done : first[i] + count[i]].copy()
            if len(head) and lat.left[lat.to[head[-1]]] > 0:
                rest[0] = lat.to[head[-1]]
            nodes.append(rest), place.append(np.arange(done, done + len(rest)))
        text = np.array([i for i, _ in going])
        owner = np.repeat(np.arange(len(going)), [len(x) for x in nodes])
        nodes, place = np.concatenate(nodes), np.concatenate(place) * (1 << 20)
        begun = mixed(seeds[text])  # what the numbers of a text and sample have in common
        own = begun[owner]
        who, took = lat.walk(nodes, lambda a, s: uniform(place[a] + s, start=own[a]))
        new = np.bincount(owner[who], minlength=len(going)) if len(who) else np.zeros(len(going), np.int64)
        cuts = np.split(took, np.cumsum(new)[:-1])
        whole = [x for (_, head), part in zip(going, cuts) for x in (head, part)]
        edges = np.concatenate(whole)
        kept = np.array([len(head) for _, head in going])
        size = kept + new
        off = np.cumsum(size) - size
        at = np.repeat(np.arange(len(going)), size)
        logp = lat.logp[edges]
        total = np.r_[0.0, np.cumsum(logp)]
        before = total[:-1] - total[off][at]
        place = np.arange(len(edges)) - off[at]
        # every place after the head leaves its other edges aside, below this sample's value
        head = np.minimum(off + kept, len(edges) - 1)
        exponent = exponents(logp, before, at, place >= kept[at], before[head] if len(edges) else np.zeros(len(going)), k + 1,
                             lambda some: uniform(place[some] + (1 << 62), start=begun[at[some]]))
        labels = lat.label[edges]
        for g, (i, _) in enumerate(going):
            part = slice(off[g], off[g] + size[g])
            samples[i].append((labels[part], float(total[part.stop] - total[part.start]), float(top[i])))
            v = exponent[part]
            if r + 1 == k:  # nothing is walked after it: the largest value is enough
                following[i] = max([b.value for b in branches[i]] + ([float(truncated(v.min(), top[i]))] if len(v) else []), default=-np.inf)
                continue
            best = np.argpartition(v, k)[: k + 1] if len(v) > k + 1 else np.arange(len(v))
            own = edges[part]
            branches[i] += [_Branch(float(truncated(v[j], top[i])), own[:j], (int(own[j]),), float(before[part][j])) for j in best if np.isfinite(v[j])]
        if r + 1 == k:
            break
        walked, going = going, []
        for i, _ in walked:
            if not branches[i]:
                continue  # all of its segmentations are out
            b = max(branches[i], key=lambda b: b.value)
            branches[i].remove(b)
            top[i] = b.value
            draw = uniform(seeds[i], len(b.edges) + (1 << 61)), uniform(seeds[i], len(b.edges) + (3 << 61))
            edge, rest = _other(lat, b, *draw)
            if rest is not None:
                branches[i].append(rest)
            going.append((i, np.r_[b.edges, edge]))
    return samples, following


def _other(lat: Lattices, b: _Branch, u, v) -> tuple[int, _Branch | None]:
    """An edge of the branch, drawn by probability among those not used, and what remains."""
    free = np.array([e for e in lat.siblings(b.used[0]) if e not in b.used])
    p = np.exp(lat.logp[free])
    edge = int(free[min(np.searchsorted(np.cumsum(p), float(u) * p.sum(), "right"), len(free) - 1)])
    if len(free) == 1:
        return edge, None
    mean = b.before + np.log(np.exp(lat.logp[free[free != edge]]).sum())
    return edge, _Branch(float(below(mean, b.value, float(v))), b.edges, (*b.used, edge), b.before)


_lattices: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    if path not in _lattices:
        _lattices[path] = Lattices(Pieces(path))
    return _lattices[path]


def row_key(doc_id, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=0 if doc_id is None else doc_id & (2**63 - 1))


def _texts(batch_ids: list, texts: list[str]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_CHARS:
            yield batch_ids[lo:i], texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if texts:
        yield batch_ids[lo:], texts[lo:]


def _sample(path: str, k: int, seed: int, with_ids: bool):
    def run(batches):
        lat = lattices(path)
        for b in batches:
            for ids, texts in _texts(b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]):
                rows = {n: [] for n in ("id", "sample", "n_pieces", "crc", "logp", "inclusion", "same", "pieces")}
                keys = np.array([row_key(i, t) for i, t in zip(ids, texts)], np.uint64)
                samples, following = sample_group(lat, texts, keys, k, seed)
                for i, text, found, nxt in zip(ids, texts, samples, following):
                    for n, (labels, logp, _) in enumerate(found):
                        pieces = lat.pieces.ids(labels)
                        # log(1 - exp(-exp(d))): close to d where d is very small
                        d = logp - nxt
                        score = 0.0 if nxt == -np.inf else d if d < -30 else float(np.log(-np.expm1(-np.exp(d))))
                        same = lat.pieces.decode(pieces) == text.replace(SPACE, " ")
                        values = (i, n, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), logp, score, same, pieces.tolist() if with_ids else None)
                        for name, v in zip(rows, values):
                            rows[name].append(v)
                arrays = [pa.array(rows["id"], pa.int64()), pa.array(rows["sample"], pa.int32()), pa.array(rows["n_pieces"], pa.int64()),
                          pa.array(rows["crc"], pa.int64()), pa.array(rows["logp"], pa.float64()), pa.array(rows["inclusion"], pa.float64()),
                          pa.array(rows["same"], pa.bool_())]
                names = ["id", "sample", "n_pieces", "ids_crc32", "log_prob", "log_inclusion", "round_trip"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(rows["pieces"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def segmentations(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """k sampled segmentations of every text: (id, sample, n_pieces, ids_crc32, log_prob,
    log_inclusion, round_trip[, ids])."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "id long, sample int, n_pieces long, ids_crc32 long, log_prob double, log_inclusion double, round_trip boolean"
    return src.mapInArrow(_sample(path, k, seed, with_ids), schema + (", ids array<int>" if with_ids else ""))
