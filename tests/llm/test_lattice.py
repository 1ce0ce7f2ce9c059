from itertools import permutations

import numpy as np
import public_tokenizers
from common_llm import ROWS, edge_docs, empty_docs

from chorus.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(lat, text):
    """{labels: log-probability} of every tiling, by plain recursion over the vocabulary."""
    p = lat.pieces
    word = lattice.SPACE + text.replace(" ", lattice.SPACE)
    known = {t: i for i, t in enumerate(p.text) if t}

    def tile(at):
        if at == len(word):
            yield (), 0.0
            return
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in known:
                step = (known[piece],), p.score[known[piece]]
            elif end == at + 1:
                step = (p.size + ord(piece),), len(piece.encode()) * p.byte_score
            else:
                continue
            for rest, s in tile(end):
                yield step[0] + rest, step[1] + s

    found = dict(tile(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


def test_probabilities_and_all_segmentations():
    lat = lattice.Lattices(lattice.Pieces(PATH))
    for text in ("the", "a b", "né一x", "  hi", "\U0001f600"):
        want = all_segmentations(lat, text)
        found, nxt = lattice.sample_group(lat, [text], np.array([7], np.uint64), len(want) + 3, 1)
        got = {tuple(e.tolist()): p for e, p, _ in found[0]}
        assert len(found[0]) == len(want) and got.keys() == want.keys() and nxt[0] == -np.inf
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        values = [g for _, _, g in found[0]]
        assert values == sorted(values, reverse=True)


def test_sampling_without_replacement_has_the_right_frequencies():
    """Ordered pairs come up as often as successive sampling without replacement says."""
    lat = lattice.Lattices(lattice.Pieces(PATH))
    text = "of a"
    p = {k: np.exp(v) for k, v in all_segmentations(lat, text).items()}
    n = 20000
    got: dict = {}
    keys = np.arange(n, dtype=np.uint64)
    samples, following = lattice.sample_group(lat, [text] * n, keys, 2, 3)
    for s in samples:
        pair = tuple(tuple(e.tolist()) for e, _, _ in s)
        assert pair[0] != pair[1]
        got[pair] = got.get(pair, 0) + 1
    for a, b in permutations(sorted(p, key=p.get, reverse=True)[:4], 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(got.get((a, b), 0) / n - want) < 4 * np.sqrt(want / n) + 2e-3
    # inclusion scores estimate sums without bias (Horvitz-Thompson over the sampled ones)
    total = np.mean([sum(np.exp(lp) / -np.expm1(-np.exp(lp - k)) for _, lp, _ in s) for s, k in zip(samples, following)])
    assert abs(total - 1) < 0.02


def test_round_trip_and_reproducible(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = lattice.segmentations(docs, PATH, k=4, with_ids=True).toPandas()
    b = lattice.segmentations(docs.repartition(5), PATH, k=4, with_ids=True).toPandas()
    assert a.round_trip.all() and len(a) == 4 * docs.count()
    key = ["id", "sample"]
    assert (a.set_index(key).ids_crc32 == b.set_index(key).ids_crc32.reindex(a.set_index(key).index)).all()
    assert a.groupby("id").ids_crc32.nunique().eq(4).all()
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(sp.decode([int(x) for x in ids]) == texts[i] for i, ids in zip(a.id[:100], a.ids[:100]))


def test_edges(spark):
    got = lattice.segmentations(edge_docs(spark), PATH).toPandas()
    assert got.round_trip.all()
    for i, text, _ in ROWS:
        if not text and i is not None:
            assert got[got.id == i].n_pieces.tolist() == [0]
    assert lattice.segmentations(empty_docs(spark), PATH).count() == 0


def test_dropping_rare_words_changes_no_sample(monkeypatch):
    texts = [f"the of and w{i} x{i % 7}y \U0001f600 of" for i in range(200)]
    keys = np.arange(200, dtype=np.uint64)

    def run(room):
        monkeypatch.setattr(lattice, "MAX_NODES", room)
        lat = lattice.Lattices(lattice.Pieces(PATH))
        out = []
        for at in range(0, 200, 10):
            samples, following = lattice.sample_group(lat, texts[at : at + 10], keys[at : at + 10], 3, 5)
            out += [([(e.tolist(), p) for e, p, _ in s], float(f)) for s, f in zip(samples, following)]
        return out, lat

    whole, all_words = run(1 << 30)
    short, few_words = run(400)
    assert short == whole
    assert few_words.start.keys() < all_words.start.keys() and few_words.nodes < all_words.nodes
    assert lattice.SPACE + "of" in few_words.start and lattice.SPACE + "w0" not in few_words.start


def test_chunks_are_those_of_the_pattern():
    for t in ["a b", "a", " a", "a ", "a  b c", f"a{lattice.SPACE}b c", "a\nb\tc d", " ", "  ", "x y  z", lattice.SPACE]:
        assert lattice.chunks_of(t) == lattice._CHUNK.findall(lattice.SPACE + t.replace(" ", lattice.SPACE))
    assert lattice.chunks_of("") == []


def test_places_that_cannot_be_next_are_not_drawn():
    rng = np.random.default_rng(3)
    size = np.array([4000, 2, 0, 900, 300])
    off, at = np.cumsum(size) - size, np.repeat(np.arange(5), size)
    logp = -rng.exponential(0.5, size.sum())
    logp[rng.random(len(logp)) < 0.3] = 0.0  # no other edge
    logp[off[3] : off[3] + 600] = 0.0
    total = np.r_[0.0, np.cumsum(logp)]
    before = total[:-1] - total[off][at]
    kept = np.array([10, 0, 0, 0, 300])
    free = np.arange(len(at)) - off[at] >= kept[at]
    u = lattice.uniform(np.arange(len(at)))
    drawn = []
    got = lattice.exponents(logp, before, at, free, before[np.minimum(off + kept, len(at) - 1)], 3, lambda some: drawn.append(some) or u[some])
    with np.errstate(divide="ignore"):
        other = before + np.log(np.maximum(-np.expm1(logp), 0.0))
    want = np.where(free & np.isfinite(other), np.log(-np.log(u)) - other, np.inf)
    for i in range(5):
        assert (np.sort(got[at == i])[:3] == np.sort(want[at == i])[:3]).all()
    assert sum(map(len, drawn)) < len(at) / 3
