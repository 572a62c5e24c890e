"""Whitening, SentencePiece and phrases against brute force and the library, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from echoweave.llm import common, phrases, pieces, queries, whitening

from ..conftest import SF

# -- 11 whitening -----------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<double>"


def exact(vectors):
    """Exact fit of vectors: n, sums, and the covariance as fractions."""
    fit = sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    off = [[Fraction(n * x[i] - sums[i], n) for i in range(d)] for x in fit]
    return fit, n, sums, [[sum(o[i] * o[j] for o in off) / n for j in range(d)] for i in range(d)]


def check_whitening(rows, vectors, k):
    """rows of whiten() against the exact fit of vectors: id -> vector."""
    _, n, sums, cov = exact(vectors.values())
    values, basis = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, basis = values[::-1], basis[:, ::-1]
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert got.keys() == vectors.keys() and all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    z = {}
    for i, v in vectors.items():
        x = [int(np.floor(64 * c)) + 1_000_000 for c in v]
        assert {(r.n, int(r.deviation)) for r in got[i].values()} == {(n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))}
        z[i] = (np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ basis[:, :k]) / np.sqrt(values[:k])
    for c in range(k):
        mine, want = np.array([got[i][c + 1].whitened for i in vectors]), np.array([z[i][c] for i in vectors])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert abs(next(iter(got.values()))[c + 1].explained - values[c] / float(sum(cov[i][i] for i in range(len(cov))))) < 1e-10
    assert {r.identity_error for r in rows}.pop() < 1e-9


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + [0, 1000, -3, 1e6, 0]  # far from the origin
    vectors = {i: v for i, v in enumerate(x.tolist())} | {1000 + i: x[0].tolist() for i in range(40)}
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame([*vectors.items(), *bad], VEC).repartition(5)
    check_whitening(whitening.whiten(df).collect(), vectors, 5)
    assert len(whitening.whiten(df, 2).collect()) == 2 * len(vectors)


def test_whitening_of_very_unlike_scales_and_large_entries(spark):
    rng = np.random.default_rng(5)
    scales = np.array([1e9, 1e5, 30.0, 1.0])
    vectors = {i: v for i, v in enumerate((rng.normal(size=(200, 4)) * scales).tolist())}
    rows = whitening.whiten(spark.createDataFrame(list(vectors.items()), VEC)).collect()
    # the smallest eigenvalue is 1e-18 of the largest and so below rounding
    assert {r.component for r in rows} <= {1, 2, 3, 4} and {r.identity_error for r in rows}.pop() < 1e-4
    fit, n, sums, _ = exact(vectors.values())
    want = {i: sum((n * (int(np.floor(64 * c)) + 1_000_000) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in vectors.items()}
    assert {r.vec_id: int(r.deviation) for r in rows} == want


def test_outer_products_are_compensated():
    rng = np.random.default_rng(6)
    high = rng.normal(size=(700, 4)) * [1, 1e-7, 1e7, 1e3]
    low = high * 2.0**-54 * rng.normal(size=high.shape)
    total = whitening.outer((high, low))
    for i in range(4):
        for j in range(4):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(e)) for a, b, c, e in zip(high[:, i], low[:, i], high[:, j], low[:, j], strict=True))
            size = sum(abs(Fraction(a) * Fraction(c)) for a, c in zip(high[:, i], high[:, j], strict=True))
            assert abs(Fraction(total[0][i, j]) + Fraction(total[1][i, j]) - want) <= size * Fraction(2) ** -85


def test_planes_round_trip():
    x = np.array([[1, -2, 2**60], [0, 7, -(2**61)]])
    import pyarrow as pa

    assert (whitening.unplanes(pa.array(whitening.planes(x), pa.binary()), 3) == x).all()


def test_whitening_edges(spark):
    empty = spark.createDataFrame([], VEC)
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], VEC)
    assert whitening.whiten(same).count() == 0  # one different vector has no components
    line = spark.createDataFrame([(1, [1.0, 2.0], 3), (1, [1.0, 2.0], 3), (None, [2.0, 2.0], 3)], VEC + ", component int")
    rows = whitening.whiten(line).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 9)) for r in rows) == [(0, 1, 2, 1.0), (1, 1, 2, 1.0), (1, 1, 2, 1.0)]


def test_whitening_query(spark):
    df = queries.op11_whitening(spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint"
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in common.table(spark, SF, "embeddings").limit(1000).collect()}
    rows = df.where("vec_id < 3").collect()
    fit = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors.values()])
    fit = np.unique(fit, axis=0)
    off = fit - fit.mean(0)
    values = np.linalg.eigvalsh(off.T @ off / len(fit))[::-1]
    for r in rows:
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9


# -- 12 sentencepiece -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_pieces_equal_the_library(spark, library):
    docs = common.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in pieces.encoded(docs).collect()}
    digests = {r.doc_id: r for r in queries.op12_sentencepiece(spark, SF).collect()}
    for d in docs.collect():
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        text = library.decode(ids)
        assert rows[d.doc_id].ids == ids and rows[d.doc_id].decoded == text
        assert tuple(digests[d.doc_id])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_random_strings_equal_the_library(library):
    rng, p = random.Random(9), pieces.pieces()
    kinds = [" ▁ao", " ▁\t\n\0aeionrst.,éЖп的中日本ﬁⅧ🙂<s>0x", "abcdefghijklmnopqrstuvwxyz", "e t"]
    for k in range(4000):
        letters = kinds[k % len(kinds)] if k % 5 else [chr(c) for c in (*range(1, 0x300), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F640))]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert p.encode(text).tolist() == ids, text
        assert p.decode(p.encode(text)) == library.decode(ids), text


def test_random_ids_decode_as_the_library_does(library):
    rng, p = random.Random(10), pieces.pieces()
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(131, 258), rng.randint(0, 5), 259]) for _ in range(rng.randint(0, 8))]
        assert p.decode(np.array(ids, np.uint32)) == library.decode(ids), ids


def test_both_ways_to_tell_fitting_pieces_agree():
    rng, p = random.Random(11), pieces.pieces()
    names = [n for n in p.names if n and n[0] != pieces.MARK]
    for _ in range(5000):
        a, b = rng.choice(names), rng.choice(names)
        assert p.stays_apart(a, b) == (p.merged(a + b) == [a, b]), (a, b)


def test_places_that_fail_are_marked(library):
    """Texts in which a longest piece doesn't fit what is before it, again and again; bounded tables that fill."""
    p = pieces.pieces()
    for text in ("ab" * 3000, "aaaaaaaaab" * 500, "thethethethe" * 300, "xyz" * 20000):
        assert p.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_full_tables_change_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "UNITS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    p, text = pieces.pieces(), "some words that come and words that go and come again"
    assert p.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(p.fitting) <= 5 or len(p.known) <= 5


def test_pieces_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (None, "a b", 5)], "doc_id long, text string, ids int")
    rows = pieces.digests(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[2:] == [(1, 2), (1, 2)] and len(rows) == 4
    assert sorted(r.decoded for r in pieces.encoded(df).collect()) == ["", "", "a b", "a b"]
    assert pieces.digests(df.where("false")).count() == 0


# -- 13 phrases -------------------------------------------------------------------------------------------------


def brute_phrases(docs, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Über", "the", "THE", "of", "x\x00y", "é", "-", "a b", *"abcdefghij"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [("".join(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) + w for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60))), rng.choice(["de", "en", None, "und"])) for _ in range(n)]
    return [*docs, *[("new york city hall", "en")] * 40, (None, "en"), ("", None), ("once upon", "fr")]


@pytest.mark.parametrize("block_bytes", [500, 1 << 24])
def test_phrases_equal_brute_force(spark, block_bytes):
    docs = phrase_docs(3, 150)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    for least, top in ((5, 2000), (12, 4)):
        assert sorted(map(tuple, phrases.collocations(df, least, top, block_bytes).collect())) == brute_phrases(docs, least, top)


def test_phrases_of_the_sample(spark):
    docs = [(r.text, r.lang) for r in common.table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, phrases.collocations(common.table(spark, SF, "documents"), 8).collect()))
    assert got and got == brute_phrases(docs, 8, 2000)


def test_phrases_edges(spark):
    df = spark.createDataFrame([("a b", "en", 1, 2)] * 3, "text string, lang string, key int, n int")
    assert [tuple(r) for r in phrases.collocations(df, 3).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 1_000_000)]
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, in the scoring step alone."""
    key = lambda *ids: b"".join(i.to_bytes(4, "big") for i in (*ids, 0, 0, 0, 0)[:4])
    known = spark.createDataFrame([("en", "a", 10**18, 1), ("en", "b", 9 * 10**17, 2)], "lang string, word string, f long, id long")
    grams = spark.createDataFrame([(key(1), 1, 10**18), (key(2), 1, 9 * 10**17), (key(1, 2), 2, 8 * 10**17)], "key binary, size int, f long")
    totals = spark.createDataFrame([("en", 2 * 10**18)], "lang string, n long")
    assert [tuple(r) for r in phrases.ranked(known, grams, totals, 10).collect()] == [("en", 1, "a b", 8 * 10**17, 10**18, 9 * 10**17, 2 * 10**18, 2_000_000 * 8 // 19)]


def test_radix_sort_and_run_lengths():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 2**32, 3000).astype(np.uint32) >> np.uint32(s) for s in (30, 20, 28)]
    rows, n = phrases.run_lengths(columns)
    want = Counter(zip(*(c.tolist() for c in columns), strict=True))
    assert [(tuple(r[:3].tolist()), int(c)) for r, c in zip(rows, n, strict=True)] == sorted(want.items())


def test_runs_over_blocks_and_ranges(spark, monkeypatch):
    """Keys of many blocks in many small ranges: counts over all blocks, and each block's own frequent keys."""
    monkeypatch.setattr(phrases, "RANGE_KEYS", 5)
    monkeypatch.setattr(phrases, "SAMPLE", 2)
    rng, rows, want, of = random.Random(2), [], Counter(), defaultdict(set)
    for block in range(12):
        count = Counter(tuple(rng.choice([0, 1, 2, 70_000, 2**32 - 1]) for _ in range(4)) for _ in range(300))
        keys = sorted(count)
        rows.append((block, len(keys), phrases.pack_keys(np.array(keys, np.int64)), phrases.squeeze(np.array([count[k] for k in keys]))))
        want.update(count)
        for k in keys:
            of[k].add(block)
    packed = spark.createDataFrame(rows, phrases.PACKED).repartition(3)
    assert len(phrases.range_bounds(packed)) > 3
    out = phrases.frequent_runs(packed, 8, True)
    key = lambda k: np.array(k, ">u4").tobytes()
    good = {k: n for k, n in want.items() if n >= 8}
    assert {(bytes(r.key), r.f) for r in phrases.totals_of(out).collect()} == {(key(k), n) for k, n in good.items()}
    got = [(r.block, tuple(k)) for r in out.where("block is not null").collect() for k in phrases.unpack_keys(r.keys).tolist()]
    assert sorted(got) == sorted((b, k) for k in good for b in of[k])


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars already are components as they are; a path takes rounds, of six shuffles each at most."""
    from echoweave.llm import components

    made = []
    monkeypatch.setattr(components, "checkpointed", lambda df: (made.append(df._jdf.queryExecution().executedPlan().toString()), common.checkpointed(df))[1])
    star = spark.createDataFrame([(k, k % 3) for k in range(3, 40)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(star).collect()} == {k: k % 3 for k in range(40)} and len(made) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.component for r in components.connected_components(path).collect()} == {0} and len(made) > 2
    assert all("Union" not in p for p in made)
