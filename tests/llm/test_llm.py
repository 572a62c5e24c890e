"""The ten operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from echoweave.llm import ann, common, exact_dedup, langid, line_dedup, mixing, packing, quality, simhash, suffix_dedup, url_filter
from echoweave.llm.components import connected_components

from ..conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, schema="doc_id long, text string"):
    return spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(texts)], schema)


def words(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)) if size else ""


@pytest.fixture(scope="module")
def sample(spark):
    return common.table(spark, SF, "documents")


# -- components -------------------------------------------------------------------------------------------------


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute_components(edges)
    assert connected_components(df.where("false")).count() == 0


# -- 1 lines ----------------------------------------------------------------------------------------------------


def brute_lines(texts):
    seen, keep = [], []
    lines = [(d, i, line) for d, t in enumerate(texts) if t is not None for i, line in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)]
    sets = [{line[i : i + line_dedup.SHINGLE] for i in range(max(1, len(line) - line_dedup.SHINGLE + 1))} for _, _, line in lines]
    edges = [(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= line_dedup.SIMILARITY * len(sets[i] | sets[j])]
    part = brute_components(edges)
    gone = {lines[i][:2] for i, c in part.items() if c != i}
    del seen, keep
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    line = words(rng, 30)
    near = line.replace(line.split()[7], "zzzz")
    texts = [f"{line}\n\nshort\n{words(rng, 12)}", f"{near}\nshort\nother", None, "", "   \n ", f"x\n{line}", line, words(rng, 40) + "\n" + words(rng, 40), "x", "long " * 3000]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_digest(spark):
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_digest(docs_of(spark, ["a\nb", "a", None, "", "a\n\nc"])).collect()}
    assert got == {0: (2, 0), 1: (1, 1), 2: (1, 0), 3: (1, 0), 4: (3, 1)}


def test_lines_of_repeated_ids_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "same\nA", 5, 6), (1, "same\nB", 5, 6), (None, "same", 5, 6)], "doc_id long, text string, gone int, k1 int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    texts = sorted(r.text for r in out.collect())
    assert sorted(texts) == ["A", "B", "same"]
    assert line_dedup.dedup_lines(df.where("false")).count() == 0 and line_dedup.line_digest(df.where("false")).count() == 0


def line_merges(lines, parts):
    """(merges found, merges of brute force, merges found that aren't true) of lines and their components."""
    rows = lines.select("k1", "k2", "line").distinct().collect()
    sets = [{r.line[i : i + 10] for i in range(max(1, len(r.line) - 9))} for r in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    true = set()
    for i, s in enumerate(sets):
        count = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    count[j] += 1
        true |= {frozenset(((rows[i].k1, rows[i].k2), (rows[j].k1, rows[j].k2))) for j, n in count.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)}
    got = {(r.k1, r.k2): (r.p1, r.p2) for r in parts.collect()}
    want = brute_components([tuple(sorted(e)) for e in true])
    merges = lambda p: len(p) - len(set(p.values()))
    return merges(got), merges(want), sum(want.get(k) != want.get(p) for k, p in got.items())


def test_line_pairs_recall(spark, sample):
    lines = line_dedup.numbered_lines(sample)
    found, true, wrong = line_merges(lines, line_dedup.like_lines(lines)[0])
    assert not wrong and found >= 0.95 * true > 0


def test_lines_of_a_hot_family_that_are_unlike_the_pivots(spark):
    """Lines behind one common start, like only in pairs: unlike ones at 0.71 share bands, and a pivot finds few of them."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, texts = text(240), []
    for _ in range(200):
        own = text(50)
        texts += [common + own, common + own[:-5] + text(5)]
    lines = line_dedup.numbered_lines(docs_of(spark, texts))
    found, true, wrong = line_merges(lines, line_dedup.like_lines(lines)[0])
    assert not wrong and true == 200 and found >= 0.95 * true
    signed = line_dedup.signatures(lines)
    groups = line_dedup.band_groups(signed)
    assert groups.where(F.col("n") > line_dedup.SMALL).count() > len(texts)


def test_hot_lines_take_few_steps(spark, monkeypatch):
    """Large groups are split at all levels at once: a step a level leaves more small files and tasks than the lines have bytes."""
    from echoweave.llm import components

    steps, rng = [], random.Random(13)
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "checkpointed", lambda df: steps.append(1) or common.checkpointed(df))
    start = words(rng, 60)
    texts = [f"{start} {own} {words(rng, 1)}" for own in (words(rng, 9) for _ in range(60)) for _ in range(2)]
    lines = line_dedup.numbered_lines(docs_of(spark, texts))
    found, true, wrong = line_merges(lines, line_dedup.like_lines(lines)[0])
    assert not wrong and found >= 0.95 * true > 0
    assert len(steps) <= 25


def test_near_copies_of_one_line_in_thousands(spark):
    rng = random.Random(12)
    words_ = [words(rng, 1) for _ in range(60)]
    texts = []
    for _ in range(800):
        w = list(words_)
        w[rng.randrange(60)] = words(rng, 1)
        texts.append(" ".join(w))
    got = line_dedup.line_digest(docs_of(spark, texts)).collect()
    assert sum(r.n_removed for r in got) >= 0.99 * (len(texts) - 1)


def test_a_text_of_very_many_lines(spark):
    lines = [f"{i} {words(random.Random(i % 700), 6)}" if i % 2 else "again" for i in range(6000)]
    docs = docs_of(spark, ["\n".join(lines)])
    got = line_dedup.dedup_lines(docs).first().text.split("\n")
    assert got.count("again") == 1 and set(got) <= set(lines) and got == sorted(got, key=lines.index)
    assert spark.range(1).select(line_dedup.without(F.array(*map(F.lit, "abcdef")), F.array(F.lit(0), F.lit(2), F.lit(3))).alias("x")).first().x == ["b", "e", "f"]


def test_line_dedup_takes_lines_from_a_long_document_in_one_pass(spark):
    """Laying out the lines that go anew for each line took the square of a document's lines."""
    n = 20_000
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("all"), F.sequence(F.lit(0), F.lit(n - 1), F.lit(2)).alias("gone"))
    began = time.monotonic()
    assert df.select(line_dedup.without(F.col("all").cast("array<string>"), F.col("gone")).alias("x")).first().x == [str(i) for i in range(1, n, 2)]
    assert time.monotonic() - began < 15


def test_alike_counts_sets_and_blank_lines_are_told_without_a_pattern(spark):
    pairs = [([1, 2, 3, 4, 4, 4], [1, 2, 3, 4, 5]), ([1, 2, 3, 4, 5, 5], [1, 2, 3, 4, 6]), ([1], [2, 2]), ([7, 7, 7], [7]), ([1, 2, 3, 4], [1, 2, 3, 4, 5, 6])]
    got = spark.createDataFrame(pairs, "s array<long>, t array<long>").select(line_dedup.alike(F.col("s"), F.col("t"), 0.8).alias("x")).collect()
    assert [r.x for r in got] == [len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t)) for s, t in pairs]
    lines = line_dedup.numbered_lines(docs_of(spark, [" \t\x0b\f\r\n\u00a0\n\n a \n\x1c"]))
    assert sorted((r.line_no, r.line) for r in lines.collect()) == [(1, "\u00a0"), (3, " a "), (4, "\x1c")]
    assert "rlike" not in lines._jdf.queryExecution().optimizedPlan().toString().lower()


# -- 2 simhash --------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def near(ids, fps):
    part = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    least = defaultdict(list)
    for i, p in zip(ids, part, strict=True):
        least[p].append(i)
    return [min(least[p]) for p in part]


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_equals_brute_force(spark, sample, block):
    rows = sample.select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text for r in rows] + [None, "", " \t", "One two", "one TWO", "É a b c d", "é a b c d"] + [rows[3].text + f" tail{i}" for i in range(12)]
    fps = [brute_fingerprint(t) for t in texts]
    got = simhash.near_duplicates(docs_of(spark, texts), block).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == near(list(range(len(texts))), fps)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3, np.uint64)
    fps = np.array([[int(b) ^ sum(1 << int(k) for k in rng.choice(64, 2, False))] for b in base for _ in range(30)], np.uint64)
    for old in (0, 40):
        edges = simhash.forest(fps, old)
        assert all((int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 4 for i, j in edges) and len(edges) < len(fps)
        want = [(j, i) for i in range(len(fps)) for j in range(i) if (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 4 and (not old or j < old <= i)]
        assert brute_components(edges) == brute_components(want)


def test_near_dedup_keeps_one(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    out = simhash.near_dedup(spark.createDataFrame([(4, text, 1), (2, text, 2), (9, "something else entirely here now", 3), (None, "x y z w q", 4)], "doc_id long, text string, component_id int"))
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 2, 9] and out.columns == ["doc_id", "text", "component_id"]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_dedup_deals_fingerprints_once(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(simhash, "checkpointed", lambda df: steps.append(1) or common.checkpointed(df))
    text = words(random.Random(2), 60)
    assert simhash.near_dedup(docs_of(spark, [text, text + " more", words(random.Random(4), 60)])).count() == 2
    assert len(steps) <= 17


def test_near_dedup_of_repeated_and_null_ids_and_clashing_columns(spark):
    long, other = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z"
    rows = [(3, long, 1), (5, long, 1), (5, other, 1), (None, long, 2), (7, other.upper(), 3), (None, "null ids only", 4), (None, "null ids only", 4), (8, "one two", 5), (8, "one two", 5), (9, None, 6), (10, " ", 6), (11, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    out = simhash.near_dedup(df)
    assert sorted(out.collect(), key=str) == sorted([(3, long, 1), (5, other, 1), (None, "null ids only", 4), (8, "one two", 5), (9, None, 6)], key=str)
    assert out.columns == df.columns and simhash.near_dedup(df.where("false")).count() == 0


def test_near_dedup_finds_like_texts(spark):
    """Near copies that differ in many bits of their fingerprints, against brute force: no clean text goes, and most copies do."""
    rng = random.Random(13)
    texts = [words(rng, 120) for _ in range(25)]
    for i in range(25):
        w = texts[i].split()
        for cut in (2, 4, 6, 8, 12, 30):
            texts.append(" ".join(w[cut:]) + "".join(f" t{i}x{cut}y{j}" for j in range(cut)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    edges = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    gone = {i for i, c in brute_components(edges).items() if i != c}
    lost = set(range(len(texts))) - {r.doc_id for r in simhash.near_dedup(docs_of(spark, texts)).collect()}
    assert lost <= gone and len(lost) >= 0.95 * len(gone)
    fps = [simhash.fingerprint(t) for t in texts]
    assert any((fps[i] ^ fps[j]).bit_count() > 4 for i, j in edges)


def test_near_dedup_of_families_near_the_threshold(spark):
    """Texts of one base with a few words changed in each: most pairs are just below 0.8, and merges hang on those just above."""
    found = merges = 0
    for n_words, edits in ((60, 1), (120, 2), (180, 3)):
        rng = random.Random(n_words)
        word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))  # noqa: B023, E731
        base, texts = [word() for _ in range(n_words)], []
        for _ in range(150):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n_words)] = word()
            texts.append(" ".join(w))
        sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
        true = brute_components([(i, j) for j in range(150) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
        here, all_here = 150 - simhash.near_dedup(docs_of(spark, texts)).count(), len(true) - len(set(true.values()))
        assert 0.8 * all_here <= here <= all_here
        found, merges = found + here, merges + all_here
    assert found >= 0.9 * merges


def test_segments_over_two_words(spark):
    rng = random.Random(1)
    words = [rng.getrandbits(64) for _ in range(3)]
    whole = sum(w << (64 * i) for i, w in enumerate(words))
    df = spark.createDataFrame([tuple(w - (1 << 64) if w >> 63 else w for w in words)], "f0 long, f1 long, f2 long")
    for bits in (28, 32):
        assert list(df.select(*(simhash.segment(k, bits).alias(f"s{k}") for k in range(192 // bits))).first()) == [whole >> (k * bits) & ((1 << bits) - 1) for k in range(192 // bits)]


def test_bit_counts():
    h = np.random.default_rng(2).integers(0, 1 << 63, 1000, np.uint64)
    assert simhash.bit_counts(h).tolist() == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


# -- 3 substrings -----------------------------------------------------------------------------------------------


def brute_substrings(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("big", [suffix_dedup.BIG, 2])
def test_suffix_dedup_equals_brute_force(spark, big):
    rng = random.Random(7)
    passage = words(rng, 40)
    texts = [words(rng, 100), passage, None, "", "a" * 99, "a" * 100, "a" * 300, "ab" * 200, f"{words(rng, 20)} {passage} {words(rng, 20)}", passage[30:180] + "é" * 60 + passage[:140], "x" + passage[3:], passage, passage[:99], words(rng, 30) + passage[50:149] + "?", "tail " + passage[100:]]
    texts += [words(rng, 5) + passage[20:150] + words(rng, 5) for _ in range(8)]
    got = suffix_dedup.remove_repeats(docs_of(spark, texts), big).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_substrings(texts)


def test_suffix_dedup_of_long_texts_cut_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [words(rng, 300) + passage + words(rng, 300), passage + words(rng, 400) + passage]
    rows = [("key", i, t.encode()) for i, t in enumerate(texts)]
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    suffix_dedup.tables.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "text"])
    tuples = [x for b in suffix_dedup.scan([batch]) for x in b.to_pylist()]
    windows = defaultdict(int)
    for t in tuples:
        if t["place"] >= 0:
            windows[t["key"]] += t["place"] & 255
    runs = [t for t in tuples if t["place"] < 0]
    assert all(windows[i] + sum(r["r"] - 99 for r in runs if r["key"] == i) >= len(texts[i]) - 99 for i in (0, 1))
    suffix_dedup.tables.cache_clear()


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    text = "abcdefghij" * 11
    df = docs_of(spark, [text, text, text, "z"], [3, 3, None, 1])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    first = brute_substrings([text])[0][1]
    assert got == [(False, 1, 0), (False, 3, 110), (False, 3, 110), (True, 0, first)]
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


# -- 4 urls -----------------------------------------------------------------------------------------------------


def test_url_rules_and_parts(spark):
    urls = ["https://WWW.Example.com/en/1?q=a/b", "http://example.com/en/2#x", "http://blog.example.com/en/", "http://example.com/fr/1", "http://a.net/es/1", "http://a.net/fr", "http://a.org/x", None, "no scheme", "http://com", "x://com/?a", "http://Éa.com/p", "mailto:a@b.net/es/", "http://xexample.com/en/1"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int")).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in got[:4]] == [("www.example.com", "/en/1"), ("example.com", "/en/2"), ("blog.example.com", "/en/"), ("example.com", "/fr/1")]
    assert [r.rule for r in got] == ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, "com/", "com/", None, "com/"]
    assert [r.verdict for r in got] == ["allow", "block", "block", "allow", "block"] + ["allow"] * 9
    assert (got[7].host, got[7].path, got[9].host, got[9].path) == ("", "", "com", "")


def test_url_tree_rejects_bad_templates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    pages = [(i, f"http://h.org/{'good' if i % 2 else 'spam'}/{i}/{letters[i // 26 % 26]}{letters[i % 26]}{i % 7}x") for i in range(400)]
    labels = [(i, i % 2) for i in range(0, 400, 1)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.verdict for r in got if "/spam/" in r.path} == {"block"} and {r.verdict for r in got if "/good/" in r.path} == {"allow"}
    assert {r.template for r in got if "/spam/" in r.path} == {"/spam/#/*"}, {r.template for r in got}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def brute_side(lab, good, o_lab, o_good):
    if not lab or not o_lab:
        return 0
    pooled = (good + o_good) / (lab + o_lab)
    spread = (pooled * (1 - pooled) * (1 / lab + 1 / o_lab)) ** 0.5
    gap = good / lab - o_good / o_lab
    return 1 if gap > 1.96 * spread else -1 if -gap > 1.96 * spread else 0


def brute_templates(urls, quality_of):
    """id -> (template, value): the whole tree again in plain Python, node by node from the root."""
    rows = []
    for i, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        rows.append({"id": i, "host": re.sub("[A-Z]", lambda m: m[0].lower(), host), "segs": [s for s in re.sub("[0-9]+", "#", path).split("/") if s], "q": quality_of.get(i)})
    labels = lambda xs: (sum(x["q"] is not None for x in xs), sum(x["q"] == 1 for x in xs))
    out = {}

    def visit(xs, depth, template, parent, value):
        n = labels(xs)
        if brute_side(*n, *parent):
            value = (n[1] + 8 * value) / (n[0] + 8)
        kids = defaultdict(list)
        for x in xs:
            if depth >= len(x["segs"]):
                out[x["id"]] = (template, value)
            elif not n[0] or len({tuple(y["segs"]) for y in xs}) == 1:
                out[x["id"]] = (template + "/**", value)
            else:
                kids[x["segs"][depth]].append(x)
        if not kids:
            return
        size, names, sides, to = sum(map(len, kids.values())), defaultdict(list), defaultdict(list), defaultdict(list)
        for seg, ys in kids.items():
            names["*" if len(kids) >= 16 and len(ys) * 64 < size else seg] += ys
        for name, ys in names.items():
            sides[brute_side(*labels(ys), *n)].append(name)
        for side, group in sides.items():
            pool = labels([y for name in group for y in names[name]])
            for name in group:
                like = len(group) > 1 and not brute_side(*labels(names[name]), *pool)
                to[{1: "*>", -1: "*<", 0: "*"}[side] if like else name] += names[name]
        for name, ys in to.items():
            visit(ys, depth + 1, f"{template}/{name}", n, value)

    lab, good = labels(rows)
    by_host = defaultdict(list)
    for x in rows:
        by_host[x["host"]].append(x)
    for xs in by_host.values():
        visit(xs, 0, "", (lab, good), (good + 1) / (lab + 1))
    return out


def test_url_tree_equals_brute_force(spark):
    pages, labels = common.table(spark, SF, "pages"), common.table(spark, SF, "labels")
    want = brute_templates([(r.page_id, r.url) for r in pages.collect()], {r.doc_id: r.quality for r in labels.collect()})
    for r in url_filter.judge(pages, labels).collect():
        template, value = want[r.page_id]
        verdict = dict(url_filter.RULES).get(r.rule)
        assert (r.template, r.verdict) == (template, verdict or ("block" if value < 0.5 else "allow"))


def test_url_tree_merges_like_siblings_at_any_depth(spark):
    rng, urls, quality_of = random.Random(6), [(10_000, None), (10_001, "x"), (10_002, "http://h.org/" + "a/" * 300)], {}
    for i in range(900):
        kind = rng.choice(["good", "fine", "spam", "junk"])
        urls.append((i, f"http://h.org/a/b/c/d/e/{kind}/{rng.choice('xyz')}/{i}"))
        if i % 3:
            quality_of[i] = int(rng.random() < (0.95 if kind in ("good", "fine") else 0.05))
    df = spark.createDataFrame([(*u, "c") for u in urls], "page_id long, url string, template string")
    labels = spark.createDataFrame(list(quality_of.items()), "doc_id long, quality int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.judge(df.unionByName(df.limit(3)), labels).collect()}
    want = brute_templates(urls, quality_of)
    assert got == {i: (t, "block" if v < 0.5 else "allow") for i, (t, v) in want.items()}
    kinds = {t for i, (t, _) in got.items() if i < 10_000}
    assert {t.split("/")[6] for t in kinds} == {"*>", "*<"} and all(v == ("block" if "/*<" in t else "allow") for i, (t, v) in got.items() if i < 10_000)


# -- 5 quality, 8 language --------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    got = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right > 0.9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_equals_brute_force(spark):
    """Dictionaries, features, calibration and scores once more in one process."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    got = {r.doc_id: r.score for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    raw = {q: quality.dictionary(sorted((c for i, v in label.items() if v == q and h[i] % 2 == 0 for c in quality.chunks(texts[i].encode(), 2000)), key=lambda c: (xxhash.xxh64_intdigest(c) >> 1, c))[:2500]) for q in (0, 1)}
    g, b, n = (quality.compressor(x) for x in (raw[1], raw[0], None))

    def x_of(text):
        d = text.encode()
        diff = lambda p, q: (p - q) / max(p, q, 1)
        size = lambda z, v=d: len(z.compress(v))
        parts = [diff(size(b, d[i : i + 1000]), size(g, d[i : i + 1000])) for i in range(0, len(d), 1000)] or [diff(size(b), size(g))]
        return [diff(size(b), size(g)), sum(parts) / len(parts), diff(size(n), size(g)), diff(size(n), size(b))]

    ids = sorted(i for i in label if h[i] % 2)
    x, y = np.array([x_of(texts[i]) for i in ids]), np.array([label[i] for i in ids], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    wide = lambda v: np.array([[1, *row, *(row[i] * row[j] for i in range(4) for j in range(i, 4))] for row in (np.array(v) - mean) / scale])
    a, w, at = wide(x), np.zeros(15), 0.1
    for _ in range(200):  # a gradient whose steps are damped by a growing and falling diagonal finds the same optimum
        p = 1 / (1 + np.exp(-a @ w))
        new = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + (0.1 + at) * np.eye(15), a.T @ (y - p) - 0.1 * w)
        cost = lambda v: np.logaddexp(0, a @ v).sum() - y @ (a @ v) + 0.05 * v @ v  # noqa: B023, E731
        w, at = (new, at / 3) if cost(new) < cost(w) else (w, at * 4)
    for i, t in texts.items():
        assert got[i] == pytest.approx(float(1 / (1 + np.exp(-np.clip(wide([x_of(t)]) @ w, -30, 30)))[0]), abs=1e-4)


def test_fit_settles_on_any_features():
    """Separable, equal and constant features: the fit ends, and no set of features does worse than its best single one."""
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.8).astype(float)
    x = np.column_stack([y + rng.normal(size=600) * 0.01, y + rng.normal(size=600), rng.normal(size=600), np.ones(600)])

    def loss(columns):
        m = quality.Model()
        m.calibrate(x[:, columns], y)
        p = m.score(x[:, columns]).clip(1e-12, 1 - 1e-12)
        assert np.isfinite(m.weights).all() and np.abs(m.weights).max() < 1e3
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    single = [loss([i]) for i in range(4)]
    for columns in ([0, 1], [0, 0], [0, 3], [1, 2, 3], [0, 1, 2, 3]):
        assert loss(columns) <= min(single[i] for i in columns) + 0.01


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    rows = docs.select("doc_id", "text", F.lit(1).alias("quality"), F.lit(2).alias("score"), F.lit(3).alias("_h"))
    twice = rows.unionByName(rows.limit(5))
    out = quality.keep_good(twice, labels)
    assert out.columns == rows.columns and out.count() >= quality.keep_good(docs, labels).count()


def test_quality_edges(spark):
    docs = docs_of(spark, [None, "", "word " * 50_000], [1, 1, None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 3 and [r.predicted for r in got] == [1] * 3
    few = spark.createDataFrame([(2, 1), (2, 0), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.classify(docs.where("false"), quality.train(docs, few)).count() == 0


def test_language_on_held_out_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_language_equals_brute_force(spark, sample):
    """Sample, n-grams, codewords' bits by ridge regression, losses and decoding once more, one document and one bit at a time."""
    rows = sample.select("doc_id", "text", "lang", F.xxhash64(F.lit(8), F.col("doc_id")).alias("h")).collect()
    known = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    per = defaultdict(int)
    for r in known:
        per[r.lang] += 1
    share = max(8, langid.SAMPLE_DOCS // len(per))
    learnt = sorted((r for r in known if (r.h % (1 << 30)) / (1 << 30) < share / per[r.lang] and any(c.isalpha() for c in r.text)), key=lambda r: (r.doc_id, r.lang))

    def grams(text):
        data, out = text.lower().encode(), np.zeros(2048)
        for i in range(len(data) - 1):
            two = (data[i] * 0x9E3779B1 ^ data[i + 1] * 0x85EBCA6B) & 0xFFFFFFFF
            out[(two * 0x2C1B3C6D & 0xFFFFFFFF) >> 21] += 1
            if i + 2 < len(data):
                three = (two ^ data[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
                out[(three * 0x297A2D39 & 0xFFFFFFFF) >> 21] += 1
        out = np.sqrt(out)
        return out / (np.linalg.norm(out) or 1)

    names, code = sorted({r.lang for r in learnt}), langid.codewords(len({r.lang for r in learnt}))
    assert len(names) > 1 and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3
    a = np.array([[*grams(r.text).astype(np.float32).astype(float), 1.0] for r in learnt])
    inverse = np.linalg.inv(a.T @ a + 0.01 * np.eye(a.shape[1]))
    weights, trust = [], []
    for bit in range(code.shape[1]):
        y = np.array([code[names.index(r.lang), bit] for r in learnt])
        w = inverse @ (a.T @ y)
        right = min(max(float((np.sign(a @ w) == y).mean()), 0.5), 0.999)
        weights.append(w)
        trust.append(np.log(right / (1 - right)) / np.log(999) + 1e-3)
    got = {r.doc_id: r for r in langid.identify(sample, langid.train(sample)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        x = np.append(grams(r.text), 1.0)
        loss = [sum(t * np.log1p(np.exp(-3 * float(x @ w) * c)) for w, t, c in zip(weights, trust, word, strict=True)) for word in code]
        best = min(range(len(names)), key=lambda i: loss[i])
        score = 1 / sum(np.exp(loss[best] - v) for v in loss)
        assert got[r.doc_id].lang_pred == names[best] and got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 0), (2, "123 !", "en", 0), (3, "hello there", "en", 0), (None, "guten tag", None, 0)], "doc_id long, text string, lang string, score int")
    model = langid.fit(np.stack([langid.ngram_vector(t) for t in ("the house", "das haus")]), ["en", "de"])
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[1].score) == ("und", "und", 0.0) and got[3].lang_pred in ("en", "de") and got[None].held_out
    assert langid.identify(docs, langid.train(docs.where("false"))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.where("false"), model).count() == 0
    long = "abc é " * 300_000
    assert np.allclose(np.linalg.norm(langid.ngram_vector(long)), 1)
    code = langid.codewords(6)
    assert ((code[:, None] != code[None]).sum(2)[~np.eye(6, dtype=bool)] >= 3).all()


# -- 6 exact ----------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_brute_force(spark):
    texts = ["a", "b", "a", None, "", "A", "a " * 9000] + ["hot"] * 60
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs_of(spark, texts)).collect()) == [1, 2, 4, 5, 6, 66]


def test_exact_dedup_edges(spark):
    df = docs_of(spark, ["x", "x", "x", "y", "y"], [None, 5, 5, None, None])
    got = sorted((r.text_sha256 == hashlib.sha256(b"y").hexdigest(), r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(False, 0, 5, 3, False), (False, 5, 5, 3, False), (False, 5, 5, 3, True), (True, 0, 0, 2, False), (True, 0, 0, 2, True)]
    assert exact_dedup.exact_groups(df.where("false")).count() == 0
    assert exact_dedup.filter_bits(10**12) == exact_dedup.MAX_BITS and exact_dedup.filter_bits(0) == exact_dedup.MIN_BITS


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(5, "A", 1), (9, "A", 2), (5, "B", 3), (7, "C", 4), (7, "D", 5), (None, "E", 6), (None, "F", 7), (None, "F", 7), (8, "G", 8), (8, "G", 8), (None, None, 9), (3, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for bits in (exact_dedup.MAX_BITS, exact_dedup.MIN_BITS):
        got = sorted(exact_dedup.exact_dedup(df, bits).collect(), key=str)
        assert got == sorted([(9, "A", 2), (5, "B", 3), (7, "C", 4), (7, "D", 5), (None, "E", 6), (None, "F", 7), (8, "G", 8), (3, "", 10)], key=str)
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def test_filled_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 64)
    df = docs_of(spark, [f"t{i // 2}" if i < 200 else f"u{i}" for i in range(600)])
    a, b = (sorted(exact_dedup.exact_groups(df, bits).collect()) for bits in (64, 1 << 20))
    assert a == b and sum(r.group_size == 2 for r in a) == 200


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    digests = spark.range(3000).select(F.xxhash64(F.floor(F.col("id") / 2) * (F.col("id") % 3 != 0).cast("int") + F.col("id") * 10**6 * (F.col("id") % 3 == 0).cast("int")).alias("k1")).withColumn("k2", F.xxhash64("k1"))
    bits = 1 << 16
    seen = exact_dedup.repeated_bits(digests.repartition(7), bits)
    rows = digests.collect()
    count = defaultdict(int)
    for r in rows:
        count[r.k1] += 1
    hit = {}
    for r in rows:
        at = exact_dedup.places(np.array([r.k1]), np.array([r.k2]), bits)[0].tolist()
        hit[r.k1] = all(seen[x >> 3] >> (x & 7) & 1 for x in at)
    assert all(hit[k] for k, n in count.items() if n > 1)
    assert sum(hit[k] for k, n in count.items() if n == 1) < 0.05 * len(count)
    x = np.array([0, 5, 300, 70_000, 4_000_000])
    assert exact_dedup.unpack(exact_dedup.pack(x)).tolist() == x.tolist()


# -- 7 mixing ---------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: float(capped[s]) for s in names}
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing_targets_and_words(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 17 else None, rng.choice(["a", "b", "b", "b", "b", "c", "d", None]), 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = {r.doc_id: r for r in mixing.mix(df, key_ranges=16).collect()}
    sizes = defaultdict(int)
    for i, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    for i, t, s, _ in rows:
        r = got[i]
        assert r.size == len((t or "").split()) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), key_ranges=16).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mixing_prefers_good_documents_and_repeats_whole_epochs(spark):
    df = spark.createDataFrame([(i, "a b c d", "x" if i < 400 else "y") for i in range(440)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(440)], "doc_id long, quality int")
    rows = mixing.mix(df, labels).collect()
    assert {r.taken for r in rows if r.doc_id >= 400} == {12}  # y gets three epochs at most
    picked = [r.doc_id for r in rows if r.doc_id < 400 and r.taken > 0]
    good = sum(i % 2 for i in picked)
    assert good >= 0.5 * len(picked)
    out = mixing.mixed_documents(df, labels)
    assert out.columns == df.columns and out.where("doc_id >= 400").count() == 120


def test_mixing_of_repeated_ids_agrees_in_any_order(spark):
    rows = [(i % 5, " ".join(["w"] * (i % 13)), "a" if i % 3 else "b") for i in range(200)] + [(None, f"n{i} m", "a") for i in range(40)]
    shuffled = random.Random(4).sample(rows, len(rows))
    a, b = (sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(spark.createDataFrame(x, "doc_id long, text string, source string")).collect()) for x in (rows, shuffled))
    assert a == b and len(a) == 240


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", None), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed_documents(df).count() == 0


# -- 9 neighbours -----------------------------------------------------------------------------------------------


def test_neighbours_recall_and_exact_scores(spark):
    df = common.table(spark, SF, "embeddings")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in ann.nearest(df, block=128, query_block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hit += len(set(want) & {v for v, _ in got[q]})
        assert len(got[q]) == 10 and all(s == pytest.approx(d[ids == v][0], abs=1e-12) for v, s in got[q])
    assert hit / (10 * len(got)) >= 0.9


def test_neighbours_of_a_large_clustered_table_with_a_hot_vector(spark):
    """Several lists, lists of several blocks, a vector that a third of the rows share; recall against brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 16))
    x[rng.random(6000) < 1 / 3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, block=256, query_block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(6000), d))[:10].tolist()
        assert len(got[q]) == 10
        hit += len(set(want) & set(got[q]))
    assert hit >= 0.9 * 10 * 60


def test_neighbours_of_tight_clusters_and_of_queries_apart(spark):
    """Vectors that differ by less than a code tells, and queries that lie unlike the other rows: none of the nearest is missed."""
    rng = np.random.default_rng(4)
    tight = rng.normal(size=(3, 16))[rng.integers(0, 3, 3000)] + 1e-4 * rng.normal(size=(3000, 16))
    apart = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    apart[::100] = rng.normal(size=(30, 16))
    for x in (tight, apart):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in ann.nearest(df, block=512, rerank=16).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        for q in range(0, 3000, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            assert got[q] == np.lexsort((np.arange(3000), d))[:10].tolist()


def test_packed_codes_and_tables():
    rng = np.random.default_rng(5)
    codes, centres, q = rng.integers(0, 16, (50, 5), np.uint8), rng.normal(size=(5, 16, 2)), rng.normal(size=(3, 9))
    packed, tables = ann.pack_codes(codes), ann.byte_tables(q, centres)
    score = sum(tables[:, j][:, packed[:, j]] for j in range(packed.shape[1]))
    wide = np.column_stack([q, np.ones(3)]).reshape(3, 5, 2)
    want = np.array([[sum(wide[i, m] @ centres[m, c[m]] for m in range(5)) for c in codes] for i in range(3)])
    assert np.allclose(score, want, atol=1e-4)


def test_neighbours_edges(spark):
    v = [0.0, 1.0, 0.5, 2.0]
    bad = [None, [0.0] * 4, [1.0, float("nan"), 0.0, 0.0], [1.0, float("inf"), 0.0, 0.0], [1.0, None, 0.0, 0.0], [1.0]]
    rows = [(0, v, 1)] + [(i, v, 1) for i in range(30, 10, -1)] + [(40 + i, b, 1) for i, b in enumerate(bad)] + [(100, [5.0, 1.0, 0.0, 0.0], 1), (None, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got[:10] == [(0, k, 10 + k) for k in range(1, 11)]  # ties by the smaller id
    assert [g[0] for g in got[10:]] == [100] * 10
    assert ann.nearest(df.where("false")).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 100)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 100), (100, 0)]


# -- 10 packing -------------------------------------------------------------------------------------------------


def check_packing(pieces, texts, capacity):
    encode = packing.encoder()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    for d, t in enumerate(texts):
        ids = np.append(encode(t or ""), 0).astype("<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by_seq


def test_packing_is_a_partition_with_little_padding(spark, sample):
    texts = [r.text for r in sample.orderBy("doc_id").collect()] + [None, "", "hi <|endoftext|> there", "naïve 你好 \n\n  x"]
    seqs = check_packing(packing.pack(docs_of(spark, texts).coalesce(1)).collect(), texts, 1024)
    total = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) * 1024 - total < 1024
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_tokens_equal_the_tokenizers_library(sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in sample.limit(40).collect()] + ["", " ", "\n \n\tx  y", "a\u00a0b\u2003c\u0085d", "don't 123 ½ ٣ <|endoftext|>!", "\U0001f600 e\u0301 한국어 \x00\x1f"]
    for x in texts:
        assert packing.encoder()(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_tokens_of_random_strings_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(9)
    ranges = [(32, 127), (0, 32), (160, 600), (0x400, 0x500), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640), (0x2000, 0x2030), (0x300, 0x340)]
    for _ in range(3000):
        x = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(40)))
        assert packing.encoder()(x).tolist() == t.encode(x, add_special_tokens=False).ids


def brute_deal(lengths, capacity):
    """Every open sequence is looked at for every piece."""
    pieces, rests, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        for i in range(n // capacity):
            pieces.append((d, i * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rests.append([d, n // capacity * capacity, n % capacity])
    need = -(-sum(r[2] for r in rests) // capacity)
    cost, used = [0.0] * need, [0] * need
    for d, start, n in sorted(rests, key=lambda r: -r[2]):
        while n:
            fits = [s for s in range(need) if capacity - used[s] >= n] or [s for s in range(need) if used[s] < capacity]
            s = min(fits, key=lambda s: (cost[s], s))
            take = min(n, capacity - used[s])
            pieces.append((d, start, take, n_seq + s, used[s]))
            used[s], cost[s], start, n = used[s] + take, cost[s] + take + take * take / 1024, start + take, n - take
    return pieces


def test_packing_equals_brute_force(spark):
    rng = random.Random(8)
    for capacity, most in ((1024, 3000), (64, 90), (7, 20)):
        lengths = [rng.randint(1, most) for _ in range(300)]
        assert packing.deal(lengths, capacity) == brute_deal(lengths, capacity)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(60)]
    got = packing.pack(docs_of(spark, texts).coalesce(1), 64).collect()
    encode = packing.encoder()
    want = brute_deal([len(encode(t)) + 1 for t in texts], 64)
    least = min(r.sequence_id for r in got)
    assert sorted((r.doc_id, r.start, r.length, r.sequence_id - least, r.offset) for r in got) == sorted(want)


def test_packing_of_repeated_and_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (1, "c", 5), (None, "d e f", 5), (None, None, 5)], "doc_id long, text string, length int")
    got = packing.pack(df).collect()
    assert sorted(r.doc_tokens for r in got) == sorted(len(packing.encoder()(t or "")) + 1 for t in ("a b", "a b", "c", "d e f", None))
    assert sum(r.doc_id is None for r in got) == 2


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randint(1, 900) for _ in range(400)]
    pieces = packing.deal(lengths)
    cost, used = defaultdict(float), defaultdict(int)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 1024
        used[s] += n
    assert sum(used.values()) == sum(lengths) and max(used.values()) <= 1024 and len(used) == -(-sum(lengths) // 1024)
    first_fit = []
    for n in lengths:
        for s in first_fit:
            if sum(s) + n <= 1024:
                s.append(n)
                break
        else:
            first_fit.append([n])
    spread = lambda c: np.std(c) / np.mean(c)
    assert spread(list(cost.values())) < spread([sum(x + x * x / 1024 for x in s) for s in first_fit])
    assert packing.deal([]) == [] and packing.deal([1024, 1]) == [(0, 0, 1024, 0, 0), (1, 0, 1, 1, 0)]
