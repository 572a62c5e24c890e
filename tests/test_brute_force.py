"""Registered queries that SQL can't say, against plain Python over the same tables."""

import hashlib
import math
import random
import re
import struct
from collections import defaultdict

import duckdb
import numpy as np

from echoweave.plans.all import QUERIES

from .conftest import SF


def rows(sql):
    return duckdb.connect().sql(sql.replace("$", f"'{SF}/")).fetchall()


def split_words(text):
    return re.findall(r"[!-~]+|[^\x00-\x7F]", text or "")


def events():
    """user -> (event_id, type, value) in order."""
    out = defaultdict(list)
    for user, *row in rows("select user_id, event_id, event_type, value from $events.parquet' order by user_id, epoch_us(ts) // 1000, event_id"):
        out[user].append(row)
    return out


def test_repeat_filter(spark):
    want = {}
    for doc, text in rows("select doc_id, text from $documents.parquet'"):
        kept = []
        for t in split_words(text):
            single = len(t) == 1 and (0x4E00 <= ord(t) <= 0x9FFF or 0x3400 <= ord(t) <= 0x4DBF)
            if not (single and t in kept[-2:]):
                kept.append(t)
        if kept:
            want[doc] = len(kept)
    assert {r.doc_id: r.kept for r in QUERIES["repeat_filter"](spark, SF).collect()} == want


def test_greedy_chunks(spark):
    want, by = {}, defaultdict(list)
    for conv, turn, size in rows("select conv_id, turn, length(role) + length(text) + 4 from $conversations.parquet' order by conv_id, turn"):
        by[conv].append((turn, size))
    for conv, turns in by.items():
        chunks = [[]]
        for turn, size in turns:
            if chunks[-1] and sum(s for _, s in chunks[-1]) + size > 600:
                chunks.append([])
            chunks[-1].append((turn, size))
        want |= {(conv, t): i for i, c in enumerate(chunks) for t, _ in c}
    assert {(r.conv_id, r.pos): r.chunk_id for r in QUERIES["greedy_chunks"](spark, SF).collect()} == want


def test_progress_throttle(spark):
    want = set()
    for user, all_rows in events().items():
        shown = None
        for pos, (_, stage, value) in enumerate(all_rows, 1):
            at = min(value / 200, 1.0)
            if shown is None or at <= 0 or at >= 1 or shown[0] != stage or abs(at - shown[1]) >= 0.05:
                shown = (stage, at)
                want.add((user, pos, stage))
    assert {(r.user_id, r.pos, r.stage) for r in QUERIES["progress_throttle"](spark, SF).collect()} == want


def test_fnv_identity(spark):
    by = defaultdict(list)
    for conv, *content in rows("select conv_id, turn, role, text from $conversations.parquet' order by conv_id, turn"):
        by[conv].append(content)
    got = {r.conv_id: r.identity for r in QUERIES["fnv_identity"](spark, SF).collect()}
    assert len(got) == len(by)
    for conv, turns in by.items():
        h = 0xCBF29CE484222325
        for turn in turns:
            for b in ("\x1f".join("" if v is None else str(v) for v in [conv, *turn]) + "\x1e").encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        assert got[conv] == f"{h:016x}"


def test_fingerprint(spark):
    want = {i: "fp_" + hashlib.sha256(struct.pack(f"<{len(v)}f", *v)).hexdigest()[:12] for i, v in rows("select vec_id, embedding from $embeddings.parquet'")}
    assert {r.vec_id: r.fingerprint for r in QUERIES["fingerprint"](spark, SF).collect()} == want


def sentence_of(tokens):
    """(first, last) of the first sentence of (text, start, end) tokens: the shortest start that has to end, or all."""
    for n in range(1, len(tokens) + 1):
        text = "".join(t for t, _, _ in tokens[:n])
        mark, size = tokens[n - 1][0][-1:], len(text)
        ends = mark and (mark in "。？！.?!" or size >= 60 or size >= 30 and mark in "，,、；;：:")
        pause = tokens[n - 1][0] and n < len(tokens) and tokens[n][1] - tokens[n - 1][2] >= 300
        if (ends or pause) and text.strip():
            return n
    return len(tokens)


def test_sentence_split(spark):
    want = set()
    for doc, text in rows("select doc_id, text from $documents.parquet'"):
        tokens = [(t, i * 200 + i // 17 * 400, i * 200 + i // 17 * 400 + 200) for i, t in enumerate(split_words(text))]
        count = 0
        while tokens:
            n = sentence_of(tokens)
            count += 1
            want.add((doc, count, tokens[0][1], tokens[n - 1][2], n, "".join(t for t, _, _ in tokens[:n]).strip()))
            tokens = tokens[n:]
    got = {(r.doc_id, r.sentence_id, r.start_ms, r.end_ms, r.n, r.text) for r in QUERIES["sentence_split"](spark, SF).collect()}
    assert got == want and len(got) > 1000


def test_repeat_guard(spark):
    """A full stop goes if the three tokens around it, or from it on, are a phrase that stands earlier without a mark in it."""
    texts = {d: split_words(t)[:400] for d, t in rows("select doc_id, text from $documents.parquet'")}

    def brute(tokens):
        marks = [3 if i % 5 == 4 else 0 for i in range(len(tokens))]
        for i in range(1, len(tokens) - 1):
            if marks[i] and tokens[i] not in list("。？！.?!") and tokens[i] != tokens[i + 1]:
                for j in range(i):
                    if marks[j + 1] == 0 and (j >= 1 and tokens[j - 1 : j + 2] == tokens[i - 1 : i + 2] or i + 2 < len(tokens) and j + 2 < len(tokens) and tokens[j : j + 3] == tokens[i : i + 3]):
                        marks[i] = 0
                        break
        return marks

    from echoweave.operators import documents

    rng = random.Random(2)
    some = {d: t for d, t in texts.items() if len(t) < 300} | {1000 + k: [rng.choice("abc") for _ in range(rng.randint(0, 60))] for k in range(60)}
    df = spark.createDataFrame([(d, t, [3 if i % 5 == 4 else 0 for i in range(len(t))]) for d, t in some.items()], "d long, tokens array<string>, marks array<int>")
    got = {r.d: r.marks for r in documents.repeat_guard(df, ["d"]).collect()}
    assert got == {d: brute(t) for d, t in some.items()}
    assert any(brute(t) != [3 if i % 5 == 4 else 0 for i in range(len(t))] for t in some.values())
    left = {r.doc_id: r.left for r in QUERIES["repeat_guard"](spark, SF).collect()}
    assert all(left[d] == sum(m > 0 for m in brute(t)) for d, t in some.items() if d in left)


def in_days():
    """user -> (position from 1, day, event type, value) in order."""
    out = defaultdict(list)
    for user, ms, kind, value in rows("select user_id, epoch_us(ts) // 1000, event_type, value from $events.parquet' order by user_id, epoch_us(ts) // 1000, event_id"):
        out[user].append((len(out[user]) + 1, ms // 86_400_000, kind, value))
    return out


def test_pack_windows(spark):
    want = set()
    for user, tokens in in_days().items():
        found, group = [], []

        def pack(group):
            while group:
                n = max(k for k in range(1, len(group) + 1) if sum(g[1] for g in group[:k]) <= 148 and len({g[2] for g in group[:k]}) == 1)
                found.append((group[0][0], group[n - 1][0], sum(g[1] for g in group[:n]), False))  # noqa: B023
                if n == len(group):
                    return
                group = group[min(range(1, n + 1), key=lambda k: (abs(sum(g[1] for g in group[:k]) - 75), k)) :]  # noqa: B023

        for pos, day, _, value in tokens:
            size = math.ceil(value)
            if size > 148:
                pack(group)
                group, at = [], 0
                while True:
                    found.append((pos, pos, min(148, size - at), True))
                    if at + 148 >= size:
                        break
                    at += 75
            elif size > 0:
                group.append((pos, size, day))
        pack(group)
        want |= {(user, i, *w) for i, w in enumerate(found, 1)}
    got = {(r.user_id, r.window_id, r.first_pos, r.last_pos, r.frames, r.overlong) for r in QUERIES["pack_windows"](spark, SF).collect()}
    assert got == want and len({w[-1] for w in want}) >= 1


def test_endpoint_segments(spark):
    want = set()
    for user, all_rows in in_days().items():
        flags, base, speech, since, silent, count = [k != "error" for _, _, k, _ in all_rows], 0, False, None, 0, 0
        for i in range(len(flags)):
            voted = sum(flags[max(base, i - 3) : i + 1])
            was, speech = speech, voted > 2 if speech else voted >= 3
            last = None
            if speech and not was:
                since, silent = max(0, i - 2) if since is None else since, 0
            elif since is not None:
                silent = silent + 1 if not speech and not was else 0
                last = max(since, i - 1) if silent >= 2 else i if i - since >= 300 else None
            if last is not None:
                count += 1
                want.add((user, count, since * 10, max(since, last) * 10 + 10))
                base, speech, since, silent = i + 1, False, None, 0
        if since is not None:
            want.add((user, count + 1, since * 10, (len(flags) - 1) * 10 + 10))
    got = {(r.user_id, r.segment_id, r.start_ms, r.end_ms) for r in QUERIES["endpoint_segments"](spark, SF).collect()}
    assert got == want and len(got) > 20


def test_interval_batch_merge(spark):
    by = defaultdict(list)
    for user, start, end in rows("select user_id, epoch_us(ts) // 1000, epoch_us(ts) // 1000 + 3600000 * (1 + event_id % 5) from $events.parquet'"):
        by[user].append((start, end))
    want = set()
    for user, spans in by.items():
        first = min(s for s, _ in spans)
        pieces, owned = [], 0
        for a, b in sorted(((s - first) // 3600, (e - first) // 3600) for s, e in spans):
            a, b = max(owned, a), min(900_000, max(a, owned, b))
            owned = max(owned, b)
            for lo in range(a, b, 60_000):
                hi = min(b, lo + 60_000)
                full = hi - lo == 60_000 and hi < b
                stop = hi if full else min(900_000, max(hi, lo + 500))
                pieces.append((lo if full else max(0, min(lo, stop - 500)), stop, lo, hi))
        batches = []
        for p in pieces:
            if batches and p[0] - batches[-1][1] <= 1_200 and p[1] - batches[-1][0] <= 15_000:
                x = batches[-1]
                batches[-1] = (x[0], max(x[1], p[1]), x[2], p[3])
            else:
                batches.append(p)
        want |= {(user, i, *b) for i, b in enumerate(batches or [(0, 900_000, 0, 900_000)], 1)}
    got = {(r.user_id, r.batch_id, r.decode_start, r.decode_end, r.own_start, r.own_end) for r in QUERIES["interval_batch_merge"](spark, SF).collect()}
    assert got == want


def test_fbank_frames(spark):
    """A frame worked out from its definition: discrete Fourier sums and triangles one by one."""
    got = {(r.job_id, r.frame_id): r for r in QUERIES["fbank_frames"](spark, SF).collect()}
    assert len(got) > 1000
    mel = lambda hz: 1127 * math.log(1 + hz / 700)
    edges = [mel(20) + i * (mel(8000) - mel(20)) / 81 for i in range(82)]
    for job, frame in list(got)[:: len(got) // 3][:3]:
        hz = 200 + int(job) % 50 * 50
        x = [0.5 * math.sin(2 * math.pi * hz * (frame * 160 + i) / 16_000) * 32_768 for i in range(400)]
        mean = sum(x) / 400
        x = [v - mean for v in x]
        x = [v - 0.97 * x[max(0, i - 1)] for i, v in enumerate(x)]
        x = [v * (0.54 - 0.46 * math.cos(2 * math.pi * i / 399)) for i, v in enumerate(x)]
        power = [abs(sum(v * complex(math.cos(a := 2 * math.pi * k * i / 512), -math.sin(a)) for i, v in enumerate(x))) ** 2 / 4 for k in range(257)]
        bins = []
        for left, middle, right in zip(edges, edges[1:], edges[2:], strict=False):
            total = sum(p * max(0, min((mel(k * 31.25) - left) / (middle - left), (right - mel(k * 31.25)) / (right - middle))) for k, p in enumerate(power))
            bins.append(math.log(max(total, 1e-10)))
        assert got[job, frame].peak_bin == bins.index(max(bins)) and abs(got[job, frame].energy - sum(bins) / 80) < 1e-3


def test_spectral_labels(spark):
    """Of the smallest tables, which are one batch: the affinity graph, its eigenvectors and their clusters, and labels that are alike."""
    from echoweave.operators.vectors import seeded_kmeans

    vectors = dict(rows("select vec_id, embedding from $embeddings.parquet'"))
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(unit @ unit.T, 12)
    a = np.zeros_like(c)
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-c[i, j], j))[:6]:
            a[i, j] = c[i, j]
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    values, basis = np.linalg.eigh(np.diag(abs(a).sum(1)) - a)
    k = max(range(2, 9), key=lambda k: (values[k] - values[k - 1], -k))
    label = seeded_kmeans(basis[:, :k], k)
    groups = defaultdict(set)
    for i, j in zip(ids, label.tolist(), strict=True):
        groups[j].add(i)
    got = defaultdict(set)
    for r in QUERIES["spectral_labels"](spark, SF).collect():
        got[r.label].add(r.vec_id)
    whole = {frozenset(g) for g in groups.values()}
    assert sum(map(len, got.values())) == len(ids)
    # labels of like centroids may have been joined; none is cut
    assert all(any(g <= h for h in got.values()) for g in whole) and len(got) <= len(whole)


def test_live_chain(spark):
    """All of a recording at once, in plain Python, gives the tokens of its chunks."""
    from echoweave.plans.live import MODELS, SIZES
    from echoweave.streaming.live import Chain

    want = set()
    for user, all_rows in in_days().items():
        for r in Chain(MODELS, **SIZES).add({"frames": [v / 100 for _, _, _, v in all_rows], "last": True}):
            want.add((user, r["pos"], r["token"], r["start_ms"], r["end_ms"], r["mark"]))
    got = {(r.user_id, r.pos, r.token, r.start_ms, r.end_ms, r.mark) for r in QUERIES["live_chain"](spark, SF).collect()}
    assert got == want and len(got) > 20
