"""The registered queries of the training-data operators, their SQL, and the pipeline stage by stage."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from echoweave.llm import common, mixing, packing, quality, queries, simhash

from ..conftest import SF
from ..test_queries import TABLES, plain
from .test_llm import brute_components, brute_lines


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    out = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(out.columns)
    assert plain(df.collect(), df.columns) == plain(out.fetchall(), out.columns)


def test_stages(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    columns, kept = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mix_sources", "packing"]
    assert kept[1] < kept[0] and kept[2] == kept[1] and kept[3] < kept[2]
    encode = packing.encoder()
    assert sum(r.length for r in docs.collect()) == sum(len(np.append(encode(r.text or ""), 0)) for r in before.collect())


def test_empty_documents(spark):
    docs = common.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_equals_plain_python(spark, tmp_path):
    """All five stages over a small corpus: scores text by text, all pairs of lines and of texts, the mix by SQL, tokens document by document."""
    rng = random.Random(12)
    quality_of = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    every = sorted((r for r in common.table(spark, SF, "documents").collect() if r.text and len(r.text) < 4000), key=lambda r: r.doc_id)
    source = [r for q, n in ((1, 30), (0, 30), (None, 10)) for r in [r for r in every if quality_of.get(r.doc_id) == q][:n]]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    line = "a line of some length that stands in many documents, such as a notice of rights"
    for i, r in enumerate(rows[:12]):  # copies, near copies, and lines that repeat
        words = r[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((5000 + i, r[1] if i < 4 else " ".join(words) if i < 8 else f"{r[1]}\n{line}", r[2], r[3], 0))
    rows += [(6000, "", "en", "web", 0), (6001, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    common.table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = quality.train(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels"))
    scores = model.score_texts(pa.array([r[1] for r in rows], pa.string()))
    kept = sorted((r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD), key=lambda r: r[0])
    assert 20 < len(kept) < len(rows)
    texts = brute_lines([r[1] for r in kept])
    assert sum(t != r[1] for t, r in zip(texts, kept, strict=True)) > 3
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    like = brute_components([(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] == set() or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i]])
    left = [(kept[i][0], texts[i], kept[i][2], kept[i][3], len(texts[i] or "")) for i in range(len(texts)) if like.get(i, i) == i]
    assert len(left) < len(kept)

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", left)
    con.execute(f"create view labels as select * from '{SF}/labels.parquet'")
    want = {}
    for r in con.sql(mixing.MIX_SQL).df().itertuples():
        if r.taken and (times := int(r.taken / r.size + 0.5)):
            want[r.doc_id] = times
    encode = packing.encoder()
    tokens = {d: np.append(encode(t or ""), 0) for d, t, *_ in left}
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    for d, mine in got.items():
        assert {p.doc_tokens for p in mine} == {len(tokens[d])} and sum(p.length for p in mine) == want[d] * len(tokens[d])
        assert sum(p.start == 0 for p in mine) == want[d]
        assert all(p.ids_crc32 == zlib.crc32(tokens[d][p.start : p.start + p.length].astype("<u4").tobytes()) for p in mine)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 1024
