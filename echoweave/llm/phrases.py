"""Phrase collocations: frequent word sequences, scored by how seldom their parts occur without each other.

Texts are read once, in blocks of about BLOCK_BYTES: a block is its words as
numbers of its own, with breaks between pieces, and its different words with
their counts. Words that occur LEAST times in their language get ids; a block's
other words become breaks, for no phrase that counts can hold them. Sequences of
2 ids, then of 3 and 4, are packed into KEY_BYTES-byte keys, big-endian and
padded with zeros; a block sorts its keys by radix and counts runs. The runs are
dealt by key range, with bounds from a sample of them, sorted there by radix and
counted once more. Keys that occur LEAST times go back to the blocks they came
from, and only sequences whose every two neighbours are frequent are packed as
longer keys.

Scale: nothing is broadcast and no dictionary is held whole; what a block needs
of it comes by a shuffle of the block's own different words and keys. A word or
phrase of any frequency is counted once a block. The blocks are shuffled twice,
as packed ids; keys move as packed arrays, one for each block and range that
have any in common. A range has about RANGE_KEYS keys, so its task's memory is
bounded, and one bound of 16 bytes a range reaches the driver. Candidates - sequences of LEAST occurrences and more - are joined
with their parts by key; a part in very many candidates is a join that Spark's
adaptive execution splits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns, tidy_shuffles

LEAST, MAX_WORDS = 30, 4
#: A longer phrase takes the place of one in it that occurs at most 100 / OUTWEIGHS as often.
OUTWEIGHS = 80
SCORE_SCALE, TOP = 2_000_000, 2000
#: Text of a block.
BLOCK_BYTES = 8 << 20
KEY_BYTES = 4 * MAX_WORDS
#: Keys of a range, about, and one of how many is a sample for the bounds.
RANGE_KEYS, SAMPLE = 1 << 20, 1000
#: A language's phrases are cut to the first of each of so many parts before they meet.
SALTS = 64
BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
NO_LANG = "und"
BLOCK_SCHEMA = "block long, ids binary, words array<struct<lang:string,word:string,n:long>>"


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, the bytes of a kind together, compressed."""
    return zstandard.ZstdCompressor(1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(text, lang) -> block, ids (squeezed: word i of the block as i + 1, 0 between pieces), words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, dict[bytes, int]] = {}
        ids, langs, held = [], [], 0

        class Numbered(dict):
            def __missing__(self, word: bytes) -> int:
                langs.append(self.lang)
                self[word] = n = len(langs)
                return n

        def flush() -> pa.RecordBatch:
            nonlocal block, numbers, ids, langs, held
            every = np.concatenate([np.array(x, np.uint32) for x in ids])
            counts = np.bincount(every, minlength=len(langs) + 1)[1:]
            words: list = [None] * len(langs)
            for known in numbers.values():
                for word, n in known.items():
                    words[n - 1] = word.decode()
            rows = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])
            out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([squeeze(every)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(langs)], pa.int32()), rows)], names=["block", "ids", "words"])
            block, numbers, ids, langs, held = block + 1, {}, [], [], 0
            return out

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if lang not in numbers:
                    numbers[lang] = Numbered()
                    numbers[lang].lang = lang
                number, now = numbers[lang].__getitem__, []
                data = (text.as_py() or "").encode().lower()  # of bytes: A-Z alone
                for piece in BREAKS.split(data):
                    now += map(number, piece.split())
                    now.append(0)
                ids.append(now if len(now) < 64 else np.array(now, np.uint32))
                held += len(data)
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    rows = doc_columns(docs, "text", "lang").select("text", F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """words(lang, word, n) -> lang, word, f, id: dense ids from 1 of the words that occur least times."""
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = checkpointed(frequent.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    starts, total = {}, 1
    for part, n in sorted(frequent.groupBy("part").count().collect()):  # a row a partition
        starts[part] = total
        total += n
    if total > 2**32:
        raise ValueError("more frequent words than 32-bit ids")
    start = F.element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.col("part")) if starts else F.lit(0)
    return frequent.select("lang", "word", "f", (start + F.col("at")).alias("id"))


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """Order of rows by columns of 32-bit numbers, the first the highest: a radix sort by 16 bits at a time, the lowest first."""
    order = np.arange(len(digits[0]))
    for column in reversed(digits):
        for shift in (0, 16):
            digit = (column >> shift).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]  # of 16 bits, numpy's stable sort is a radix sort
    return order


def run_lengths(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of columns of 32-bit numbers as KEY_BYTES-byte keys, sorted, and their counts."""
    order = radix_order(digits)
    rows = np.zeros((len(order), MAX_WORDS), ">u4")
    for i, column in enumerate(digits):
        rows[:, i] = column[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.diff(np.append(first, len(rows)))


def pack_keys(rows: np.ndarray) -> bytes:
    """(rows, MAX_WORDS) numbers, column by column."""
    return squeeze(np.ascontiguousarray(rows.T.astype(np.uint32)).ravel())


def unpack_keys(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(data).reshape(MAX_WORDS, -1).T)


def as_bytes(rows: np.ndarray) -> np.ndarray:
    """Keys as KEY_BYTES-byte strings, whose order is that of the numbers."""
    return np.ascontiguousarray(rows, ">u4").view(f"S{KEY_BYTES}").ravel()


PACKED = "block long, many long, keys binary, n binary"


def counted(ids: np.ndarray, starts: list[tuple[np.ndarray, int]], block: int) -> pa.Table:
    """Sorted keys of the sequences of ids from the given places (places, words), with their counts: a row a length."""
    runs = [r for at, size in starts if len((r := run_lengths([ids[at + i] for i in range(size)]))[1])]
    columns = [pa.array([block] * len(runs), pa.int64()), pa.array([len(n) for _, n in runs], pa.int64()), pa.array([pack_keys(k) for k, _ in runs], pa.binary()), pa.array([squeeze(n) for _, n in runs], pa.binary())]
    return pa.table(dict(zip(("block", "many", "keys", "n"), columns, strict=True)))


def coded(block: pa.Table, known: pa.Table) -> pa.Table:
    """A block with the dictionary's ids: block, ids, and nothing else; other words are breaks. known: number, id."""
    ids = unsqueeze(block.column("ids")[0].as_py())
    to = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    to[known.column("number").to_numpy()] = known.column("id").to_numpy()
    ids = to[ids]
    ids = ids[(ids != 0) | np.append(False, ids[:-1] != 0)]  # one break where several meet
    return pa.table({"block": block.column("block"), "ids": pa.array([squeeze(ids)], pa.binary())})


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded blocks -> counted pairs of neighbours."""
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = unsqueeze(data.as_py())
            at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
            yield from counted(ids, [(at, 2)], block).to_batches()


def longer_of(block: pa.Table, pairs: pa.Table) -> pa.Table:
    """A coded block and its frequent pairs -> counted sequences of 3 to MAX_WORDS words whose neighbours are all frequent pairs."""
    ids = unsqueeze(block.column("ids")[0].as_py()).astype(np.uint64) if block.num_rows else np.zeros(0, np.uint64)
    if len(ids) < 2 or not pairs.num_rows:
        return counted(np.zeros(0, np.uint32), [], 0)
    known = np.concatenate([unpack_keys(k) for k in pairs.column("keys").to_pylist()]).astype(np.uint64)
    known = np.sort(known[:, 0] << np.uint64(32) | known[:, 1])
    both = ids[:-1] << np.uint64(32) | ids[1:]
    good = known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both
    starts = []
    for size in range(3, MAX_WORDS + 1):
        n = max(0, len(good) - size + 2)
        starts.append((np.flatnonzero(np.logical_and.reduce([good[i : i + n] for i in range(size - 1)])), size))
    return counted(ids.astype(np.uint32), starts, block.column("block")[0].as_py())


def range_bounds(packed: DataFrame) -> list[bytes]:
    """Keys that part packed(many, keys) into ranges of about RANGE_KEYS; a range holds what is above its lower bound, up to its upper one."""
    total = packed.agg(F.sum("many")).first()[0] or 0
    if total <= RANGE_KEYS:
        return []

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys in b.column(0):
                taken = np.ascontiguousarray(unpack_keys(keys.as_py())[SAMPLE // 2 :: SAMPLE], ">u4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in taken], pa.binary())], names=["key"])

    samples = packed.select("keys").mapInArrow(sample, "key binary").repartitionByRange(-(-total // RANGE_KEYS), "key")
    return sorted(bytes(r.key) for r in samples.groupBy(F.spark_partition_id()).agg(F.max("key").alias("key")).collect())[:-1]


def frequent_runs(packed: DataFrame, least: int, back: bool) -> DataFrame:
    """packed(block, many, keys, n) -> block, keys, f: a range's keys that occur least times in all with their counts, block null; to go back, those of each block too, f null."""
    packed = checkpointed(packed)
    bounds = np.array(range_bounds(packed), f"S{KEY_BYTES}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, _, keys, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, n = unpack_keys(keys), unsqueeze(n)
                ends = np.concatenate([[0], np.searchsorted(as_bytes(rows), bounds, "right"), [len(rows)]])
                full = np.flatnonzero(np.diff(ends))
                part = [slice(ends[r], ends[r + 1]) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([pack_keys(rows[p]) for p in part], pa.binary()), pa.array([squeeze(n[p]) for p in part], pa.binary())], names=["range", "block", "keys", "n"])

    def merge(parts: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in parts.column("keys").to_pylist()]
        block = np.repeat(parts.column("block").to_numpy(), [len(k) for k in keys])
        rows, n = np.concatenate(keys), np.concatenate([unsqueeze(x) for x in parts.column("n").to_pylist()]).astype(np.int64)
        order = radix_order(list(rows.T))
        rows, block, n = rows[order], block[order], n[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
        f = np.add.reduceat(n, first)
        out = [(None, pack_keys(rows[first[f >= least]]), f[f >= least].tobytes())] if (f >= least).any() else []
        if back:
            good = np.repeat(f >= least, np.diff(np.append(first, len(rows))))
            rows, block = rows[good], block[good]
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], block[order]
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            out += [(int(block[i]), pack_keys(rows[i:j]), None) for i, j in zip(start, [*start[1:], len(block)], strict=True)] if len(block) else []
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("block", pa.int64()), ("keys", pa.binary()), ("f", pa.binary())))})

    return packed.mapInArrow(split, "range int, block long, keys binary, n binary").groupBy("range").applyInArrow(merge, "block long, keys binary, f binary")


def totals_of(runs: DataFrame) -> DataFrame:
    """The counts of frequent_runs() as key, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = np.ascontiguousarray(unpack_keys(keys), ">u4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.frombuffer(f, np.int64))], names=["key", "f"])

    return runs.where("block is null").select("keys", "f").mapInArrow(run, "key binary, f long")


def word_id(key: Column, i: int) -> Column:
    """Word i (from 0) of a key; 0 beyond its last."""
    return F.conv(F.hex(F.substring(key, 4 * i + 1, 4)), 16, 10).cast("long")


def part(key: Column, start: int, size: int) -> Column:
    """The key of ``size`` words of a key from word ``start`` on."""
    return F.rpad(F.substring(key, 4 * start + 1, 4 * size), KEY_BYTES, F.lit(b"\x00"))


def gram_counts(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, f, id; grams: key, size, f of all sequences of 1 to MAX_WORDS words that occur least times; totals: lang, n)."""
    read = checkpointed(blocks(docs, block_bytes))
    words = read.select("block", F.posexplode("words").alias("number", "w")).select("block", (F.col("number") + 1).alias("number"), "w.*")
    totals = checkpointed(words.groupBy("lang").agg(F.sum("n").alias("n")))
    known = dictionary(words, least)
    ids = words.join(known.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "number", "id")
    code = checkpointed(read.select("block", "ids").groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(coded, "block long, ids binary"))
    pairs = checkpointed(frequent_runs(code.mapInArrow(pairs_of, PACKED), least, True))
    longer = code.groupBy("block").cogroup(pairs.where("block is not null").select(F.col("block").alias("of"), "keys").groupBy("of")).applyInArrow(longer_of, PACKED)
    longer = totals_of(frequent_runs(longer, least, False))
    single = known.select(F.rpad(F.unhex(F.lpad(F.hex("id"), 8, "0")), KEY_BYTES, F.lit(b"\x00")).alias("key"), "f")
    every = single.unionByName(totals_of(pairs)).unionByName(longer)
    size = sum(((word_id(F.col("key"), i) != 0).cast("int") for i in range(1, MAX_WORDS)), F.lit(1))
    return known, checkpointed(every.select("key", size.alias("size"), "f")), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(text, lang) -> lang, rank (from 1), phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 4 words.

    Words are lower-cased (A-Z) and don't cross points, commas, colons, marks or
    line ends. a is the phrase's count, l and r are those of the parts of its
    lowest-scoring cut, n the language's words, score floor(2,000,000 a / (l + r)).
    Left out are phrases within a longer one that occurs at least 0.8 times as
    often. Null text counts as empty, null lang as ``und``. Repeated rows count
    each. No frequent phrase: no rows. Other columns are ignored.
    """
    with tidy_shuffles(docs.sparkSession):
        known, grams, totals = gram_counts(docs, least, block_bytes)
        return ranked(known, grams, totals, top)


def ranked(known: DataFrame, grams: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """collocations() from the counts."""
    key = F.col("key")
    candidates = grams.where("size > 1")

    # cuts: the counts of both parts, by two joins on their keys
    cuts = reduce_union([candidates.where(F.col("size") == size).select("key", F.col("f").alias("a"), F.lit(k).alias("k"), part(key, 0, k).alias("first"), part(key, k, size - k).alias("rest")) for size in range(2, MAX_WORDS + 1) for k in range(1, size)])
    cuts = cuts.join(grams.select(key.alias("first"), F.col("f").alias("l")), "first").join(grams.select(key.alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"cast(cast({SCORE_SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # longer phrases that outweigh a phrase in them
    inner = reduce_union([candidates.where(F.col("size") == size).select(part(key, at, n).alias("key"), "f") for size in range(3, MAX_WORDS + 1) for n in range(2, size) for at in range(size - n + 1)])
    inner = inner.groupBy("key").agg(F.max("f").alias("longer"))
    outweighed = F.coalesce(100 * F.col("longer").cast("decimal(19,0)") >= OUTWEIGHS * F.col("a").cast("decimal(19,0)"), F.lit(False))
    kept = scored.join(inner, "key", "left").where(~outweighed).select("key", "a", "cut.score", "cut.l", "cut.r")

    # words of the phrases
    positions = kept.select("key", F.posexplode(F.filter(F.array(*(word_id(key, i) for i in range(MAX_WORDS))), lambda x: x != 0)).alias("at", "id"))
    spelled = positions.join(known.select("id", "lang", "word"), "id").groupBy("key").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))  # MAX_WORDS at most
    phrases = kept.join(spelled, "key").select("lang", F.concat_ws(" ", F.col("words.word")).alias("phrase"), "a", "l", "r", "score", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))

    # a language's first: of each salt first, then of all
    order = "order by score desc, a desc, phrase"
    first = phrases.withColumn("rank", F.expr(f"row_number() over (partition by lang, salt {order})")).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), sequences AS (
  SELECT lang, unnest([w[i : i + k] for k in range(0, 4) if i + k <= len(w)]) AS p FROM places
), counts AS (
  SELECT lang, p, len(p) AS size, count(*)::BIGINT AS f FROM sequences GROUP BY lang, p HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, size)) AS cut FROM counts WHERE size > 1
), scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, (({SCORE_SCALE}::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score, c.cut
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1 : c.cut] JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.cut + 1 :]
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, f, unnest([p[s : s + m - 1] for s in range(1, size - m + 2)]) AS p FROM (SELECT *, unnest(range(2, size)) AS m FROM counts WHERE size > 2)
), longer AS (
  SELECT lang, p, max(f) AS f FROM inner_parts GROUP BY lang, p
), kept AS (
  SELECT o.lang, array_to_string(o.p, ' ') AS phrase, o.a, o.l, o.r, o.score
  FROM lowest o LEFT JOIN longer g ON g.lang = o.lang AND g.p = o.p WHERE g.f IS NULL OR 100::HUGEINT * g.f < {OUTWEIGHS}::HUGEINT * o.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= {TOP}
"""
