"""Fuzzy line dedup by MinHash (DataFrame functions only).

Signature: one 64-bit hash of each shingle (a run of SHINGLE UTF-8 bytes) is
turned and masked into BANDS * ROWS orders, and the least value of each order is
kept: six turns of the hash's upper half, three masks each, so that the orders
look at different bits. Longer lines are signed by a sample of their shingles,
chosen by the hash (KINDS); the lengths of the kinds overlap by as much as like
lines can differ, so two like lines always have a signature of the same kind.

Banding: ROWS minima are a band. A group of lines that share a band is compared
in full up to SMALL lines. A larger one is compared with its pivot (smallest
key); if its lines lie in more than one component it is split by further
minima, its own and those of a second signature, in CHAINS different orders, at
all levels at once: each part is compared like a group. Lines behind a common
template part where a minimum is their own. Of lines that agree in all minima
the first of each component meets the others, or they are split by another
signature first if these are too many.

Candidates that agree in too few minima to be alike are dropped; of the others
the exact Jaccard similarity of their sets of SHINGLE characters decides.
Distributed union-find makes components, of which the first line stays.

Scale: signing is one pass in whole-stage code with map-side combine on the
line's 128-bit key, so copies of a line are one row before any shuffle. Links
grow with the members of a group, not with its pairs. The second pass fetches
the lines that are repeated or candidates, and their places, at once. Joins are
on keys that may be hot (a line, a band); they stand below aggregates with
map-side combine, so that Spark's adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_columns, tidy_shuffles
from .components import connected_components

SHINGLE = 10
SIMILARITY = 0.8
BANDS, ROWS = 6, 3
TURNS, MASKS = range(0, 30, 5), (0, 0x55555555, -0x55555556)
#: (least bytes, most bytes, mask): lines of such a length are signed by the shingles whose hash has zeros under the mask.
KINDS = ((0, 80, 0), (64, 400, 3), (320, 1 << 31, 15))
#: Minima of BANDS * ROWS that candidates agree in. Of lines of similarity 0.8, one pair of a hundred agrees in fewer.
AGREE = 10
#: Lines of a group that are compared with each other.
SMALL = 8
#: Orders of the further minima that split a larger group, and minima of a step.
CHAINS, STEP = 2, 3
#: What a blank line has only.
BLANKS = " \t\n\x0b\f\r"
#: Bytes a character: texts are cut in UTF-32, where a substring needs no search.
WIDE = 4


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line, k1, k2 of each line that isn't blank. text_key tells rows of one doc_id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.ltrim("line", F.lit(BLANKS)) != "").withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def orders(h: Column) -> Iterator[Column]:
    """The hash (int) in BANDS * ROWS orders."""
    for turn in TURNS:
        turned = F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 32 - turn)) if turn else h
        for mask in MASKS:
            yield turned.bitwiseXOR(F.lit(mask).cast("int"))


def signatures(lines: DataFrame, seed: int = 0, kinds: tuple[tuple[int, int, int], ...] = KINDS) -> DataFrame:
    """k1, k2, kind, copies, sig array<int>: how often each line occurs, and its signature of each kind it has. The first shingle is in every sample, for the count."""
    fits = [F.when(F.octet_length("line").between(lo, hi - 1), F.struct(F.lit(k).alias("kind"), F.lit(mask).cast("long").alias("mask"))) for k, (lo, hi, mask) in enumerate(kinds)]
    of_kind = lines.select("k1", "k2", F.col("line").cast("binary").alias("bytes"), F.explode(F.array_compact(F.array(*fits))).alias("as"))
    seeds = [F.lit(seed)] if seed else []
    places = F.sequence(F.lit(1), F.greatest(F.octet_length("bytes") - SHINGLE + 1, F.lit(1)))
    at = of_kind.select("k1", "k2", "as", "bytes", F.explode(places).alias("at"))
    hashed = at.select("k1", "k2", "as", F.xxhash64(*seeds, F.substring("bytes", F.col("at"), F.lit(SHINGLE))).alias("h"), (F.col("at") == 1).alias("start"))
    kept = hashed.where(F.col("start") | (F.col("h").bitwiseAND(F.col("as.mask")) == 0))
    kept = kept.select("k1", "k2", "as.kind", "start", F.shiftright("h", 32).cast("int").alias("h"))
    minima = kept.groupBy("k1", "k2", "kind").agg(F.count_if("start").alias("copies"), *(F.min(x).alias(f"m{j}") for j, x in enumerate(orders(F.col("h")))))
    return minima.select("k1", "k2", "kind", "copies", F.array(*(f"m{j}" for j in range(BANDS * ROWS))).alias("sig"))


def groups_of(members: DataFrame) -> DataFrame:
    """members(group, key, ...) -> the members of groups of two different keys and more, with n (members) and low (smallest key)."""
    groups = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").drop("high")
    return members.join(groups.hint("shuffle_hash"), "group")


def band_groups(signed: DataFrame) -> DataFrame:
    """group, key (k1), kind, n, low: the lines that share a band with others."""
    band = [F.xxhash64("kind", F.lit(i), *(F.get("sig", F.lit(ROWS * i + j)) for j in range(ROWS))) for i in range(BANDS)]
    return groups_of(signed.select(F.col("k1").alias("key"), "kind", F.explode(F.array(*band)).alias("group")))


def pairs_in(groups: DataFrame) -> DataFrame:
    """a, b, kind: all pairs of groups of up to SMALL, and the pairs with the smallest key of larger ones; of several kinds the one of most shingles.

    groups(group, key, kind, n, low) may have comp and low_comp: then only pairs of different components.
    """
    comp, low_comp = (F.col("comp"), F.col("low_comp")) if "comp" in groups.columns else (F.col("key"), F.col("low"))
    keys = groups.where(F.col("n") <= SMALL).groupBy("group", "kind").agg(F.array_sort(F.collect_list(F.struct("key", comp.alias("comp")))).alias("keys"))
    of = lambda x, y: F.when(x.comp != y.comp, F.struct(x.key.alias("a"), y.key.alias("b")))
    pairs = F.array_compact(F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.lit(SMALL)), lambda y: of(x, y)))))
    few = keys.select("kind", F.explode(pairs).alias("p")).select("p.a", "p.b", "kind")
    many = groups.where((F.col("n") > SMALL) & (comp != low_comp)).select(F.col("low").alias("a"), F.col("key").alias("b"), "kind")
    return few.unionByName(many).groupBy("a", "b").agg(F.min("kind").alias("kind"))


def likely(both: DataFrame, agree: int = AGREE) -> DataFrame:
    """The rows whose signatures sig_a and sig_b agree in enough minima."""
    same = reduce(Column.__add__, ((F.get("sig_a", F.lit(j)) == F.get("sig_b", F.lit(j))).cast("int") for j in range(BANDS * ROWS)))
    return both.where(same >= agree)


def shingles(line: Column, ascii_: Column) -> Column:
    """The shingles of a line, repeats included; one shorter than a shingle is one. ascii_: whether a character is a byte here; both of a pair must be taken alike."""

    def of(chars: Column, wide: int) -> Column:
        at = lambda x: F.sequence(F.lit(1), F.greatest(F.octet_length(x) - SHINGLE * wide + 1, F.lit(1)), F.lit(wide))
        # the encoded line is bound to a variable: a column would be copied from its row again for every shingle
        return F.get(F.transform(F.array(chars), lambda x: F.transform(at(x), lambda i: F.xxhash64(F.substring(x, i, F.lit(SHINGLE * wide))))), F.lit(0))

    return F.when(ascii_, of(line.cast("binary"), 1)).otherwise(of(F.encode(line, "UTF-32"), WIDE))


def alike(s: Column, t: Column, similarity: float) -> Column:
    """Whether the exact Jaccard similarity of two arrays' sets is high enough. What s has alone tells most unlike ones:
    s has no more elements than its array, and the more it had, the higher the similarity could be."""
    alone = F.size(F.array_except(s, t))
    enough = lambda m, more: m - alone >= similarity * (m + more)
    return F.when(enough(F.size(s), F.lit(0)), enough(F.size(F.array_distinct(s)), F.size(F.array_except(t, s)))).otherwise(False)


def measured(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b (k1), node_a, node_b (k1, k2), like of the likely ones of pairs(a, b, kind): whether their sets of shingles are similar enough.

    texts(k1, k2, kind, line, sig) has each line once a kind. It is a checkpoint:
    the optimiser would put the sets into the condition of a filter on it.
    """
    of = lambda c: texts.select(F.col("k1").alias(c), "kind", F.struct("k1", "k2").alias(f"node_{c}"), F.col("line").alias(f"line_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = likely(pairs.join(of("a"), ["a", "kind"]).join(of("b"), ["b", "kind"]))
    plain = (F.octet_length("line_a") == F.length("line_a")) & (F.octet_length("line_b") == F.length("line_b"))
    sets = both.select("a", "b", "node_a", "node_b", shingles(F.col("line_a"), plain).alias("s"), shingles(F.col("line_b"), plain).alias("t"))
    return checkpointed(sets.select("a", "b", "node_a", "node_b", alike(F.col("s"), F.col("t"), similarity).alias("like")))


def verified(sized: DataFrame) -> DataFrame:
    """Edges (a, b) of (k1, k2) keys: those of measured() that are alike."""
    return sized.where("like").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def components_of(edges: DataFrame) -> DataFrame:
    """k1, k2, p1, p2: lines with their components."""
    return checkpointed(connected_components(edges).select("node.k1", "node.k2", F.col("component.k1").alias("p1"), F.col("component.k2").alias("p2")))


def links_of(parts: DataFrame) -> DataFrame:
    """Edges (a, b) of lines and their components: they stand for all links that made these."""
    return parts.select(F.struct("k1", "k2").alias("a"), F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("b")).where("a <> b")


def with_components(members: DataFrame, parts: DataFrame) -> DataFrame:
    """members(key, ...) with comp, the component of the key's line."""
    comps = parts.groupBy(F.col("k1").alias("key")).agg(F.min("p1").alias("comp"))
    return members.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def open_groups(members: DataFrame) -> DataFrame:
    """members(group, key, comp, ...) of groups with more than one component, with n, low and low_comp of the smallest key."""
    stats = F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.min_by("comp", "key").alias("low_comp"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    groups = members.groupBy("group").agg(*stats).where("lo <> hi").drop("lo", "hi")
    return members.join(groups.hint("shuffle_hash"), "group")


def drawn(lines: DataFrame, draw: int) -> DataFrame:
    """k1, k2, kind (-draw), line, sig: lines(k1, k2, line) signed anew, by all shingles."""
    signed = signatures(lines, draw, ((0, 1 << 31, 0),)).drop("kind", "copies")
    return lines.join(signed, ["k1", "k2"]).select("k1", "k2", F.lit(-draw).alias("kind"), "line", "sig")


def parts_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members(group, key, kind, comp) in the parts of their groups: those of equal minima, STEP more a level, in CHAINS different orders. All levels at once."""
    sig = members.join(texts.select(F.col("k1").alias("key"), "kind", "sig"), ["key", "kind"])
    rows = sig.select("key", "kind", "comp", "sig", F.explode(F.array(*(F.xxhash64("group", "kind", F.lit(c)) for c in range(CHAINS)))).alias("level0"))
    rows = rows.withColumn("at", F.pmod("level0", F.lit(BANDS * ROWS)).cast("int"))
    levels = range(1, BANDS * ROWS // STEP + 1)
    for i in levels:
        further = (F.get("sig", F.pmod(F.col("at") + STEP * (i - 1) + j, F.lit(BANDS * ROWS))) for j in range(STEP))
        rows = rows.withColumn(f"level{i}", F.xxhash64(f"level{i - 1}", *further))
    return rows.select("key", "kind", "comp", F.explode(F.array(*(f"level{i}" for i in levels))).alias("group"))


def split_further(large: DataFrame, texts: DataFrame, sized: DataFrame, similarity: float) -> DataFrame:
    """The components of lines. large(group, key, kind): groups that were compared with one pivot only; sized: the pairs measured so far."""
    parts = components_of(verified(sized))
    rows = checkpointed(open_groups(with_components(large, parts)).select("group", "key", "kind", "comp"))
    draw, before = 0, None
    while n := rows.count():
        draw += 1
        keys = rows.select(F.col("key").alias("k1")).distinct()
        own = texts.join(keys, "k1", "left_semi")
        again = drawn(own.select("k1", "k2", "line").distinct(), draw)
        own = checkpointed(own.unionByName(again) if draw == 1 else again)  # first both by the kind's minima and by others
        kinds = F.array("kind", F.lit(-draw)) if draw == 1 else F.array(F.lit(-draw))
        members = rows.select("group", "key", "comp", F.explode(kinds).alias("kind")).distinct()
        more = measured(own, pairs_in(open_groups(parts_of(members, own))).join(sized.select("a", "b"), ["a", "b"], "left_anti"), similarity)
        sized = sized.unionByName(more)
        new = verified(more)
        if new.head(1):
            parts = components_of(links_of(parts).unionByName(new))
        # what agrees in all minima
        same = own.where(F.col("kind") == -draw).select(F.xxhash64("sig").alias("group"), F.col("k1").alias("key"), "kind").distinct()
        rows = checkpointed(open_groups(with_components(same, parts)).select("group", "key", "kind", "comp"))
        firsts = rows.groupBy("group", F.col("comp").alias("of")).agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("m"))
        sizes = firsts.groupBy("group").agg((F.count(F.lit(1)) * F.sum("m")).alias("pairs"), F.sum("m").alias("m"))
        pairs, left = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if left and (pairs <= SMALL * left or before is not None and n > before // 2):  # the first line of each component meets the others
            meet = rows.join(firsts.drop("m"), "group").where("comp <> of").select("a", F.col("key").alias("b"), "kind").distinct()
            return components_of(links_of(parts).unionByName(verified(measured(own, meet, similarity))))
        before = n
    return parts


def fetched(lines: DataFrame, signed: DataFrame, keys: DataFrame) -> DataFrame:
    """at (doc_id, text_key, line_no), k1, k2, line of the lines that occur more than once or whose k1 is in keys; line is null for the others."""
    repeated = signed.where("copies > 1").select("k1", F.lit(False).alias("text"))
    wanted = repeated.unionByName(keys.select("k1", F.lit(True).alias("text"))).groupBy("k1").agg(F.bool_or("text").alias("text"))
    rows = lines.select(F.struct("doc_id", "text_key", "line_no").alias("at"), "k1", "k2", "line").join(wanted.hint("shuffle_hash"), "k1")
    return rows.select("at", "k1", "k2", F.when(F.col("text"), F.col("line")).alias("line"))


def like_lines(lines: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The components of like lines (k1, k2, p1, p2), and the places (see fetched()) of all lines that are repeated or may be like others."""
    signed = checkpointed(signatures(lines))
    groups = checkpointed(band_groups(signed))
    places = checkpointed(fetched(lines, signed, groups.select(F.col("key").alias("k1"))))
    texts = places.where("line is not null").select("k1", "k2", "line").distinct()
    texts = checkpointed(signed.drop("copies").join(texts.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "kind", "line", "sig"))
    sized = measured(texts, pairs_in(groups), similarity)
    return split_further(groups.where(F.col("n") > SMALL).select("group", "key", "kind"), texts, sized, similarity), places


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, gone array<int>: the numbers of the lines that go, in order, for documents that lose any."""
    with tidy_shuffles(docs.sparkSession):
        parts, places = like_lines(numbered_lines(doc_columns(docs, "doc_id", "text")), similarity)
        rows = places.select("at", "k1", "k2").join(parts.hint("shuffle_hash"), ["k1", "k2"], "left").select("at", F.coalesce("p1", "k1").alias("k1"), F.coalesce("p2", "k2").alias("k2"))
        rows = checkpointed(rows)
        firsts = rows.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last or first is null").drop("last")
        gone = rows.join(firsts.hint("shuffle_hash"), ["k1", "k2"]).where(~F.col("at").eqNullSafe(F.col("first")))
        return checkpointed(gone.groupBy("at.doc_id", "at.text_key").agg(F.array_sort(F.collect_set("at.line_no")).alias("gone")))


def without(lines: Column, gone: Column) -> Column:
    """The lines but those of the numbers gone, in order: these are laid out as a row of bytes, which is looked up by place."""
    steps = F.transform(gone, lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get(gone, i - 1)).otherwise(-1) - 1), F.lit("1")))
    mask = F.array_join(steps, "").cast("binary")
    # bound to a variable: else it is laid out again for every line
    return F.get(F.transform(F.array(mask), lambda at: F.filter(lines, lambda _, i: F.substring(at, i + 1, F.lit(1)) != F.lit(b"1"))), F.lit(0))


def marked(docs: DataFrame, similarity: float) -> tuple[DataFrame, Column]:
    """docs joined with the numbers of the lines that go (_gone), and the text that stays."""
    gone = removed_lines(docs, similarity).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("gone").alias("_gone"))
    rows = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left")
    left = F.array_join(without(F.split(docs["text"], "\n"), gone["_gone"]), "\n")
    return rows, F.when(gone["_gone"].isNull(), docs["text"]).otherwise(left)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) with the lines gone from text that are like an earlier one; all columns and rows stay.

    Lines are split at ``\\n`` and compared as they are; the first of a component
    by (doc_id, place of the text, line) stays. Blank lines always stay. Null
    text stays null; a document may be left with an empty text. Null ids come
    first. Rows that repeat doc_id and text lose the same lines. No documents: no
    rows.
    """
    rows, left = marked(docs, similarity)
    return rows.select(*(left.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns))


def line_digest(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 of the text that dedup_lines() leaves (null counts as empty, of one line)."""
    docs = doc_columns(docs, "doc_id", "text")
    rows, left = marked(docs, similarity)
    text = F.coalesce(docs["text"], F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select(docs["doc_id"], n_lines.alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"), F.sha2(F.coalesce(left, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
