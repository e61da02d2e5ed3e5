"""MinHash near-dedup (operator 7): weighted Jaccard of five-word shingles with BagMinHash signatures.

A document is a bag of shingles, each weighted with its count. BagMinHash gives every shingle a Poisson process
over its weight axis, cut into the dyadic levels (0,1], (1,2], (2,4] ...: a level's points come at a rate equal to
its width, each with a time and a register. A count takes all points of the levels below it, and of the level it
ends in those whose place is not above it. A register keeps its earliest time; two bags agree in a register with
probability equal to their weighted Jaccard similarity. A process ends as soon as its time passes the latest
register, so work is about the number of shingles plus m log m.

Bands of registers give buckets. A bucket's hub is the text that meets most others over all its buckets, so the
text that copies were made from, or the one nearest to it; every other text of the bucket is verified against it,
which connects groups of near copies of any size without pairing them. What the hubs left apart is verified in
blocks: only texts of buckets that still hold more than one component, and of these only texts that share enough
shingles with any other such text to reach the similarity at all. A block is two parts of a bucket, each of about PART
shingles, and gives no more links than it has texts; a pair is looked at in the first band it shares. The work of
that last step grows with the square of such a bucket's rest, and so do the rows that are dealt to its blocks (each text
once for each part of its bucket); a block's memory does not.

Verification takes the exact multiset overlap: the k-th occurrence of a shingle in a text is an element of its own,
so multisets are sets. Classes are the components of the verified links. Shingles are 64-bit hashes; two unequal ones
are equal by chance once in 2 ** 64 pairs, which moves an overlap by one.

Texts with the same words are one node throughout, by a 128-bit hash of the words: among 10 ** 12 texts two unequal
ones meet with odds of 1 in 10 ** 14. A text of under five words is one shingle, all its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, dropped, in_small_batches, stored
from reelframe.llm.wordhash import Words, mix, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at 0.8 misses all 32 bands of 6 registers once in 17,000 cases; at 0.85 once in 3,000,000.
BANDS, ROWS = 32, 6
#: Bits of the sketch that may differ: at 0.8 a pair differs in 12.8 of 128 on average, and in more than 32 once in 10 million.
SKETCH_BITS = 32
#: Shingles of a part of a bucket.
PART = 1 << 17
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def bags(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the texts, ordered by document and shingle."""
    label, at = words.windows(n)
    doc = words.doc[at]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = sizes[short] > k
            whole[more] = mix(whole[more] + words.hash[words.first[short[more]] + k] + _U(k + 1))
        label, doc = np.concatenate([label, whole]), np.concatenate([doc, short])
    order = np.lexsort((label, doc))
    label, doc = label[order], doc[order]
    new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]) if len(label) else np.empty(0, np.int64)
    return doc[new], label[new], np.diff(np.r_[new, len(label)])


def bagminhash(doc: np.ndarray, label: np.ndarray, count: np.ndarray, docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """The m earliest times of each of the documents; infinite where there is nothing."""
    level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    number = np.repeat(np.arange(len(doc)), level + 1)
    k = np.arange(len(number)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    width = np.where(k > 0, low, 1.0)
    room = np.minimum((count[number] - low) / width, 1.0)  # the part of the level that the count covers
    seed, owner, time = mix(label[number] + k.astype(np.uint64) * _GOLD), doc[number], np.zeros(len(number))
    times = np.full(docs * m, np.inf)
    step = 0
    while len(seed):
        many = int(np.clip(20_000 // len(seed), 1, 64))
        point = mix(seed[:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64)[None, :] * _GOLD)
        gaps = -np.log(((point >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        at = np.cumsum(gaps, axis=1)
        point = mix(point)
        register = ((point >> _U(32)) * _U(m) >> _U(32)).astype(np.int64) + owner[:, None] * m
        ok = (point & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < room[:, None]
        np.minimum.at(times, register[ok], at[ok])
        step += many
        latest = times.reshape(docs, m).max(axis=1)
        on = at[:, -1] <= latest[owner]
        seed, owner, width, room, time = seed[on], owner[on], width[on], room[on], at[on, -1]
    return times.reshape(docs, m)


SIGNED = "key_a bigint, key_b bigint, n bigint, bands array<bigint>, sketch_a bigint, sketch_b bigint"


def _keys(texts: pa.Array) -> np.ndarray:
    """Two numbers for each text's sequence of words."""
    made = [hashlib.blake2b(b" ".join((t or b"").split()), digest_size=16).digest() for t in texts.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def _joined(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _signed(column: pa.Array) -> pa.Array:
    names = [c.split()[0] for c in SIGNED.split(", ")]
    column, out = _joined(column), []
    for k, words in word_hashes(column, at_most=1 << 22):
        docs = len(words.first) - 1
        keys = _keys(column.slice(k, docs))
        doc, label, count = bags(words)
        bits = bagminhash(doc, label, count, docs).view(np.uint64)
        total = np.bincount(doc, count, docs).astype(np.int64)
        band = np.zeros((docs, BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band * _GOLD + bits[:, r::ROWS])
        band = mix(band + np.arange(BANDS, dtype=np.uint64)[None, :])
        one = np.packbits((mix(bits[:, :128]) & _U(1)).astype(np.uint8), axis=1).view(np.int64)
        full = total > 0
        sizes = np.where(full, BANDS, 0)
        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(band[full].view(np.int64).ravel()))
        out.append(pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(total), bands, pa.array(one[:, 0]), pa.array(one[:, 1])], names))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(c, pa.list_(pa.int64()) if c == "bands" else pa.int64()) for c in names]))


def _elements(words: Words) -> list[np.ndarray]:
    """Each text's shingles as a sorted set: the k-th occurrence of one is an element of its own."""
    doc, label, count = bags(words)
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, label = np.repeat(doc, count), np.repeat(label, count)
    label = np.where(turn > 0, mix(label + turn.astype(np.uint64) * _GOLD), label).view(np.int64)
    order = np.lexsort((label, doc))
    return np.split(label[order], np.searchsorted(doc[order], np.arange(1, len(words.first) - 1)))


SHINGLED = "key_a bigint, key_b bigint, shingles array<bigint>"


def _shingled(column: pa.Array) -> pa.Array:
    column, out = _joined(column), []
    for k, words in word_hashes(column):
        keys = _keys(column.slice(k, len(words.first) - 1))
        some = _elements(words)
        listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in some])].astype(np.int32)), pa.array(np.concatenate(some)))
        out.append(pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), listed], ["key_a", "key_b", "shingles"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("key_a", pa.int64()), ("key_b", pa.int64()), ("shingles", pa.list_(pa.int64()))]))


def _all_shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = _shingled(batch.column("text"))
        yield pa.RecordBatch.from_arrays(made.flatten(), ["key_a", "key_b", "shingles"])


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets given as sorted arrays."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [overlap(a.values.to_numpy(), b.values.to_numpy()) >= least for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge (a, b); comp is the component's smallest node. A written table.

    Alternates large-star and small-star steps: each links neighbours to the smallest one near, until nothing moves.
    """
    edges = stored(edges.where("a != b").select("a", "b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    last = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new = stored(small, "edges")
        now = mark(new)
        dropped(edges)
        if now == last:
            nodes = new.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            out = stored(nodes.union(new.select(F.col("b"), F.col("b")).distinct()), "comps")
            dropped(new)
            return out
        edges, last = new, now


def _verify(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _verified(it, least), "a bigint, b bigint")


def _shingles_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes, from the one document that stands for each."""
    wanted = reps.join(nodes, "node").select("node", "rep", "key_a", "key_b")
    ids = wanted.select("rep").distinct()
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.rep), "left_semi")
    # A doc_id may occur with other texts too: the key tells which one is meant.
    # Not a function of a column: a join's condition on its result would be moved below it, and have it worked out twice.
    made = texts.select("text").mapInArrow(_all_shingled, SHINGLED)
    return made.join(wanted.drop("rep"), ["key_a", "key_b"]).dropDuplicates(["node"]).select("node", "shingles")


class _Block:
    """Texts of one block, gathered from Arrow batches."""

    def __init__(self, least: float):
        self.least, self.parts = least, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def links(self) -> tuple[list[int], list[int]]:
        """Pairs of similar texts that join components: no more than there are texts."""
        table = pa.Table.from_batches(self.parts).combine_chunks()
        col = lambda c: table[c].combine_chunks()
        node, root, part, n, shared = (col(c).to_numpy().copy() for c in ("node", "comp", "part", "n", "shared"))
        sketch = np.stack([col("sketch_a").to_numpy(), col("sketch_b").to_numpy()], axis=1).view(np.uint64)
        bands = col("bands").flatten().to_numpy().reshape(-1, BANDS)
        here = np.argmax(bands[0] == table["band"][0].as_py())
        lists = col("shingles")
        first = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
        values, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(len(values), bool)
        within = table["i"][0] == table["j"][0]
        found: tuple[list[int], list[int]] = ([], [])
        for a in range(len(node)):
            some = np.arange(a + 1, len(node))
            ok = root[some] != root[a]
            if not within:
                ok &= part[some] != part[a]
            some = some[ok]
            most = np.minimum(np.minimum(shared[some], shared[a]), np.minimum(n[some], n[a]))
            some = some[most >= self.least * (n[some] + n[a] - most)]
            some = some[np.bitwise_count(sketch[some] ^ sketch[a]).sum(axis=1) <= SKETCH_BITS]
            some = some[~(bands[some, :here] == bands[a, :here]).any(axis=1)]
            if not len(some):
                continue
            mark[number[first[a] : first[a + 1]]] = True
            sizes = n[some]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(first[some] - ends + sizes, sizes)
            both = np.add.reduceat(mark[number[at]].astype(np.int64), ends - sizes)
            mark[number[first[a] : first[a + 1]]] = False
            for b in some[both >= self.least * (sizes + n[a] - both)].tolist():
                if root[a] != root[b]:
                    found[0].append(int(node[a]))
                    found[1].append(int(node[b]))
                    root[root == root[b]] = root[a]
        return found


def _in_blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The links of blocks, whose rows come one after the other."""
    key, block = None, _Block(least)

    def ended() -> pa.RecordBatch:
        a, b = block.links() if block.parts else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")], axis=1)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if key != tuple(keys[lo]):
                yield ended()
                key, block = tuple(keys[lo]), _Block(least)
            block.add(batch.slice(lo, hi - lo))
    yield ended()


def _apart(placed: DataFrame, comps: DataFrame, reps: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts of one bucket that are in different components; a written table."""
    mixed = lambda df: df.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("least_n")).where("c0 != c1").select("band", "least_n")
    rows = placed.where("size > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("band", "node", "comp", "n")
    rows = stored(rows.join(mixed(rows), "band"), "open")
    # Shingles that no other open text has can't be in an overlap.
    each = shingles.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    lone = each.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("lone"))
    able = rows.join(lone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0)))
    able = able.where(F.col("shared") >= least * (F.col("n") + F.greatest("least_n", "shared") - F.col("shared"))).drop("least_n", "lone")
    able = stored(able, "able")
    dropped(rows)
    parts = able.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.sum("n") / PART).cast("int").alias("parts")).where("c0 != c1").select("band", "parts")
    dealt = able.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    full = dealt.join(reps.select("node", "sketch_a", "sketch_b", "bands"), "node").join(shingles, "node")
    blocks = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")}).drop("with", "parts")
    blocks = blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    links = stored(blocks.mapInArrow(lambda it: _in_blocks(it, least), "a bigint, b bigint"), "links")
    dropped(able)
    return links


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, key_a, key_b, n, class_id and class_size of every row; class_id is null where n is 0."""
    in_small_batches(docs.sparkSession)
    sign = F.arrow_udf(_signed, SIGNED)
    signed = stored(docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*"), "signed")
    firsts = [F.first(c).alias(c) for c in ("n", "bands", "sketch_a", "sketch_b")]
    reps = signed.where("n > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), *firsts)
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    rows = reps.select("node", "n", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    placed = stored(rows.join(sizes, "band").select("band", "node", "n", "size"), "buckets")
    central = placed.groupBy("node").agg(F.sum("size").alias("central"))
    hubs = placed.join(central, "node").groupBy("band").agg((-F.max(F.struct("central", -F.col("node")))["col2"]).alias("hub"))
    stars = placed.join(hubs, "band").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    light = reps.select("node", "n", "sketch_a", "sketch_b")
    stars = stars.join(light.alias("x"), F.col("a") == F.col("x.node")).join(light.alias("y"), F.col("b") == F.col("y.node"))
    fits = F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")
    close = F.bit_count(F.col("x.sketch_a").bitwiseXOR(F.col("y.sketch_a"))) + F.bit_count(F.col("x.sketch_b").bitwiseXOR(F.col("y.sketch_b"))) <= SKETCH_BITS
    stars = stored(stars.where(fits & close).select("a", "b"), "stars")
    nodes = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(placed.where("size > 2").select("node")).distinct()
    shingles = stored(_shingles_of(docs, reps, nodes), "shingles")
    edges = stored(_verify(stars, shingles, least), "links")
    comps = components(edges)
    more = _apart(placed, comps, reps, shingles, least)
    dropped(stars, placed)
    if more.limit(1).count():
        dropped(comps)
        comps = components(edges.union(more))
    dropped(edges, more, shingles)
    named = reps.join(comps, "node", "left").select("key_a", "key_b", F.coalesce("comp", "node").alias("comp"))
    keyed = stored(signed.select("doc_id", "key_a", "key_b", "n").join(named, ["key_a", "key_b"], "left"), "keyed")
    dropped(signed, reps, comps)
    classes = keyed.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(classes, "comp", "left")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and class_size of every row.

    A text without words (null, empty or blank) is in a class of its own row. Rows with the same words share a
    class. A null doc_id stays null; a class of only such rows has a null class_id. Other columns are ignored.
    """
    found, alone = _classed(_plain(docs), least), F.col("n") == 0
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class: that with the smallest doc_id, and of its texts in the class that with the least key.

    Rows of one doc_id and one sequence of words count as one. Rows without words, and rows whose doc_id is null,
    stay as they are, one for each of them.
    """
    found = _classed(_plain(docs), least)
    mine = found.where("n > 0 and doc_id = class_id").groupBy("comp").agg(F.min(F.struct("doc_id", "key_a", "key_b")).alias("k")).select("k.*")
    blank = found.where("n = 0 and doc_id is not null").select("doc_id", "key_a", "key_b")
    keep = stored(mine.union(blank).distinct(), "keep")
    kept = docs.join(keep.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    # Where an id occurs more than once, the words tell which of its rows stay.
    twice = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(twice, "doc_id", "left_anti").select(docs.columns)
    key = F.arrow_udf(_key_of, "key_a bigint, key_b bigint, blank boolean")
    again = kept.join(twice, "doc_id", "left_semi").withColumn("__k", key("text"))
    k = keep.select(F.col("doc_id").alias("__id"), F.col("key_a").alias("__a"), F.col("key_b").alias("__b"))
    again = again.join(k, (F.col("doc_id") == F.col("__id")) & (F.col("__k.key_a") == F.col("__a")) & (F.col("__k.key_b") == F.col("__b")), "left_semi")
    again = again.where("__k.blank").unionByName(again.where("not __k.blank").dropDuplicates(["doc_id", "__k"])).select(docs.columns)
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def _key_of(column: pa.Array) -> pa.Array:
    column = _joined(column)
    keys = _keys(column)
    blank = [not (t or b"").split() for t in column.cast(pa.binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(blank, pa.bool_())], ["key_a", "key_b", "blank"])


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_size of every document."""
    return near_duplicates(documents(spark, sf_dir))
