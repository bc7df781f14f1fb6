"""MinHash near-duplicates by an LSH forest.

1. Every text gets its set of five-word shingles, the set's key (equal sets have
   equal keys) and a MinHash signature of TREES x DEPTH values.  Equal sets are
   one class from here on, named by its smallest doc_id.
2. Each tree is an order of the classes: sorted by DEPTH values of the
   signature.  In the sorted order, runs of classes share a prefix of LEAST values.
   A class is paired with the one before it, with which it shares the longest
   prefix; with a head of its region (heads form a tree of FAN branches), the region
   being as deep as still holds REGION classes; and in a run of more than CROWD with
   the run's hub, the class nearest to the most frequent values: the original of a
   star of copies.  So a class has three pairs a tree, whatever its run's length.
   Pairs whose sketches (one byte of SKETCH values) are far from the threshold go.
3. The best pair of each class is confirmed on the full shingle sets; connected
   components follow; then every other pair that joins two components is
   confirmed too.  A pair inside one component can change nothing.
4. What the pairs leave open is decided exactly: the classes of runs that still hold
   several components are joined by rare shingles, as two sets of similarity 0.75
   share a shingle among the rarest of each (prefix filter).  A shingle of many
   classes is dealt out in blocks.  What joins two components is confirmed.  In a run
   of SMALL classes or fewer, which one task compares, a class goes there only if its
   sketch is near another's; in longer runs, and in those that a partition's edge
   cuts, every class does.  So no run is cut and none is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow, shuffle_partitions
from custlens.llm.wordhash import mix, shingle_sets
from custlens.session import materialise_table

TREES, DEPTH, LEAST, FAN, SKETCH = 16, 6, 2, 64, 64
#: Classes of a region that a head stands for, at least; of a run that has a hub, more than;
#: of a run whose sketches one task compares each with each.
REGION, CROWD, SMALL = 8, 16, 64
#: Rows of a block in the exact join; tasks that a key's rows are dealt to; pairs of a class
#: that go to one task; slots of shingle counts and shingle sets that one task counts.
BLOCK, SALTS, HUB, SLOTS, COUNTED = 256, 16, 256, 1 << 22, 50_000
#: 4.5 standard deviations of a 64-value estimate under 0.75.
NEAR = 0.5
_K = TREES * DEPTH
_MULT = (mix(np.arange(1, _K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(1, _K + 1, dtype=np.uint64) << np.uint64(20)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        v = x[i:i + 512, None] * _MULT
        v += _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(0), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits from the set and its size."""
    a, b = mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(), np.bitwise_xor.reduce(b) ^ np.uint64(len(shingles))], np.uint64).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key and signature (null without words)."""
    schema = "doc_id long, n_shingles long, set_key binary, signature binary"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = shingle_sets(b.column(1))
                yield as_batch([b.column(0), [len(s) for s in sets], [set_key(s) if len(s) else None for s in sets],
                                [signature(s).tobytes() if len(s) else None for s in sets]], types)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


_LABEL = ", ".join(f"v{k} long" for k in range(DEPTH // 2))


def _tree_rows(classes: DataFrame) -> DataFrame:
    schema = f"tree int, {_LABEL}, id long, sketch binary"
    types = arrow_types(schema)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, sig = b.column(0), np.stack([np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()])
            # one byte of values of all trees, the deepest first, as labels hold the others already
            order = np.arange(_K).reshape(TREES, DEPTH)[:, ::-1].T.ravel()[:SKETCH]
            bytes_ = [x.tobytes() for x in (sig[:, order] & 255).astype(np.uint8)]
            for t in range(TREES):
                own = sig[:, t * DEPTH:(t + 1) * DEPTH].astype(np.int64)
                yield as_batch([[t] * b.num_rows, *[pa.array((own[:, 2 * k] << 31) ^ own[:, 2 * k + 1]) for k in range(DEPTH // 2)], ids, bytes_], types)

    return map_arrow(classes.select("id", "signature"), run, schema)


def _prefix_changes(tree: np.ndarray, v: np.ndarray) -> dict[int, np.ndarray]:
    """depth -> whether a row's prefix of that depth differs from the row's before."""
    def differ(x):
        return np.concatenate([[True], x[1:] != x[:-1]])

    out, new = {}, differ(tree)
    for depth in range(1, DEPTH + 1):
        pair = v[(depth - 1) // 2]
        new = new | differ(pair >> 31 if depth % 2 else pair)
        out[depth] = new
    return out


def run_heads(new: np.ndarray) -> np.ndarray:
    """The row that each row of a run looks up to, itself at the run's first: its
    place in the run with the lowest digit other than 0, to the base FAN, set to 0."""
    at = np.arange(len(new))
    start = np.maximum.accumulate(np.where(new, at, 0))
    place, step = at - start, np.ones(len(new), np.int64)
    while True:
        more = (place > 0) & (place // step % FAN == 0)
        if not more.any():
            break
        step[more] *= FAN
    return start + place - place // step % FAN * step


def hubs(new: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of runs longer than CROWD and, for each, the row of its run whose
    sketch is nearest to the run's most frequent values."""
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    rows, hub = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    long = ends - starts > CROWD
    for i, j in zip(starts[long].tolist(), ends[long].tolist()):
        usual = np.array([np.bincount(c, minlength=256).argmax() for c in sketch[i:j].T])
        rows.append(np.arange(i, j))
        hub.append(np.full(j - i, i + (sketch[i:j] == usual).sum(1).argmax()))
    return np.concatenate(rows), np.concatenate(hub)


def _pairs(trees: DataFrame) -> DataFrame:
    """Pairs (edge null), the first and last row (edge 0 and 1), and the classes that
    pairs may leave open (edge 2, b the run)."""
    schema = "a long, b long, est float, edge int, spot int, sketch binary"
    types = arrow_types(schema)

    def run(batches):
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        tree, *v, ids = (t.column(k).to_numpy() for k in range(DEPTH // 2 + 2))
        sketch = np.frombuffer(b"".join(t.column(DEPTH // 2 + 2).to_pylist()), np.uint8).reshape(-1, SKETCH)
        new = _prefix_changes(tree, v)
        here = np.arange(len(ids))
        first = new[LEAST]
        run_of = np.cumsum(first) - 1
        size = np.bincount(run_of)[run_of]
        # the head of the deepest region that is large enough
        head = run_heads(first)
        for depth in range(LEAST + 1, DEPTH + 1):
            region = np.cumsum(new[depth]) - 1
            head = np.where(np.bincount(region)[region] >= REGION, run_heads(new[depth]), head)
        at = np.flatnonzero(~first)
        own, hub = hubs(first, sketch)
        child, parent = np.concatenate([at, here, own]), np.concatenate([at - 1, head, hub])
        child, parent = np.maximum(child, parent), np.minimum(child, parent)
        code = np.unique((child * len(ids) + parent)[child != parent])
        for i in range(0, len(code), 20_000):
            c, p = code[i:i + 20_000] // len(ids), code[i:i + 20_000] % len(ids)
            est = (sketch[c] == sketch[p]).mean(1).astype(np.float32)
            ok = (est >= NEAR) & (ids[c] != ids[p])
            a, b = ids[c[ok]], ids[p[ok]]
            n = len(a)
            yield as_batch([np.minimum(a, b), np.maximum(a, b), est[ok], [None] * n, [None] * n, [None] * n], types)
        # a run at the partition's edge may go on in the next one
        open_ = (size > SMALL) | (run_of == 0) | (run_of == run_of[-1])
        place = here - np.flatnonzero(first)[run_of]
        short = np.flatnonzero(~open_ & (place > 0))
        for step in range(1, SMALL):
            short = short[place[short] >= step]
            for i in range(0, len(short), 20_000):
                c = short[i:i + 20_000]
                near = c[((sketch[c] == sketch[c - step]).mean(1) >= NEAR) & (ids[c] != ids[c - step])]
                open_[near] = open_[near - step] = True
        at = np.flatnonzero(open_)
        for i in range(0, len(at), 20_000):
            m = at[i:i + 20_000]
            none = [None] * len(m)
            yield as_batch([ids[m], v[0][m] * TREES + tree[m], none, [2] * len(m), none, none], types)
        spot = TaskContext.get().partitionId()
        yield as_batch([ids[[0, -1]], ids[[0, -1]], [1.0, 1.0], [0, 1], [spot, spot], [sketch[0].tobytes(), sketch[-1].tobytes()]], types)

    return map_arrow(trees, run, schema)


def _write(df: DataFrame, name: str) -> DataFrame:
    return materialise_table(df, f"forest-{name}")


def candidate_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b) and the estimate; id and run of the classes that pairs may leave
    open.  ``classes``: id and signature."""
    spark = classes.sparkSession
    n = max(shuffle_partitions(spark), classes.count() * TREES // 1_000_000)
    order = ["tree", *[f"v{k}" for k in range(DEPTH // 2)], "id"]
    trees = _tree_rows(classes).repartitionByRange(n, *order).sortWithinPartitions(*order)
    got = _write(_pairs(trees), "pairs")
    # the first and last row of each partition: two rows per partition
    w = Window.orderBy("spot", "edge")
    ends = got.filter("edge < 2").select(
        "spot", "edge", "a", "sketch", F.lag("a").over(w).alias("b"), F.lag("sketch").over(w).alias("other"))
    ends = ends.filter((F.col("edge") == 0) & (F.col("a") != F.col("b")))
    same = F.lit(0)
    for k in range(1, SKETCH + 1):
        same = same + (F.substring("sketch", k, 1) == F.substring("other", k, 1)).cast("int")
    ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (same / F.lit(float(SKETCH))).cast("float").alias("est"))
    pairs = got.filter(F.col("edge").isNull()).select("a", "b", "est").union(ends.filter(F.col("est") >= NEAR))
    members = got.filter("edge = 2").select(F.col("a").alias("id"), F.col("b").alias("run"))
    return _write(pairs.groupBy("a", "b").agg(F.max("est").alias("est")), "candidates"), members


#: Bits of the filter that keeps the texts of unpaired classes out of the shuffle: 16
#: per id, 2^27 (16 MB) at most.  Beyond that more texts pass; the join is exact.
FILTER_BITS = 1 << 27


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the texts that ``wanted`` (id) names."""
    bits = min(FILTER_BITS, 1 << max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    filled = np.zeros(bits // 8, np.uint8)
    parts = wanted.select(place.alias("h")).groupBy((F.col("h") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits"))
    for part, own in parts.collect():
        filled[part * 4096:(part + 1) * 4096] = np.frombuffer(own, np.uint8)
    schema = "id long, shingles binary"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(1).to_numpy()
            b = b.take(pa.array(np.flatnonzero(filled[h >> 3] >> (h & 7).astype(np.uint8) & 1)))
            if b.num_rows:
                yield as_batch([b.column(0), [s.tobytes() for s in shingle_sets(b.column(2))]], types)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("id").isNotNull())
    return map_arrow(rows.select("id", place.alias("h"), "text"), run, schema).join(wanted, "id")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of similarity 0.75 and more: 100 * common >= 75 * all."""
    both = counted = _write(pairs.select("a", "b"), "unconfirmed")
    for key, name in (("a", "x"), ("b", "y")):
        # the pairs of a class of many are dealt out, with a copy of its set for each part
        many = counted.groupBy(key).count().filter(F.col("count") > HUB)
        many = many.select(key, F.ceil(F.col("count") / HUB).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        both = both.join(many, key, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("parts")
        own = sets.select(F.col("id").alias(key), F.col("shingles").alias(name)).join(many, key, "left")
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        both = both.join(own, [key, "part"]).drop("part")
    types = arrow_types("a long, b long")

    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            ok = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = 0
                if 100 * min(len(p), len(q)) >= 75 * max(len(p), len(q)):
                    s = np.sort(np.concatenate([p, q]))
                    common = int((s[1:] == s[:-1]).sum())
                ok.append(100 * common >= 75 * (len(p) + len(q) - common))
            at = np.flatnonzero(ok)
            yield as_batch([[a[i] for i in at], [b[i] for i in at]], types)

    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def _dealt_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` (with id) joined to ``few`` on ``key``, a frequent key in SALTS tasks."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(few, [key, "salt"]).drop("salt")


def crowded(members: DataFrame, comp: DataFrame) -> DataFrame:
    """id, component of the classes in runs of several components."""
    members = members.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    runs = members.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return _dealt_join(members, runs.select("run"), "run").select("id", "component").distinct()


def _counts(sets: DataFrame) -> np.ndarray:
    """log2 of the number of shingles in each of SLOTS slots; only the order by which
    the rare go first depends on it."""
    types = arrow_types("slot int, n long")

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            if b.num_rows:
                slots, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) & np.uint64(SLOTS - 1), return_counts=True)
                counts[slots.astype(np.int64)] += n
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            yield as_batch([at[i:i + 100_000], counts[at[i:i + 100_000]]], types)

    # few large tasks: each adds up all it reads before it emits a row per slot.  At most
    # SLOTS rows of a slot and a byte reach the driver
    tasks = -(-sets.count() // COUNTED) or 1
    got = map_arrow(sets.select("shingles").coalesce(tasks), run, "slot int, n long").groupBy("slot").agg(F.ceil(F.log2(F.sum("n"))).cast("byte").alias("n")).filter("n > 0").toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def exact_pairs(sets: DataFrame) -> DataFrame:
    """a, b (a < b) of different components: every pair of similarity 0.75 and more,
    and some others.  ``sets``: id, component, shingles.

    Of two sets that share c = 3 (n + m) / 7 shingles or more, in any one order of
    all shingles, the first n - c + 1 and m - c + 1 meet; c is 6/7 of the smaller
    set and 3/4 of the larger at least.  The order is rare first.
    """
    counts = _counts(sets)
    schema = "h long, id long, component long, n int, at int"
    types = arrow_types(schema)

    def run(batches):
        for b in batches:
            for i, c, raw in zip(*(x.to_pylist() for x in b.columns)):
                h = np.frombuffer(raw, np.uint64)
                k = len(h) - -(-3 * len(h) // 4) + 1
                own = h[np.argsort(counts[(h & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")[:k]]
                yield as_batch([own.view(np.int64), np.full(k, i), np.full(k, c), np.full(k, len(h)), np.arange(k)], types)

    rows = _write(map_arrow(sets.select("id", "component", "shingles"), run, schema), "rare")
    # rows of the component that most rows of a shingle are of never meet one another
    shared = rows.groupBy("h", "component").count().groupBy("h").agg(
        F.sum("count").alias("c"), F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("components")).filter("components > 1")
    shared = shared.select("h", F.col("most.component").alias("main"), F.ceil(F.col("c") / BLOCK).cast("int").alias("all"),
                           F.ceil((F.col("c") - F.col("most.count")) / BLOCK).cast("int").alias("others"))
    rows = _write(_dealt_join(rows, shared, "h"), "shared")
    hashed = F.xxhash64("id", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.filter("component <> main").select("h", every("all").alias("i"), F.pmod(hashed, F.col("others")).cast("int").alias("j"),
                                                F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = rows.select("h", F.pmod(hashed, F.col("all")).cast("int").alias("i"), every("others").alias("j"),
                    F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("ay"), "main")
    # the first shingle in common leaves no more than the rest of both
    near = F.expr("cx <> cy AND (cy = main OR x < y) AND 7 * least(nx - ax, ny - ay) >= 3 * (nx + ny)")
    met = x.join(y, ["h", "i", "j"]).filter(near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) for every id in ``links`` (a, b): large-star
    and small-star in turn; each round is written and read."""
    spark = links.sparkSession
    edges = _write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        # large star: neighbours above u look to u's smallest
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: each id's smaller neighbours, and itself, look to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = _write(small.filter("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Only doc_id and text are read.  A null text has no words; a text without
    words is linked with nothing.  A null doc_id is linked with nothing, its
    component_id is null and it is kept.  Rows that repeat a doc_id count as one
    document.  An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    docs = docs.select("doc_id", "text")
    rows = _write(sketches(docs), "sketches")
    known = rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = _write(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes")
    pairs, members = candidate_pairs(classes.select("id", "signature"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(members.select("id")).distinct()
    sets = _write(_sets(docs, _write(ids, "paired")), "sets")
    # each class's best pair, ties by hash so that no partner is favoured
    seen = pairs.select(F.col("a").alias("id"), "a", "b", "est").union(pairs.select(F.col("b").alias("id"), "a", "b", "est"))
    best = seen.groupBy("id").agg(F.max(F.struct("est", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("p"))
    best = best.select("p.a", "p.b").distinct()
    first = _write(_confirm(best, sets), "confirmed")
    comp = components(first)
    a = comp.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(best.withColumn("was", F.lit(True)), ["a", "b"], "left").filter(F.col("was").isNull()).select("a", "b")
    rest = rest.join(a, "a", "left").join(b, "b", "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = _write(_confirm(rest, sets), "confirmed")
    links = first.union(more)
    comp = components(links)
    left = _write(crowded(members, comp), "crowded")
    if not left.isEmpty():
        exact = _write(_confirm(exact_pairs(_write(sets.join(left, "id"), "crowded-sets")), sets), "confirmed")
        comp = components(links.union(exact))
    home = _write(classes.select("set_key", "id").join(comp, "id", "left").select("set_key", F.coalesce("component", "id").alias("c")), "homes")
    out = rows.select("doc_id", "n_shingles", "set_key").join(home, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
