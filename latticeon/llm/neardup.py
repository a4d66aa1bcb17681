"""Near duplicates by b-bit MinHash.

A document's set holds its distinct two-word shingles (A-Z lower-cased, words split at ASCII
blanks), as 64-bit fingerprints. From 128 minima come 32 band keys of 4 minima each and a
packed signature of the two lowest bits of each minimum. Documents with equal sets are one
node. Nodes that share a band are candidates; the similarity estimated from matching fields,
corrected for chance matches (``J = (E - C) / (1 - C)``, ``C = 2^-b``), drops the
hopeless ones, and the rest is confirmed on the full sets.

No group is expanded into pairs:

1. in each band bucket every member is compared with the bucket's smallest node only; a node
   confirms the most similar such centre; confirmed links are merged into components;
2. buckets that still hold several components are cut into blocks; block pairs compare
   signatures across components, and only pairs that may reach the threshold are
   confirmed on full sets. A bucket of over 4096 nodes (a passage that many documents share) is first split
   into buckets of two, then three bands, which go through step 1 again.

Pairs within a component add nothing to it, so the components are those of all links
between candidates. A pair at the threshold shares a band with probability
1 - (1 - 0.75^4)^32 = 0.999995, and one that meets in a large bucket shares a further one with 0.99999. Buckets
of three bands are compared whole, whatever their size.

Hot copy groups are merged by partial aggregation and mapped back by a broadcast of
at most 1000 groups. Intermediate tables are kept in the shared folder.

Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null id are linked with
nothing and kept (component null). Rows with the same id are one document for linking: the links of any of its texts are its own.
Equal rows are one node. An empty table gives no rows.

Joins on a hot bucket, centre or group have one row of that key on their other side, so that adaptive execution may split
them; no group is ever collected but in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, enter, keeps, materialise, to_text, tune

BANDS, ROWS, BITS = 32, 4, 2
K = BANDS * ROWS
THRESHOLD = 75
#: An estimate so far below the threshold (4.5 standard errors) is never of a linked pair.
LEAST_ESTIMATE = 0.54
BLOCK = 256
#: Buckets of more nodes are split by a second and third band before nodes are compared with each other.
LARGE, DEPTH = 4096, 3
HOT_GROUPS = 1000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_P = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HASHES = BoundedCache(xxhash.xxh3_64_intdigest, 300_000)
keeps("neardup", _HASHES.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct shingles; one for a single word."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) == 1:
        return _mix(h + _M2)
    a, b = h[:-1], h[1:] * _M2
    return np.unique(_mix(a * _M1 + (b ^ (b >> np.uint64(31)))))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(1), out=out)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """The two lowest bits of each minimum, in K * BITS / 64 words."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    k = (m.reshape(BANDS, ROWS).astype(np.uint64) * _P).sum(1, dtype=np.uint64)
    return _mix(k + np.arange(1, BANDS + 1, dtype=np.uint64) * _M2)


def matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal fields of packed signatures, along the last axis."""
    d = x ^ y
    return K - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1)


def estimate(equal):
    c = 2.0**-BITS
    return (equal / K - c) / (1 - c)


def least_matches() -> int:
    c = 2.0**-BITS
    return int(np.ceil(K * (LEAST_ESTIMATE * (1 - c) + c)))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


_SKETCH = pa.struct([("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def sketch_column(text: str = "text") -> Column:
    @F.arrow_udf("struct<n:long,fp:binary,sig:array<long>,bands:array<long>>")
    def sketch(t: pa.Array) -> pa.Array:
        enter("neardup")
        n, fp, sig, bands = [], [], [], []
        for x in t:
            s = shingle_set(x.as_py())
            n.append(len(s))
            if len(s):
                m = minima(s)
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(pack(m).view(np.int64))
                bands.append(band_keys(m).view(np.int64))
            else:
                fp.append(None)
                sig.append(None)
                bands.append(None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], fields=list(_SKETCH))

    return sketch(to_text(text))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node that can be reached.

    Alternating large-star and small-star steps; each writes its edges to the shared folder.
    """
    stars = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = state(stars)
    while now[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        stars = materialise(small)
        after = state(stars)
        if after == now:
            break
        now = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _equal_fields(x: str, y: str) -> Column:
    total = F.lit(0)
    for i in range(K * BITS // 64):
        d = F.get(F.col(x), F.lit(i)).bitwiseXOR(F.get(F.col(y), F.lit(i)))
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(K) - total


def _size_ok() -> Column:
    return F.lit(100) * F.least("na", "nb") >= F.lit(THRESHOLD) * F.greatest("na", "nb")


def _confirm(a: pa.Array, b: pa.Array) -> pa.Array:
    enter("neardup")
    kept: dict[str, np.ndarray] = {}

    def of(t: str) -> np.ndarray:
        s = kept.get(t)
        if s is None:
            if len(kept) > 64:
                kept.clear()
            s = kept[t] = shingle_set(t)
        return s

    return pa.array([linked(of(x.as_py()), of(y.as_py())) for x, y in zip(a, b)], pa.bool_())


def _verify(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of pairs (a, b) those whose full sets are linked."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter(F.col("id").isNotNull() & F.col("t").isNotNull()).join(ids, "id", "left_semi")
    side = lambda n: texts.select(F.col("id").alias(n), F.col("t").alias("t" + n))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    confirm = F.arrow_udf("boolean")(_confirm)
    return joined.filter(confirm("ta", "tb")).select("a", "b").distinct()


_BLOCK_PAIRS = "a long, b long"


def _compare_blocks(batches):
    """Rows of two blocks of one bucket -> pairs of different components that may be linked."""
    floor = least_matches()
    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        out_a, out_b = [], []
        for i in range(batch.num_rows):
            x, y = left[i].values, right[i].values
            ids = [np.asarray(v.field("id")) for v in (x, y)]
            comps = [np.asarray(v.field("c")) for v in (x, y)]
            sizes = [np.asarray(v.field("n")) for v in (x, y)]
            sigs = [np.asarray(v.field("sig").flatten()).view(np.uint64).reshape(len(v), -1) for v in (x, y)]
            for k in range(len(ids[0])):
                ok = (comps[1] != comps[0][k]) & (ids[1] != ids[0][k]) & (matches(sigs[1], sigs[0][k]) >= floor)
                ok &= 100 * np.minimum(sizes[1], sizes[0][k]) >= THRESHOLD * np.maximum(sizes[1], sizes[0][k])
                hit = np.flatnonzero(ok)
                out_a.append(np.minimum(ids[1][hit], ids[0][k]))
                out_b.append(np.maximum(ids[1][hit], ids[0][k]))
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _star(level: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id) that share a bucket, and each node's most similar centre of one."""
    buckets = level.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).filter("size > 1").select("key", "centre")
    shared = materialise(level.join(buckets, "key").select("key", "id", "centre"))
    star = shared.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda n: nodes.select(F.col("id").alias(n), F.col("n").alias("n" + n), F.col("sig").alias("sig" + n))
    star = star.join(side("b"), "b").join(side("a"), "a").withColumn("equal", _equal_fields("siga", "sigb")).filter((F.col("equal") >= least_matches()) & _size_ok())
    best = star.groupBy("b").agg(F.max(F.struct("equal", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")
    return shared.select("key", "id"), materialise(best)


def _block_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (key, id, c, size) -> pairs of different components c whose signatures may be of linked sets."""
    rows = rows.join(nodes, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)))
    blocks = materialise(rows.groupBy("key", "block").agg(F.collect_list(F.struct("id", "c", "n", "sig")).alias("m")))
    left, right = blocks.select("key", F.col("block").alias("i"), F.col("m").alias("x")), blocks.select("key", F.col("block").alias("j"), F.col("m").alias("y"))
    return left.join(right, "key").filter("i <= j").select("x", "y").mapInArrow(_compare_blocks, _BLOCK_PAIRS).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each input row. Ids must be integers."""
    tune(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sketch_column(text).alias("s"))
    sketches = materialise(base.select("doc_id", "s.n", "s.fp", "s.sig", "s.bands"))

    some = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    groups = some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    groups = materialise(groups)
    nodes = groups.select(F.col("rep").alias("id"), "n", "sig")
    bands = groups.select(F.col("rep").alias("id"), "bands")

    # Ids whose rows differ in their sets: the groups of such an id belong together.
    several = sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("rows"), F.count("fp").alias("full"))
    several = materialise(several.filter("full > 0 AND (lo <> hi OR full < rows)").select("doc_id"))
    links = some.join(several, "doc_id", "left_semi").select("doc_id", "fp").distinct().join(groups.select("fp", "rep"), "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    level = bands.select(F.explode("bands").alias("key"), "id")
    pairs = None
    for depth in range(DEPTH):
        # Members against the smallest node of their bucket.
        shared, best = _star(level, nodes)
        links = materialise(links.union(_verify(best, docs, doc_id, text)))
        known = connected_components(links)
        # Buckets that still hold several components: small ones are compared whole, large ones split by a further band.
        labelled = shared.join(known.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
        mixed = materialise(mixed)
        small = mixed.filter(F.col("size") <= large) if depth < DEPTH - 1 else mixed
        found = _block_pairs(labelled.join(small, "key"), nodes)
        pairs = found if pairs is None else pairs.union(found)
        if depth == DEPTH - 1 or mixed.filter(F.col("size") > large).isEmpty():
            break
        hot = labelled.join(mixed.filter(F.col("size") > large).select("key"), "key", "left_semi").select("key", "id").join(bands, "id")
        hot = hot.select("id", "key", F.explode("bands").alias("other")).filter("key <> other")
        level = materialise(hot.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "id").distinct())
    more = _verify(materialise(pairs.distinct()), docs, doc_id, text)
    whole = materialise(connected_components(links.union(more)))

    final = groups.select("fp", "rep", "copies").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "copies", F.coalesce("component", "rep").alias("component"))
    total = sketches.count()
    hot = final.filter(F.col("copies") > max(10_000, total // HOT_GROUPS)).select("fp", F.col("component").alias("hot"))  # fewer than HOT_GROUPS rows
    rows = sketches.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(F.broadcast(hot), "fp", "left")
    # Rows without a set have the component of their id's other rows, if there are any.
    of_id = several.join(whole, several["doc_id"] == whole["node"]).select("doc_id", "component")
    bare = rows.filter("fp IS NULL").join(of_id, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    known = rows.filter("fp IS NOT NULL AND hot IS NOT NULL").select("doc_id", "n", F.col("hot").alias("component"))
    rest = rows.filter("fp IS NOT NULL AND hot IS NULL").join(final.select("fp", "component"), "fp").select("doc_id", "n", "component")
    out = bare.unionByName(known).unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near duplicates stays: that with the smallest id.

    Rows with a null id and rows without words stay. Rows are told apart even where ids
    repeat: of rows that share an id and are no near duplicates each stays, of equal rows one.
    """
    n = docs.agg(F.count(doc_id).alias("rows"), F.count_distinct(doc_id).alias("ids")).first()
    row = doc_id
    if n["rows"] > n["ids"]:
        row = _fresh("__row", docs.columns)
        # Numbered in the order of the ids; the random number spreads a hot id over several partitions.
        order = docs.withColumn(row, F.rand(17)).repartitionByRange(doc_id, row).sortWithinPartitions(doc_id, row)
        docs = materialise(order.withColumn(row, F.when(F.col(doc_id).isNotNull(), F.monotonically_increasing_id())))
    key = _fresh("__gone", docs.columns)
    gone = near_duplicates(docs, row, text).filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    out = docs.join(gone, F.col(row) == F.col(key), "left_anti")
    return out if row == doc_id else out.drop(row)


def _fresh(name: str, taken) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
