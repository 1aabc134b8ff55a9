"""Near-duplicate documents by MinHash, verified on full sets, and their connected components.

1. Every document's set of distinct word shingles is sketched by ``HASHES``
   minima of universal hash functions.  Documents with equal sets form a class
   and only its smallest doc_id goes on.
2. ``HASHES / ROWS`` bands of ``ROWS`` minima are bucket keys.  Two documents of
   similarity 0.8 miss each other in all bands with a chance of 5e-8.
3. In each bucket the smallest document is paired with the others.  Pairs whose
   signatures agree in less than ``LEAST_AGREEMENT`` (6 standard deviations below
   0.8, a chance of 1e-8 for a pair of 0.8, below that of the bands) are dropped, the rest is verified on the full sets; components follow by
   large-star and small-star.
4. Buckets that still hold several components are looked at member by member, in
   blocks, but not two blocks of one component: first by signatures, which leaves
   the members that agree well enough with one of another component, then these
   on the full sets, pair by pair, until their components are joined.  So a link
   that changes a component is lost only by the two chances named above.  Of a
   group, tasks return members and the links that join its components, never
   pairs: no more rows than they read.

Defined results: a document without words (or null text) has an empty set and is
linked with nothing; rows that repeat a doc_id share its component; a row without
doc_id is linked with nothing and has no component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import hold, plain_names, release
from .stars import components
from .words import WordHasher, batch_names, mix

HASHES, ROWS = 128, 4
LEAST_AGREEMENT = 0.58
SHINGLE, PERCENT = 5, 80
#: Rows that meet in one step of a task, rows of a task, salts of a group of equal sets.
BLOCK, TASK_ROWS, TASK_TEXTS, SALTS = 512, 16_384, 2_048, 64

_U = np.uint64
_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text; fewer words than ``width`` make one shingle."""
    names, ends = batch_names(WordHasher(lower=True), texts)
    out = []
    for first, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        w = names[first:end]
        n = min(width, len(w))
        if not n:
            out.append(w)
            continue
        h = np.full(len(w) - n + 1, n, _U)
        for k in range(n):
            h = mix(h * _U(0x9E3779B97F4A7C15) + w[k : k + len(h)])
        out.append(np.unique(h))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of the hash functions (a x + b) mod 2**64, upper half."""
    out = np.full(HASHES, 2**32 - 1, _U)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[at : at + 1024, None] * _A + _B) >> _U(32)).min(0), out=out)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands, signature): set size, 128-bit digest of the set, bucket keys, minima (16 bits each)."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                minima = np.array([signature(s) for s in sets])
                keys = np.full((len(sets), HASHES // ROWS), 0, _U) + np.arange(HASHES // ROWS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * _U(0xA24BAED4963EE407) + minima[:, r::ROWS])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([m.astype("<u2").tobytes() for m in minima], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "bands", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, signature binary")


def _tasks(rows: DataFrame, total: int, per_task: int, *key: str) -> DataFrame:
    return rows.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(max(1, -(-total // per_task)))))


def _groups(*keys: np.ndarray):
    """Row indices of each combination of keys."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return np.split(order, np.flatnonzero(change)[1:]) if len(order) else []


def _verify(width: int, percent: int):
    """Rows (job, host or guest, component, text): which components have a linked host and guest in the same job."""
    def run(t: pa.Table) -> pa.Table:
        sets = shingle_sets(t["text"].to_pylist(), width)
        job = [t[c].to_numpy() for c in ("a", "i", "j")]
        host, component = t["host"].to_numpy(zero_copy_only=False), t["component"].to_numpy()
        found = set()
        for rows in _groups(*job):
            hosts, guests = rows[host[rows]], rows[~host[rows]]
            if not len(hosts) or not len(guests):
                continue
            sizes = np.array([len(sets[h]) for h in hosts])
            names = np.concatenate([sets[h] for h in hosts])
            order = np.argsort(names, kind="stable")
            names, owner = names[order], np.repeat(np.arange(len(hosts)), sizes)[order]
            for g in guests.tolist():
                mine = sets[g]
                first, end = np.searchsorted(names, mine), np.searchsorted(names, mine, "right")
                count = end - first
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                common = np.bincount(owner[at], minlength=len(hosts))
                linked = np.flatnonzero(100 * common >= percent * (sizes + len(mine) - common))
                found.update((int(component[h]), int(component[g])) for h in hosts[linked].tolist())
        columns = list(zip(*((a, b) for a, b in found if a != b))) or [(), ()]
        return pa.table({"u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64())})

    return run


def _linked(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among ``rows`` (a, i, j, host, component, text)."""
    rows = hold(rows)
    links = hold(_tasks(rows, rows.count(), TASK_TEXTS, "a", "i", "j").groupBy("task").applyInArrow(
        _verify(width, percent), "u long, v long").distinct())
    release(rows)
    return links


def _near(t: pa.Table, minima: str):
    """Rows of buckets (block pairs): a row and those of the other block, of other components, whose signatures agree well enough.

    With ``bands``, two rows count in the first bucket only that they share.
    """
    signatures = np.frombuffer(b"".join(t[minima].to_pylist()), "<u2").reshape(t.num_rows, HASHES)
    component, chunk = t["component"].to_numpy(), t["chunk"].to_numpy()
    key, i, j = t["key"].to_numpy(), t["i"].to_numpy(), t["j"].to_numpy()
    bands = pc.list_flatten(t["bands"]).to_numpy().reshape(t.num_rows, -1) if "bands" in t.column_names else None
    for rows in _groups(key, i, j):
        alone = i[rows[0]] == j[rows[0]]  # a block with itself: each pair once
        left, right = rows[chunk[rows] == i[rows]], rows[chunk[rows] == j[rows]]
        for x in left.tolist():
            other = right[(component[right] != component[x]) & (right > x if alone else True)]
            if len(other):
                near = other[(signatures[other] == signatures[x]).sum(1) >= LEAST_AGREEMENT * HASHES]
                if bands is not None:
                    near = near[bands[x][(bands[near] == bands[x]).argmax(1)] == key[x]]
                if len(near):
                    yield x, near


def _agreeing(t: pa.Table) -> pa.Table:
    """The rows of ``t`` that agree well enough with a row of another component: no more than came in, however many pairs they make."""
    chosen = np.zeros(t.num_rows, bool)
    for x, near in _near(t, "signature"):
        chosen[x] = chosen[near] = True
    return t.select(["key", "component", "signature", "chunk", "i", "j", "node"]).filter(pa.array(chosen)).rename_columns(
        ["key", "component", "minima", "chunk", "i", "j", "node"])


def _joining(width: int, percent: int):
    """Rows of ``_agreeing`` with their texts: links on the full sets, as few as join the components that are linked."""
    def run(t: pa.Table) -> pa.Table:
        _, first, own = np.unique(t["node"].to_numpy(), return_index=True, return_inverse=True)
        sets = shingle_sets(t["text"].take(pa.array(first)).to_pylist(), width)
        names, at = np.unique(t["component"].to_numpy(), return_inverse=True)
        label = np.arange(len(names))  # of each component: one of those it is joined with so far
        found = []
        for x, near in _near(t, "minima"):
            near = near[label[at[near]] != label[at[x]]]
            if not len(near):
                continue
            mine, theirs = sets[own[x]], [sets[k] for k in own[near]]
            sizes, each = np.array([len(s) for s in theirs]), np.concatenate(theirs)
            hit = mine[np.minimum(np.searchsorted(mine, each), len(mine) - 1)] == each
            common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for y in near[100 * common >= percent * (sizes + len(mine) - common)].tolist():
                if label[at[x]] != label[at[y]]:
                    label[label == label[at[y]]] = label[at[x]]
                    found.append((names[at[x]], names[at[y]]))
        columns = list(zip(*found)) or [(), ()]
        return pa.table({"u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    sketched = hold(sketches(docs, width))
    salted = sketched.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    usable = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = hold(usable.groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "signature"), "doc_id").alias("s")))
    rows = hold(salted.select("doc_id", "n", "d1", "d2", "salt"))
    release(sketched)
    signatures = classes.select(F.col("rep").alias("node"), "s.signature")

    # Buckets with more than one class, their smallest member, and all members.
    banded = classes.select(F.explode("s.bands").alias("key"), F.col("rep").alias("node"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = hold(banded.join(buckets, "key"))

    pairs = members.where("node <> centre").select("centre", "node").distinct()
    theirs = signatures.select(F.col("node").alias("centre"), F.col("signature").alias("own"))
    pairs = pairs.join(signatures, "node").join(theirs, "centre")
    # Agreement of two signatures: equal 16-bit minima, compared natively as hexadecimal groups.
    four = F.sequence(F.lit(1), F.lit(4 * HASHES), F.lit(4))
    pairs = pairs.withColumns({"x": F.hex("signature"), "y": F.hex("own")})
    agree = F.size(F.filter(four, lambda p: F.substr("x", p, F.lit(4)) == F.substr("y", p, F.lit(4))))
    pairs = hold(pairs.where(agree >= LEAST_AGREEMENT * HASHES).select("centre", "node").distinct())

    # Texts of the documents that share a bucket with another, one row per class.
    wanted = members.select("node").distinct()
    texts = hold(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi"))

    # Stars: each centre meets its partners, at most BLOCK of them at once.
    counts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    guests = pairs.join(counts, "centre").select(
        F.col("centre").alias("a"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("i"), "node", F.lit(False).alias("host"))
    hosts = counts.select(F.col("centre").alias("a"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"),
                          F.col("centre").alias("node"), F.lit(True).alias("host"))
    star_rows = guests.unionByName(hosts).join(texts, "node").select(
        "a", "i", F.lit(0).alias("j"), "host", F.col("node").alias("component"), "text")
    links = _linked(star_rows, width, percent)
    found = hold(components(links))

    # Buckets that still hold several components.
    labelled = members.select("key", "node").join(found, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = several.where("lo < hi").select("key")
    open_rows = hold(labelled.join(several, "key").join(classes.select(F.col("rep").alias("node"), "s.signature", "s.bands"), "node"))
    # Blocks of a bucket: a component of more than BLOCK members has its own, which do not meet each other; the others share blocks.
    parts = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "own", F.when(F.col("size") > BLOCK, F.col("component")))
    groups = parts.groupBy("key", "own").agg(F.sum("size").alias("size"), F.ceil(F.sum("size") / BLOCK).cast("int").alias("chunks"))
    bucket = Window.partitionBy("key")
    groups = groups.withColumns({
        "first": (F.sum("chunks").over(bucket.orderBy("own")) - F.col("chunks")).cast("int"),
        "others": (F.sum("chunks").over(bucket) - F.when(F.col("own").isNull(), 0).otherwise(F.col("chunks"))).cast("int")})
    groups = hold(groups)
    theirs = groups.select(F.col("key").alias("k"), F.col("own").alias("o"), "chunks", "first", "others")
    places = parts.join(theirs, (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("o"))).drop("k", "o", "size")
    chunked = open_rows.join(places, ["key", "component"]).withColumn(
        "chunk", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int"))
    chunked = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    chunked = chunked.withColumn("other", F.col("other") + F.when(
        F.col("own").isNotNull() & (F.col("other") >= F.col("first")), F.col("chunks")).otherwise(0))
    chunked = chunked.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).select(
        "key", "component", "signature", "bands", "chunk", "i", "j", "node")
    meeting = groups.agg(F.sum(F.col("size") * F.col("others")).alias("n")).first()["n"] or 0  # rows of chunked
    near = hold(_tasks(chunked, meeting, TASK_ROWS, "key", "i", "j").groupBy("task").applyInArrow(
        _agreeing, "key long, component long, minima binary, chunk int, i int, j int, node long"))

    # The same blocks once more, with what is left in them, on the full sets.
    more = hold(_tasks(near.join(texts, "node"), near.count(), TASK_TEXTS, "key", "i", "j").groupBy("task").applyInArrow(
        _joining(width, percent), "u long, v long").distinct())
    final = hold(components(links.unionByName(more)))

    # Back to the rows: class by (digest, salt), so that many copies are many groups.
    named = classes.select("d1", "d2", "n", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        "d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    salts = rows.where("n > 0 AND doc_id IS NOT NULL").select("d1", "d2", "n", "salt").distinct()
    by_salt = salts.join(named, ["d1", "d2", "n"])
    out = rows.join(by_salt, ["d1", "d2", "n", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    release(texts, members, open_rows, groups, near, pairs)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: all columns, one document of each component."""
    dropped = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    plain, new = plain_names(docs)
    return plain.join(dropped, F.col(new["doc_id"]).cast("long") == F.col("dropped_id"), "left_anti").toDF(*docs.columns)
