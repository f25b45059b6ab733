"""Near-duplicate groups: b-bit MinHash signatures, a multi-index Hamming join, links confirmed on full sets.

A document's set holds hashes of its shingles. Its signature has CHUNKS * WIDTH positions of 16 bits, each the
reduced minimum of one hash function over the set. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
positions have, by the pigeonhole principle, a chunk in which at most ERRORS positions differ. The index therefore
lists every chunk under every way of leaving ERRORS positions out, and any such pair meets under some key. With 10
chunks of 5 positions and 1 error that is all pairs with up to 19 of 50 positions apart; sets of similarity 0.8
differ in 10 on average and fail to meet under any key with a probability of 2 in a million.

Pairs are never expanded within a group:
* equal sets are one representative from the start;
* keys are taken up in turns, and under each key everything is compared with one hub only, of the key's largest
  component so far, and what was linked already is left out; after the turns only pairs under a key that lie in
  different components remain, and all of these are compared, so that no link between components is lost;
* a pair is confirmed on its full sets, and only if its signatures are near enough;
* groups of many texts that are alike, but not enough to be linked, leave many pairs to compare in the end. These are
  compared block by block inside tasks, first signatures, then full sets as products of incidence matrices. Only
  links come out, one for each two components; a task holds two blocks, however large the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import dictionary, slices, utf8, words
from .components import components
from .linking import link, shared_keys, turn_of
from .scratch import table

CHUNKS, WIDTH, ERRORS = 10, 5, 1
#: Pairs whose signatures differ in so many positions or more aren't confirmed, unless `far` says otherwise: sets of
#: similarity 0.8 are that far apart with a probability of 1e-5. CHUNKS * WIDTH + 1 confirms every pair that meets.
FAR = 24
#: Columns of one product of incidence matrices, two of which (of SETS rows) are held at a time: 8 MB each.
STRIP = 1 << 12
#: Ids of one task: of signatures, and of full sets.
SIGNATURES, SETS = 2048, 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(seed: int = 1) -> np.ndarray:
    return mix(np.arange(CHUNKS * WIDTH, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case; fewer than k words are one shingle."""
    import xxhash

    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = words(data, at)
    codes, distinct = dictionary(data, starts, ends)
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    hashes = names[codes]
    n = max(0, len(hashes) - k + 1)
    grams = np.full(n, np.uint64(k))
    for i in range(k):
        grams = mix(grams * np.uint64(31) ^ hashes[i : i + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            one = np.full(1, np.uint64(b - a))
            for h in hashes[a:b]:
                one = mix(one * np.uint64(31) ^ h)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits for each hash function: its reduced minimum over the set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * factors).min(0))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature: every chunk with every ERRORS of its positions left out."""
    from itertools import combinations

    out = []
    for chunk in range(CHUNKS):
        for n, left in enumerate(combinations(range(WIDTH), WIDTH - ERRORS)):
            key = np.full(len(signatures), np.uint64(chunk * 64 + n))
            for i in left:
                key = mix(key ^ signatures[:, chunk * WIDTH + i].astype(np.uint64))
            out.append(key)
    return np.stack(out, 1)


def _texts(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.selectExpr(f"`{id_column}` AS doc_id", f"coalesce(`{text_column}`, '') AS text")


def sketches(documents: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the whole set), signature (binary) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for batch in slices(batches):
            sets = shingle_sets(*utf8(batch.column("text")), k)
            arrays = [
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([signature(s, factors).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_id", "signature"])

    kind = documents.schema[id_column].dataType.simpleString()
    return _texts(documents, id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, signature binary")


def full_sets(documents: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """id, shingles (array of long) of every document given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*utf8(batch.column("text")), k)
            places = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(places), pa.array(flat))], ["id", "shingles"])

    kind = documents.schema[id_column].dataType.simpleString()
    return _texts(documents, id_column, text_column).mapInArrow(run, f"id {kind}, shingles array<long>")


def keyed(representatives: DataFrame) -> DataFrame:
    """key, id, n, turn: a row for each key of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.array([turn_of(k) for k in range(CHUNKS * WIDTH**ERRORS)], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, CHUNKS * WIDTH)
                keys = index_keys(signatures)
                rows = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column("id").take(rows), part.column("n").take(rows), pa.array(np.tile(turns[: keys.shape[1]], part.num_rows))], ["key", "id", "n", "turn"])

    kind = representatives.schema["id"].dataType.simpleString()
    return representatives.select("id", "n", "signature").mapInArrow(run, f"key long, id {kind}, n long, turn int")


def near_signatures(pairs: DataFrame, representatives: DataFrame, far: int = FAR) -> DataFrame:
    """The pairs (a, b) whose signatures differ in fewer than `far` positions."""
    left = representatives.select(F.col("id").alias("a"), F.col("signature").alias("x"))
    right = representatives.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    kind = representatives.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in "xy")
            near = pa.array((x != y).sum(1) < far) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(near)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def blocked(rows: DataFrame, by: str, size: int) -> DataFrame:
    """Each row once for every pair (i, j) of blocks that its own block is in; blocks have about `size` ids of one `by`."""
    blocks = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    own = rows.join(blocks, by).withColumn("own", F.pmod(F.xxhash64("id", F.lit(size)), "blocks").cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def _sides(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks of a task, which are the same where a block meets itself."""
    if block["i"].iloc[0] == block["j"].iloc[0]:
        return np.arange(len(block)), np.arange(len(block))
    left = (block["own"] == block["i"]).to_numpy()
    return np.flatnonzero(left), np.flatnonzero(~left)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each two sets of distinct numbers, as products of strips of incidence matrices."""

    def held(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns (places in `common`), by column."""
        rows, values = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets]), np.concatenate(sets)
        at = np.searchsorted(common, values).astype(np.int32)
        there = common[np.minimum(at, len(common) - 1)] == values
        order = np.argsort(at[there], kind="stable")
        return rows[there][order], at[there][order]

    shared = np.zeros((len(left), len(right)), np.int64)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(common):
        return shared
    sides = held(left), held(right)
    for start in range(0, len(common), STRIP):
        strips = []
        for sets, (rows, columns) in zip((left, right), sides, strict=True):
            a, b = np.searchsorted(columns, (start, start + STRIP))
            strips.append(np.zeros((len(sets), min(STRIP, len(common) - start)), np.float32))
            strips[-1][rows[a:b], columns[a:b] - start] = 1
        shared += np.rint(strips[0] @ strips[1].T).astype(np.int64)
    return shared


def dense_links(rows: DataFrame, representatives: DataFrame, sets: DataFrame, percent: int, far: int = FAR) -> DataFrame:
    """Links (a, b) between different components among ids (key, id, component) under one key; one for each two components."""
    kind = rows.schema["id"].dataType.simpleString()

    def alike(block: pd.DataFrame) -> pd.DataFrame:
        """The ids with a partner near by signature in another component, and the least of them as their hub."""
        signatures = np.frombuffer(b"".join(block["signature"]), np.uint16).reshape(len(block), -1)
        part = pd.factorize(block["component"])[0]
        left, right = _sides(block)
        found = np.zeros(len(block), bool)
        for k in left:
            near = (part[right] != part[k]) & ((signatures[right] != signatures[k]).sum(1) < far)
            if near.any():
                found[k] = True
                found[right[near]] = True
        ids = block["id"][found]
        return pd.DataFrame({"id": ids, "hub": ids.min()} if len(ids) else {"id": [], "hub": []})

    def joined(block: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(block)
        shingles = block["shingles"].tolist()
        part = pd.factorize(block["component"])[0]
        shared = intersections([shingles[k] for k in left], [shingles[k] for k in right])
        size = np.array([len(x) for x in shingles])
        x, y = np.nonzero((100 * shared >= percent * (size[left][:, None] + size[right] - shared)) & (part[left][:, None] != part[right]))
        x, y = left[x], right[y]
        both = np.sort(np.stack([part[x], part[y]], 1), 1)
        one = np.unique(both, axis=0, return_index=True)[1]
        ids = block["id"].to_numpy()
        return pd.DataFrame({"a": np.minimum(ids[x[one]], ids[y[one]]), "b": np.maximum(ids[x[one]], ids[y[one]])})

    signed = blocked(rows.select("key", "id", "component"), "key", SIGNATURES).join(representatives.select("id", "signature"), "id")
    active = table(signed.groupBy("key", "i", "j").applyInPandas(alike, f"id {kind}, hub {kind}").distinct())
    if active.isEmpty():
        return active.select(F.col("id").alias("a"), F.col("hub").alias("b"))
    clusters = components(active.select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cluster")
    full = blocked(clusters.join(rows.select("id", "component").distinct(), "id"), "cluster", SETS).join(sets, "id")
    return full.groupBy("cluster", "i", "j").applyInPandas(joined, f"a {kind}, b {kind}").distinct()


def near_groups(documents: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", far: int = FAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z in lower case. Documents are linked when 100 * intersection >=
    percent * union of their sets of k-word shingles; a component's id is the smallest doc_id in it, whose row is kept.
    Documents without words (or with null text) are linked with nothing and kept. Ids must not be null: such rows
    come back alone, with a null component, and kept. Repeated rows of one id share one decision; where an id has
    several texts, each is linked by its own set, and full sets are those of its least text. No rows, no rows.
    """
    slim = table(sketches(documents, k, id_column, text_column))
    real = slim.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # signatures of equal sets are equal: the larger is the same
    representatives = table(real.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("signature").alias("signature")))
    index = table(shared_keys(keyed(representatives)))
    members = index.select(F.col("id").alias(id_column)).distinct()
    shown = documents.select(id_column, text_column).join(members, id_column, "left_semi")
    several = slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias(id_column))
    once = shown.join(several, id_column, "left_anti")
    repeated = shown.join(several, id_column, "left_semi").groupBy(id_column).agg(F.min(text_column).alias(text_column))
    sets = table(full_sets(once.unionByName(repeated), k, id_column, text_column))
    labels = link(index, lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m), lambda pairs: confirmed(near_signatures(pairs, representatives, far), sets, percent), lambda rows: dense_links(rows, representatives, sets, percent, far))
    of_set = representatives.join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    rest = slim.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = real.join(of_set, "set_id").select("doc_id", "n_shingles", "component_id").unionByName(rest)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(documents: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with their columns as they were; rows with a null id stay."""
    gone = near_groups(documents, k, percent, id_column, text_column).where("NOT kept").select(F.col("doc_id").alias(id_column))
    return documents.join(gone.distinct(), id_column, "left_anti")
