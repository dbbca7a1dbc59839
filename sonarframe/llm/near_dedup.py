"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each text gets its set of word shingles (64-bit hashes) and 256 minima: 64
   bands of four whole minima, and the low four bits of each minimum packed into
   a signature of 128 bytes.  At a similarity of 0.75 two sets miss each other in
   all bands with probability (1 - 0.75**4)**64 < 3e-11.
2. Rows with one set (128-bit key) become one node, so copies cost nothing more.
3. Nodes that share a band hang on the band's smallest node: rows stay linear in
   the nodes however many share a band.  Components of these links are the groups
   inside which nodes must be compared.
4. Each node is first compared with the leader of most of its bands, on full sets.
   What these links connect is a cluster, and pairs inside one needn't be compared:
   a group of near copies, however large, is mostly one cluster after this step.
5. What is left of a group, nodes beside its largest cluster, is compared with all of
   the group in blocks; the similarity estimated from differing low bits, corrected
   for bits that agree by chance, decides which pairs are confirmed on the full sets,
   and pairs already connected are skipped.  Where very many nodes are left, only
   those that share a band are compared, and of bands with the same nodes one is enough.
   A block gives a link for each merger, never all its pairs.
6. Components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import keyfilter
from sonarframe.llm import textnum as N
from sonarframe.llm.graph import components
from sonarframe.llm.shared import drop, free, id_text, settle, table, without

SHINGLE, SIMILARITY = 5, 0.75
BANDS, ROWS, BITS = 64, 4, 4
MINIMA = BANDS * ROWS
#: Pairs whose estimate is lower than the similarity by this much aren't confirmed: seven standard deviations at 256 minima, a chance of about 1e-11.
SLACK = 0.2
#: Nodes and shingles in one side of a block.
BLOCK_NODES, BLOCK_SHINGLES = 128, 1 << 18
#: Nodes that are confirmed against one copy of their leader.
STAR_NODES = 64
#: A group with more blocks beside its largest cluster is compared band by band: a row is copied once for each of its bands, not for each block.
MOST_BLOCKS = 64

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_FOLD = (_rng.integers(0, 2**63, MINIMA, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(column, k: int = SHINGLE, seeds: tuple[int, ...] = (0,)) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text the sorted distinct shingle hashes by each seed; A-Z lower-cased, fewer than k words are one shingle."""
    for part in N.slices(column, fold_case=True):
        first, last = part.word_offsets[:-1], part.word_offsets[1:]
        words = last - first
        counts = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(counts)])
        full = np.flatnonzero(words >= k)
        from_, to = N.ranges(first[full], counts[full]), N.ranges(at[full], counts[full])
        each = []
        for seed in seeds:
            hashes, out = part.word_hashes(seed), np.zeros(int(at[-1]), dtype=np.uint64)
            out[to] = N.runs(hashes, k)[from_]
            for n in range(1, k):
                some = np.flatnonzero(words == n)
                if len(some):
                    out[at[some]] = N.runs(hashes, n)[first[some]]
            each.append(out)
        for d in range(len(part)):
            yield tuple(np.unique(h[at[d] : at[d + 1]]) for h in each)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[i : i + 2048, None] ^ _XOR) * _MULTIPLY).min(axis=0), out=low)
    return low


def pack(low: np.ndarray) -> bytes:
    """The low bits of each minimum (of its mixed value, so that they're even), BITS each."""
    bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (bits[0::2] | (bits[1::2] << 4)).tobytes()


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (uint64 words), corrected for low bits that agree by chance."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for batch in batches:
        n, one, two, band, packed = [], [], [], [], []
        for s, other in shingle_sets(batch.column("text"), seeds=(0, 1)):
            n.append(max(len(s), len(other)))
            one.append(_key(s))
            two.append(_key(other))
            if len(s):
                low = minima(s)
                band.append(N.mix((low * _FOLD).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) ^ bands).view(np.int64))
                packed.append(pack(low))
            else:
                band.append(None)
                packed.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
            ["doc_id", "n_shingles", "key1", "key2", "bands", "packed"],
        )


def _key(shingles: np.ndarray) -> int:
    return int(N.mix(shingles).sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0


def _sets(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keyfilter.Filter(bits.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(wanted.maybe([batch.column("doc_id").to_numpy(zero_copy_only=False)])))
            found = [s for (s,) in shingle_sets(batch.column("text"), seeds=(1,))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["o", "key2", "shingles"])

    return run


def _similar(one: np.ndarray, other: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= per_cent * (len(one) + len(other) - both)


def _confirmed(similarity: float):
    """Of rows (b, salt, first, node, shingles) sorted so that a group's leader b comes first, links of nodes that are like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, []
        for batch in batches:
            found = []
            shingles = batch.column("shingles")
            for i, (b, salt, first, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "first", "node")))):
                if (b, salt) != group:
                    group, leader = (b, salt), []
                mine = np.frombuffer(shingles[i].as_buffer(), dtype=np.uint64)
                if first == 0:
                    if not any(np.array_equal(mine, other) for other in leader):
                        leader.append(mine.copy())
                elif any(_similar(mine, other, round(100 * similarity)) for other in leader):
                    found.append((node, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return run


def _links_in_block(nodes: list[int], clusters: list[int], left: np.ndarray, packed: list[bytes], shingles: list[bytes], both: bool, similarity: float) -> list[tuple[int, int]]:
    """A link for each merger of clusters in a block: ``left`` marks one side, and only pairs across sides are compared unless ``both``."""
    m, links = len(nodes), []
    words = np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(m, -1)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in shingles]
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flag = np.zeros(int(flat.max()) + 1, dtype=bool)
    label = np.unique(np.array(clusters), return_inverse=True)[1]
    per_cent = round(100 * similarity)
    for i in range(m):
        if not both and not left[i]:
            continue
        after = np.flatnonzero((label != label[i]) & (np.arange(m) > i if both else ~left) & (100 * np.minimum(size, size[i]) >= per_cent * np.maximum(size, size[i])))
        if not len(after):
            continue
        after = after[estimate(words[i], words[after]) >= similarity - SLACK]
        if not len(after):
            continue
        mine = flat[at[i] : at[i + 1]]
        flag[mine] = True
        shared = np.add.reduceat(flag[flat[N.ranges(at[after], size[after])]].astype(np.int64), np.cumsum(size[after]) - size[after])
        flag[mine] = False
        for j in after[100 * shared >= per_cent * (size[i] + size[after] - shared)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((nodes[i], nodes[j]))
    return links


def _blocks(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, links, seen = None, [], [], set()

        def close():
            seen.clear()
            if len(rows) > 1:
                one, other = key[1], key[2]
                links.extend(_links_in_block([r[0] for r in rows], [r[4] for r in rows], np.array([r[1] == one for r in rows]), [r[2] for r in rows], [r[3] for r in rows], one == other, similarity))
            rows.clear()

        for batch in batches:
            for g, i, j, b, node, packed, shingles, cluster in zip(*(batch.column(c).to_pylist() for c in ("part", "i", "j", "block", "node", "packed", "shingles", "cluster"))):
                if (g, i, j) != key:
                    close()
                    key = (g, i, j)
                if (node, packed) not in seen:
                    seen.add((node, packed))
                    rows.append((node, b, packed, shingles, cluster))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
                links.clear()
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """(part, node, cluster, block, others, blocks) of members (part, node, cluster, n_shingles) of parts with several clusters.

    A part's largest cluster and its other nodes are dealt to blocks of their own: blocks
    below ``others`` hold the other nodes.
    """
    sizes = members.groupBy("part", "cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    per = sizes.groupBy(F.col("part").alias("p")).agg(F.max(F.struct("n", "cluster", "s")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    per = per.select("p", F.col("m.cluster").alias("main"), blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("others"), blocks(F.col("m.n"), F.col("m.s")).alias("mains"))
    per = table(per.where("others > 0"), "blocks")
    hashed = F.xxhash64("node")
    block = F.when(F.col("cluster") == F.col("main"), F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others")))
    return members.join(per, F.col("part") == F.col("p")).select("part", "node", "cluster", block.cast("int").alias("block"), "others", (F.col("others") + F.col("mains")).alias("blocks"))


def _parts(own: DataFrame, members: DataFrame) -> DataFrame:
    """``_dealt`` of members (component, node, cluster, n_shingles): nodes that must be compared with each other are in one part at least."""
    whole = table(_dealt(members.withColumnRenamed("component", "part")), "whole")
    large = whole.where(F.col("others") > MOST_BLOCKS)
    if not large.take(1):
        return whole
    slots = large.select(F.col("node").alias("o"), "cluster").distinct().join(own, F.col("node") == F.col("o")).select("node", "cluster", "n_shingles", F.explode("bands").alias("part"))
    same = slots.groupBy("part").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    same = table(same.groupBy("n", "least", "sum").agg(F.min("part").alias("p")).select("p"), "slots")
    return whole.where(F.col("others") <= MOST_BLOCKS).unionByName(_dealt(slots.join(same, F.col("part") == F.col("p")).drop("p")))


def _with_sets(rows: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Rows (node, key2, ...) with the full sets of their texts, which are read again; ``nodes`` (a table) has all their nodes.

    A repeated row of ``source`` repeats them; groups leave them out again.
    """
    bits = rows.sparkSession.sparkContext.broadcast(keyfilter.build(nodes.select("node")))
    sets = source.where("doc_id is not null").mapInArrow(_sets(bits), "o long, key2 long, shingles binary").withColumnRenamed("key2", "k")
    return rows.join(sets, (F.col("node") == F.col("o")) & (F.col("key2") == F.col("k"))).drop("o", "k")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Null, empty and blank texts have no shingles and are linked with nothing.  Rows
    with one id are one node of the graph, and all of them are kept or none.  A row
    with a null id is linked with nothing, has a null component and is kept.
    """
    settle(docs.sparkSession)
    source = id_text(docs, id_col, text_col)
    sketches = table(source.mapInArrow(_sketches, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, packed binary"), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    nodes = table(some.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("node")), "nodes")
    held = some.join(nodes, ["key1", "key2", "n_shingles"]).where("doc_id = node").select("node", "n_shingles", "key2", "bands", "packed")
    own = table(held.dropDuplicates(["node", "n_shingles", "key2"]), "own")

    postings = own.select("node", F.explode("bands").alias("slot"))
    shared = table(postings.groupBy("slot").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("last > leader").select(F.col("slot").alias("s"), "leader"), "shared")
    near = postings.join(shared, F.col("slot") == F.col("s")).where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n"))
    near = table(near, "near")
    groups = table(components(near.select("a", "b")), "groups")
    drop(shared)
    free(docs.sparkSession)

    best = near.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select(F.col("a").alias("node"), (-F.col("m.b")).alias("b"))
    best = table(best, "best")
    per = table(best.groupBy(F.col("b").alias("leader")).agg(F.ceil(F.count("*") / STAR_NODES).cast("int").alias("salts")), "leaders")
    drop(near)
    salted = best.join(per, F.col("b") == F.col("leader")).select("b", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("first"), "node")
    leaders = per.select(F.col("leader").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("first"), F.col("leader").alias("node"))
    pairs = _with_sets(salted.unionByName(leaders).join(own.select(F.col("node").alias("own"), "key2"), F.col("node") == F.col("own")).drop("own"), groups, source)
    pairs = pairs.select("b", "salt", "first", "node", "shingles").repartition("b", "salt").sortWithinPartitions("b", "salt", "first")
    stars = table(pairs.mapInArrow(_confirmed(similarity), "a long, b long"), "stars")
    drop(best)
    drop(per)
    free(docs.sparkSession)

    clusters = table(components(stars).withColumnRenamed("component", "cluster"), "clusters")
    members = groups.join(own.select(F.col("node").alias("own"), "n_shingles"), F.col("node") == F.col("own")).join(clusters, "node", "left").select("component", "node", F.coalesce("cluster", "node").alias("cluster"), "n_shingles")
    parts = table(_parts(own, members).dropDuplicates(["part", "node"]), "parts")
    left = table(parts.select("node").distinct(), "left")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("block") < F.col("others"), F.col("blocks") - 1).otherwise(F.col("others") - 1)))
    whole = _with_sets(parts.join(own.select(F.col("node").alias("own"), "key2", "packed"), F.col("node") == F.col("own")).drop("own"), left, source)
    paired = whole.select("part", "block", "node", "cluster", "packed", "shingles", other.alias("other"))
    paired = paired.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "cluster", "packed", "shingles")
    blocks = paired.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    mergers = blocks.mapInArrow(_blocks(similarity), "a long, b long")
    links = table(components(stars.unionByName(mergers)), "links")
    for done in (stars, clusters, parts, left, groups):
        drop(done)

    result = sketches.select("doc_id", "n_shingles", "key1", "key2").join(nodes, ["key1", "key2", "n_shingles"], "left").join(links, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "doc_id"))
    result = result.select("doc_id", "n_shingles", component.alias("component_id"))
    drop(own)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` of which one document of each component stays, the one with the smallest id.

    Rows with a null id, and texts without words, stay; rows that share an id stay or go together.  An empty table stays
    empty.  A very long text is one set of shingles, as large as the text.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select("doc_id").distinct()
    return without(docs, gone, id_col)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' '))))
                      WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s FROM words
), flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
"""
