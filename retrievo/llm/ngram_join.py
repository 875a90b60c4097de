"""N-gram Jaccard self-join with token-combination prefixes.

A document's set holds the hashes of its word n-grams. Tokens are ordered by how often a corpus-wide sketch saw them,
rare ones first. If two sets are similar enough, the first ``k`` tokens that they share both lie in their prefixes of
``n - ceil(t * n) + k`` tokens. So either one of these is of the rare class, and both sets carry it as a signature by
itself, or all ``k`` are frequent, and both carry their combination. Pairs that meet under a signature pass a length
and a parity-bitmap bound, neither of which can lose a link, and are verified on whole sets.

The combinations of a prefix grow with its square. Sets from a size on, whose prefix is too long for them, carry the
tokens of the prefix for ``k = 1`` singly instead, and so do, besides their combinations, the sets below that size that
can still be similar to one of them; any two similar sets thus carry signatures of one kind. A set of ``n`` n-grams has a
number of signatures that is linear in ``n``.

Equal sets are one node before any of this. Under each signature nodes first meet only two of its nodes; the links so
found are contracted, and then only nodes of different components meet, as links inside a component decide nothing. A
group of many near copies thus costs a multiple of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.llm import blobs
from retrievo.llm.blobs import giving_back, runs
from retrievo.llm.components import components
from retrievo.llm.words import SPACED, shingles, slices, words_of
from retrievo.staging import scratch, stage

SKETCH_BITS = 22  # counters of the token sketch: 16 MB, whatever the corpus
RARE_FLOOR = 64   # tokens seen more often than this, and than four times the mean counter, are the frequent class
COMBINE = 2       # k: tokens of a frequent-class combination
PREFIX = 64       # sets with a longer prefix carry single tokens only
YIELD = 1 << 20   # signatures that a task holds before it sends them on
FILTER_BITS = 26  # bits of the filter of shared signatures: 8 MB, whatever the corpus
SHORT_BITS, LONG_BITS, LONG_SET = 512, 4096, 1024
BLOCK = 512         # nodes of a group that one task compares with another block

_SETS = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_ROWS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
                   ("bits", pa.binary()), ("signatures", pa.list_(pa.int64()))])
_ROWS_DDL = "doc_id long, version long, node long, n long, bits binary, signatures array<long>"


def _sets(batches, width):
    """Document id or None, text version and token set of every row."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashed, _, first = words_of(part, "text", SPACED)
            ids = zip(part.column("doc_id").to_pylist(), part.column("version").to_pylist())
            for i, (doc, version) in enumerate(ids):
                yield doc, version, shingles(hashed[first[i]:first[i + 1]], width)


def _node(tokens: np.ndarray) -> int:
    """The set's 64-bit name: equal sets have equal names."""
    powers = tokens * (tokens >> np.uint64(7) | np.uint64(1))
    with np.errstate(over="ignore"):
        h = int(powers.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + int(tokens.sum(dtype=np.uint64)) + len(tokens)
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) - (1 << 63)


def _parity(tokens: np.ndarray) -> bytes:
    """One bit for each hash slot: whether it holds an odd number of tokens. Differing bits need differing tokens."""
    bits = LONG_BITS if len(tokens) > LONG_SET else SHORT_BITS
    slot = (tokens >> np.uint64(40)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def single_from(percent: int, k: int = COMBINE, most: int = PREFIX) -> int:
    """The smallest set size whose extended prefix has more than ``most`` tokens."""
    n = 1
    while n - -(-percent * n // 100) + k <= most:
        n += 1
        if percent >= 100 and n > most:
            break
    return n


def signatures(tokens: np.ndarray, seen: np.ndarray, frequent_above: int, percent: int, k: int = COMBINE,
               most: int = PREFIX) -> np.ndarray:
    """Single rare tokens and ``k``-combinations of frequent ones from the extended prefix of one ascending set; of a set
    with a prefix of more than ``most`` tokens the single tokens of the shorter prefix that is enough for these.

    ``seen`` are the tokens' sketch counts. A set too small to share ``k`` tokens carries its frequent ones singly too.
    """
    n, border = len(tokens), single_from(percent, k, most)
    least = -(-percent * n // 100)
    order = np.argsort(seen, kind="stable")[:n - least + k]
    prefix = tokens[order]
    out = [prefix[:n - least + 1]] if n * 100 >= percent * border else []
    if n < border:
        often = seen[order] > frequent_above
        out.append(prefix[~often])
        common = prefix[often]
        if least < k:
            out.append(common)
        if len(common) >= k:
            combined = common
            chosen = np.arange(len(common))
            for _ in range(k - 1):  # all later partners of what is combined so far
                partners = len(common) - 1 - chosen
                left = np.repeat(np.arange(len(chosen)), partners)
                step = np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
                right = chosen[left] + 1 + step
                combined = combined[left] * np.uint64(0xD1342543DE82EF95) + common[right]
                chosen = right
            out.append(combined)
    return np.unique(np.concatenate(out))


def _bounded(bits_a: pa.Array, bits_b: pa.Array, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs the length and bitmap bounds cannot rule out."""
    keep = np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)
    for size in (SHORT_BITS // 8, LONG_BITS // 8):
        same = np.flatnonzero(keep & (pc.binary_length(bits_a).to_numpy() == size)
                              & (pc.binary_length(bits_b).to_numpy() == size))
        for at in range(0, len(same), 1 << 14):
            own = same[at:at + (1 << 14)]
            x, y = (np.frombuffer(b"".join(v.take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), -1)
                    for v in (bits_a, bits_b))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            total = na[own] + nb[own]
            keep[own] = (total - apart) * (100 + percent) >= 2 * percent * total
    return keep


@giving_back
def _passes(batches, percent):
    for batch in batches:
        keep = pa.array(_bounded(batch.column("bits_a"), batch.column("bits_b"), batch.column("na").to_numpy(),
                                 batch.column("nb").to_numpy(), percent))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)],
                                         names=["a", "b"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough: bounds first, then exact overlaps of the sets still needed."""
    with scratch(nodes.sparkSession) as own:
        light = nodes.select("node", "n", "bits")
        near = stage(pairs.join(light.toDF("a", "na", "bits_a"), "a").join(light.toDF("b", "nb", "bits_b"), "b")
                     .mapInArrow(lambda t: _passes(t, percent), "a long, b long"), "near")
        used = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(nodes.join(used, "node", "left_semi").select(F.col("doc_id").alias("id")).distinct(), "wanted")

        @giving_back
        def held(batches):
            for _, _, tokens in _sets(batches, width):
                if len(tokens):
                    yield pa.RecordBatch.from_arrays([pa.array([_node(tokens)], pa.int64()),
                                                      pa.array([tokens.view(np.int64)], pa.list_(pa.int64()))],
                                                     schema=_SETS)

        # most texts are dropped where they are read, so that no join deals them out
        likely = docs.where(_likely(wanted.select(F.xxhash64("id")), F.xxhash64("doc_id")))
        sets = stage(likely.join(wanted, likely.doc_id.eqNullSafe(wanted.id), "left_semi")
                     .mapInArrow(held, "node long, tokens array<long>").dropDuplicates(["node"]), "sets")
        shared = F.size(F.array_intersect("ta", "tb")).cast("long")
        return own.keep(stage(near.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
                              .where(shared * (100 + percent) >= percent * (F.size("ta") + F.size("tb")))
                              .select("a", "b"), "links"))


def _members(nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """``signature``, ``node`` and the hub's columns of every node that carries a signature of ``hubs``.

    Most signatures are carried by one node alone. A filter of one hash, which cannot miss a shared one, drops nearly all
    of them where they are read, so that they are not shuffled to meet their hub.
    """
    shared = _filter(hubs.select("signature"))

    @giving_back
    def likely(batches):
        bits = shared.value
        for batch in batches:
            lists = batch.column("signatures")
            of = np.repeat(batch.column("node").to_numpy(), pc.list_value_length(lists).to_numpy())
            signature = lists.flatten().to_numpy()
            own = np.flatnonzero(_passing(bits, signature))
            yield pa.RecordBatch.from_arrays([pa.array(signature[own]), pa.array(of[own])], names=["signature", "node"])

    return stage(nodes.select("node", "signatures").mapInArrow(likely, "signature long, node long")
                 .join(hubs, "signature"), "members")


def _filter(keys: DataFrame):
    """The broadcast filter of one column of longs: no key misses it, and few others pass."""
    size = 1 << FILTER_BITS - 3

    @giving_back
    def fill(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = _filter_place(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield from blobs.blocks_of(bits)

    return keys.sparkSession.sparkContext.broadcast(
        blobs.gather(keys.mapInArrow(fill, blobs.SCHEMA), size, "uint8", np.bitwise_or))


def _filter_place(key: np.ndarray) -> np.ndarray:
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _passing(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = _filter_place(key)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _likely(keys: DataFrame, key: Column) -> Column:
    """Whether a row's ``key`` passes the filter of ``keys``. Only the key goes to Python; the row's text stays."""
    shared = _filter(keys)

    @F.arrow_udf("boolean")
    def passes(key: pa.Array) -> pa.Array:
        return pa.array(_passing(shared.value, key.to_numpy(zero_copy_only=False)))

    return passes(key)


def _across(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a signature, stand in different components and pass the bounds.

    Signatures with the same smallest node go together, as a group of near copies shares hundreds of them: each pair is
    made once for all. Many nodes are cut into blocks, and each two blocks meet in a task of their own.
    """
    # a node and its signatures are one row, which does not repeat the node's bitmap for each of them
    held = stage(members.groupBy("low", "node").agg(F.collect_list("signature").alias("signatures"),
                                                    F.first("component").alias("component")), "held")
    wide = stage(held.groupBy("low").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
                 .select("low", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "wide")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = held.join(nodes.select("node", "n", "bits"), "node").join(wide, "low", "left") \
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("low", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block",
                "signatures", "node", "component", "n", "bits")
    keys = ["low", "left", "right"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys) \
        .mapInArrow(lambda b: _met(b, percent), "a long, b long").distinct()


@giving_back
def _met(batches, percent):
    for (_, left, right), rows in runs(batches, ("low", "left", "right")):
        name = rows.column("node").to_numpy()  # a node of the group is one row
        if len(name) < 2:
            continue
        lists = rows.column("signatures")
        of = np.repeat(np.arange(len(name)), pc.list_value_length(lists).to_numpy())
        _, signature = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        block, component, n = (rows.column(c).to_numpy() for c in ("block", "component", "n"))
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        shared = np.zeros((len(a), len(b)), bool)
        order = np.argsort(signature, kind="stable")
        cuts = np.searchsorted(signature[order], np.arange(0, signature.max() + 2, 2048))
        for x, y in zip(cuts, np.append(cuts[1:], len(order))):
            own = order[x:y]
            if len(own):
                held = np.zeros((len(name), 2048), np.float32)
                held[of[own], signature[own] % 2048] = 1
                shared |= held[a] @ held[b].T > 0
        shared &= component[a][:, None] != component[b][None, :]
        shared &= np.minimum(n[a][:, None], n[b][None, :]) * 100 >= percent * np.maximum(n[a][:, None], n[b][None, :])
        if left == right:
            shared &= name[a][:, None] < name[b][None, :]
        i, j = np.nonzero(shared)
        if len(i):
            bits = rows.column("bits")
            keep = _bounded(bits.take(pa.array(a[i])), bits.take(pa.array(b[j])), n[a[i]], n[b[j]], percent)
            x, y = name[a[i[keep]]], name[b[j[keep]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def similar_sets(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row: the classes that links of Jaccard similarity make.

    Words are maximal runs of non-space bytes with A-Z lower-cased; a text of fewer than ``width`` words is one n-gram.
    Two rows link when ``100 * |intersection| >= percent * |union|``; ``component_id`` is the smallest ``doc_id`` in
    reach. Null and wordless texts have no n-grams and link with nothing. Rows with equal sets are always linked, also
    rows that repeat an id; rows of one id with different texts are linked only if their texts are. A null id is never
    a component's id unless all its rows have none. Other columns are not read. An empty table gives an empty one. A
    very long text is one set: memory and signatures are linear in its words.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    size = 1 << SKETCH_BITS

    @giving_back
    def count(batches):
        seen = np.zeros(size, np.uint32)
        for _, _, tokens in _sets(batches, width):
            slot = (tokens & np.uint64(size - 1)).astype(np.int64)
            np.add.at(seen, slot, 1)
        yield from blobs.blocks_of(seen)

    table = blobs.gather(docs.mapInArrow(count, blobs.SCHEMA), size, "uint32")
    frequent_above = max(RARE_FLOOR, 4 * int(table.mean()))
    shared_table = docs.sparkSession.sparkContext.broadcast(table)

    @giving_back
    def index(batches):
        seen = shared_table.value
        held, carried = [[] for _ in _ROWS], 0
        for doc, version, tokens in _sets(batches, width):
            row = (doc, version, None, 0, None, None)
            if len(tokens):
                counts = seen[(tokens & np.uint64(size - 1)).astype(np.int64)]
                row = (doc, version, _node(tokens), len(tokens), _parity(tokens),
                       signatures(tokens, counts, frequent_above, percent).view(np.int64))
            for column, value in zip(held, row):
                column.append(value)
            carried += 0 if row[5] is None else len(row[5])
            if len(held[0]) == 2000 or carried >= YIELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, _ROWS)], schema=_ROWS)
                held, carried = [[] for _ in _ROWS], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, _ROWS)], schema=_ROWS)

    spark = docs.sparkSession
    with scratch(spark) as own:
        with scratch(spark) as indexed:  # signatures stay with the nodes alone
            signed = stage(docs.mapInArrow(index, _ROWS_DDL), "signed")
            rows = indexed.keep(stage(signed.select("doc_id", "version", "node", "n"), "rows"))
            nodes = indexed.keep(stage(signed.where("node is not null").drop("version").dropDuplicates(["node"]), "nodes"))
        least = stage(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "least")

        with scratch(spark) as meeting:
            met = nodes.select("node", F.size("signatures").alias("carried"), F.explode("signatures").alias("signature"))
            # the node with most shared tokens is the likeliest centre of a group of copies
            hubs = stage(met.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high"),
                                                      F.max_by("node", "carried").alias("hub"))
                         .where("low <> high").drop("high"), "hubs")
            members = _members(nodes, hubs)
            pairs = members.select("node", F.explode(F.array("low", "hub")).alias("with")).where("node <> with") \
                .select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct()
            links = meeting.keep(_verified(pairs, nodes, docs, width, percent))
            found = stage(components(links), "found")

            placed = stage(members.select("signature", "low", "node").join(found, "node", "left")
                           .withColumn("component", F.coalesce("component", "node")), "placed")
            mixed = stage(placed.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                          .where("x <> y").select("signature"), "mixed")
            left = meeting.keep(stage(placed.join(mixed, "signature", "left_semi"), "left"))
        more = _verified(_across(left, nodes, percent), nodes, docs, width, percent)
        return own.keep(_labelled(rows, least, links.union(more)))


def _labelled(rows: DataFrame, least: DataFrame, links: DataFrame) -> DataFrame:
    """Every row with the smallest document id of its node's component."""
    group = components(links)
    named = stage(least.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage(named.join(stage(smallest, "smallest"), "component").select("node", "component", "component_id"),
                  "named")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "version", "node").join(named, "node", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "version",
                "component")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays, all others go.

    Of a component's rows that share this id, one text stays, and of its repeated rows one. Rows without an id stay
    only if no row of their component has one. Texts without words are nobody's copies and stay.
    """
    with scratch(docs.sparkSession) as own:
        classes = stage(similar_sets(docs, width, percent).where("component is not null"), "classes")
        first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first_id"),
                         F.col("version").alias("first_version"))
        kept = stage(classes.groupBy("component").agg(F.min(first).alias("first")).select("component", "first.*"), "kept")
        gone = own.keep(stage(
            classes.join(kept, "component").where("not (doc_id <=> first_id and version = first_version)")
            .select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct(), "gone"))
        repeated = own.keep(stage(
            classes.groupBy("doc_id", "version").agg(F.count("*").alias("rows")).where("rows > 1")
            .select(F.col("doc_id").alias("id"), F.col("version").alias("of")), "repeated"))
        version = F.xxhash64("text")
        # rows whose key is surely of neither table stay without a join, which would deal out their texts
        likely = _likely(gone.union(repeated).select(F.xxhash64("gone_id", "gone_version")),
                         F.xxhash64(F.col("doc_id").cast("long"), version))
        others, some = docs.where(~likely), docs.where(likely)
        stays = some.join(gone, some.doc_id.eqNullSafe(gone.gone_id) & (version == gone.gone_version), "left_anti")
        if repeated.isEmpty():
            return others.unionByName(stays)
        again = stays.doc_id.eqNullSafe(repeated.id) & (version == repeated.of)
        return others.unionByName(stays.join(repeated, again, "left_anti")).unionByName(
            stays.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
