"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by T-occurrence search (DivideSkip).

The join finds the components of linked documents; copies and families of near copies are never spelt out as pairs.

1. Count filter. A document with a partner shares at least ``threshold`` of its shingles with other texts. Tasks send
   each distinct shingle (32 bits of it) with its owner to a bucket, as packed arrays, and buckets answer with how many
   of an owner's shingles occur elsewhere. Documents below the threshold are done. A false match of 32 bits can only
   let a document through.
2. Equal sets become classes. Classes that are left are glued by min-hashes: members of a bucket are verified against
   the bucket's first, which gives links, and stars: each class with its nearest verified centre.
3. Two classes that link share a shingle of their prefixes (the rarest first), so stars of unlinked components that
   share one are candidates. The stars of a long list become one group as they are, by a row each; only pairs of short
   lists and of different groups are spelt out, at most ``LIST / 2`` for a star of a list. Centres further apart than
   the threshold and both radii allow are dropped (the Jaccard distance obeys the triangle inequality): first by their
   sizes and by parity sketches, which bound the distance from below, while a shingle's list is read, then by their
   sets. Stars that remain form clusters with the groups.
4. In each cluster all classes outside its largest component query the cluster's inverted lists by DivideSkip: the
   short lists are merged by a heap, the long ones are probed by binary search, and classes of the required overlap
   link. Large clusters are searched in cells of bounded size (blocks of the index by blocks of queries). A cell keeps
   what its links have joined: only a link that joins more is a row, so that rows are fewer than the cell's components.

Everything between the steps is a written table; only a table of ``CELLS`` bytes, used for the shingles' order alone,
passes the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common
from causalbars.llm.components import components
from causalbars.llm.shingles import mix, shingle_sets, signature

SHINGLE, THRESHOLD = 5, 75
#: Shingles that a task gathers before it sends them, shingles in a bucket (about), bytes of text for each of which a
#: shingle is reckoned, min-hashes for gluing, and cells of the table of shingles' frequencies, a byte each.
SEGMENT, BUCKET, TEXT_BYTES, GLUE, CELLS = 1 << 20, 1 << 21, 6, 6, 1 << 22
#: Shingles in a block of a cluster, stars of a shingle's list whose pairs are spelt out (those of a longer one are a
#: group), pairs that a task remembers so as not to repeat them, and pairs of one class that a task compares.
CELL, LIST, SEEN, PAIRS = 1 << 20, 64, 400_000, 512
NOBODY = np.uint32(0xFFFFFFFF)


def required(n: int, m: int, threshold: int = THRESHOLD) -> int:
    """The least overlap of sets of n and m at which 100 * overlap >= threshold * union."""
    return -(-threshold * (n + m) // (100 + threshold))


# --- 1. the count filter


def _send(k: int, buckets: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("bucket", pa.int32()), ("segment", pa.int64()), ("owner", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sig", pa.string()), ("shared", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary())])
        part, segment = TaskContext.get().partitionId() << 24, 0
        docs, sets, first, gathered = [], [], {}, 0

        def flush():
            nonlocal docs, sets, first, gathered, segment
            me = part + segment
            tokens = np.concatenate([np.empty(0, np.uint64), *sets])
            owners = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
            runs = np.diff(np.concatenate([starts, [len(tokens)]]))
            shared = np.bincount(owners, weights=np.repeat(runs > 1, runs), minlength=len(sets)).astype(np.int64)
            alone = np.where(runs > 1, NOBODY, owners[starts]) if len(tokens) else owners
            tokens = tokens[starts]
            edges = np.searchsorted(tokens, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
            rows = []
            for b, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(tokens)], strict=True)):
                if hi > lo:
                    low = (tokens[lo:hi] >> np.uint64(16)).astype(np.uint32)  # below the bits that tell buckets apart
                    rows.append({"bucket": b, "segment": me, "tokens": low.tobytes(), "owners": alone[lo:hi].astype(np.uint32 if len(sets) > 65534 else np.uint16).tobytes()})
            for doc_id, text_hash, n, sig, owner in docs:
                rows.append({"bucket": (me + owner) % buckets, "segment": me, "owner": owner, "doc_id": doc_id, "text_hash": text_hash, "n": n, "sig": sig, "shared": int(shared[owner])})
            for lo in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[lo : lo + 1000], schema)
            docs, sets, first, gathered, segment = [], [], {}, 0, segment + 1

        for batch in batches:
            for doc_id, text_hash, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), k), strict=True):
                sig = signature(own)
                if sig not in first:  # copies share their first one's answer
                    first[sig] = len(sets)
                    sets.append(own)
                    gathered += len(own)
                docs.append((doc_id, text_hash, len(own), sig, first[sig]))
            if gathered >= SEGMENT or len(docs) >= SEGMENT // 16:
                yield from flush()
        if docs:
            yield from flush()

    return common.lean(run)


DOC = "segment long, owner int, doc_id long, text_hash long, n long, sig string, shared long, answer binary"


def _answered(parts: list):
    """For each (segment, tokens, owners) of a bucket: the segment's owners with how many of their shingles occur
    elsewhere in it."""
    tokens = np.concatenate([t for _, t, _ in parts]).astype(np.uint64) << np.uint64(32)
    tokens |= np.arange(len(tokens), dtype=np.uint64)
    tokens.sort()
    same = np.diff(tokens >> np.uint64(32)) == 0
    often = np.empty(len(tokens), bool)
    often[(tokens & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    del tokens, same
    at = 0
    for segment, t, owners in parts:
        mine = owners[often[at : at + len(t)]].astype(np.int64)
        at += len(t)
        mine = mine[mine != np.iinfo(owners.dtype).max]
        who, count = np.unique(mine, return_counts=True)
        yield {"segment": segment, "answer": np.stack([who, count]).astype(np.uint32).tobytes()}


def _answer(batches):
    """Passes documents on; for each segment's part of a bucket, counts its owners' shingles that occur elsewhere. Rows
    come in the order of their buckets, and one bucket is held at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("segment", pa.int64()), ("owner", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sig", pa.string()), ("shared", pa.int64()), ("answer", pa.binary())])
    bucket, parts = None, []
    for batch in batches:
        docs = batch.filter(pc.is_valid(batch.column("sig")))
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([*(docs.column(n) for n in schema.names[:-1]), pa.nulls(docs.num_rows, pa.binary())], schema=schema)
        for r in batch.filter(pc.is_valid(batch.column("tokens"))).select(["bucket", "segment", "tokens", "owners"]).to_pylist():
            if r["bucket"] != bucket and parts:
                yield pa.RecordBatch.from_pylist(list(_answered(parts)), schema)
                parts = []
            bucket, tokens = r["bucket"], np.frombuffer(r["tokens"], np.uint32)
            parts.append((r["segment"], tokens, np.frombuffer(r["owners"], np.uint16 if len(r["owners"]) == 2 * len(tokens) else np.uint32)))
    if parts:
        yield pa.RecordBatch.from_pylist(list(_answered(parts)), schema)


def _decide(threshold: int):
    """Rows in order of segment, answers first: documents with whether enough of their shingles are shared."""

    def run(batches):
        import pyarrow as pa

        segment, counts = None, {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["segment"] != segment:
                    segment, counts = r["segment"], {}
                if r["answer"] is not None:
                    who, count = np.frombuffer(r["answer"], np.uint32).reshape(2, -1)
                    for w, c in zip(who.tolist(), count.tolist(), strict=True):
                        counts[w] = counts.get(w, 0) + c
                else:
                    shared = r["shared"] + counts.get(r["owner"], 0)
                    rows.append({"doc_id": r["doc_id"], "text_hash": r["text_hash"], "n": r["n"], "sig": r["sig"], "active": r["n"] > 0 and 100 * shared >= threshold * r["n"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sig", pa.string()), ("active", pa.bool_())]))

    return common.lean(run)


def filtered(spark: SparkSession, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, active) of each document; only active ones can have a partner with another set.

    Buckets are as many as the texts' bytes call for, so that each holds about ``BUCKET`` shingles.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-int(size) // (TEXT_BYTES * BUCKET)))
    sent = docs.mapInArrow(_send(k, buckets), "bucket int, segment long, owner int, doc_id long, text_hash long, n long, sig string, shared long, tokens binary, owners binary")
    answered = common.written(spark, sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(_answer), DOC), "join-answers")
    ordered = answered.repartition("segment").sortWithinPartitions("segment", F.col("answer").isNull())
    return common.written(spark, ordered.mapInArrow(_decide(threshold), "doc_id long, text_hash long, n long, sig string, active boolean"), "join-documents")


# --- 2. classes, gluing


def _class_sets(k: int):
    def run(batches):
        import pyarrow as pa

        done: set[str] = set()
        for batch in batches:
            rows = []
            for own in shingle_sets(batch.column(0), k):
                if len(own) and (sig := signature(own)) not in done:
                    done.add(sig)
                    rows.append({"sig": sig, "n": len(own), "tokens": own.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("sig", pa.string()), ("n", pa.int64()), ("tokens", pa.binary())]))

    return common.lean(run)


def _glue_keys(batches):
    import pyarrow as pa

    seeds = [np.uint64(0xD1B54A32D192ED03 * (r + 1) & (1 << 64) - 1) for r in range(GLUE)]
    for batch in batches:
        sigs, keys = [], []
        for sig, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = np.frombuffer(data, np.uint64)
            for r, seed in enumerate(seeds):
                sigs.append(sig)
                keys.append(int(mix(mix(tokens ^ seed).min(keepdims=True) + np.uint64(r))[0].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(keys, pa.int64())], ["sig", "key"])


def _overlaps(batches):
    """Overlaps of sorted sets, by binary search of the smaller in the larger. Rows come in the order of v, with v's own
    set, which has no u, before the others."""
    import pyarrow as pa

    centre, name = None, None
    for batch in batches:
        us, vs, ns, ms, out = [], [], [], [], []
        for v, u, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            own = np.frombuffer(data, np.uint64)
            if u is None:
                centre, name = own.copy(), v
                continue
            assert v == name
            x, y = (own, centre) if len(own) <= len(centre) else (centre, own)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            us.append(u)
            vs.append(v)
            ns.append(len(own))
            ms.append(len(centre))
            out.append(int((y[at] == x).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array(vs, pa.string()), pa.array(ns, pa.int64()), pa.array(ms, pa.int64()), pa.array(out, pa.int64())], ["u", "v", "nu", "nv", "overlap"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, nu, nv, overlap) of ``pairs(u, v)``, distinct pairs of classes, a written table.

    The pairs of one v go to as many tasks as their number calls for, and v's set is sent once to each."""
    parts = pairs.groupBy("v").agg(F.expr(f"1 + count(*) div {PAIRS}").alias("parts"))
    asked = pairs.join(parts, "v").select("v", F.expr("pmod(xxhash64(u), parts)").alias("part"), "u")
    asked = asked.join(sets.select(F.col("sig").alias("u"), "tokens"), "u").select("v", "part", "u", "tokens")
    centres = parts.join(sets.select(F.col("sig").alias("v"), "tokens"), "v").select("v", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(None).cast("string").alias("u"), "tokens")
    both = centres.unionByName(asked).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return both.mapInArrow(common.lean(_overlaps), "u string, v string, nu long, nv long, overlap long")


def _cells(batches):
    """Overlaps of the pairs of a cell, whose sets come before them and are held while it lasts."""
    import pyarrow as pa

    cell, held = None, {}
    for batch in batches:
        us, vs, ns, ms, out = [], [], [], [], []
        for *own, u, v, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if own != cell:
                cell, held = own, {}
            if v is None:
                held[u] = np.frombuffer(data, np.uint64)
                continue
            x, y = sorted((held[u], held[v]), key=len)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            us.append(u)
            vs.append(v)
            ns.append(len(held[u]))
            ms.append(len(held[v]))
            out.append(int((y[at] == x).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array(vs, pa.string()), pa.array(ns, pa.int64()), pa.array(ms, pa.int64()), pa.array(out, pa.int64())], ["u", "v", "nu", "nv", "overlap"])


def near_overlaps(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """As ``overlaps``, for pairs of which many share both their classes: those of a component of the pairs are compared
    in cells, of two blocks of about ``CELL`` shingles, so that a set is sent once to each cell that has a pair of it,
    and neither with each pair nor, in a large component of few pairs, to every cell of its block."""
    groups = components(spark, pairs)
    sized = groups.join(sets.select(F.col("sig").alias("node"), "n"), "node")
    blocks = sized.groupBy("component").agg(F.expr(f"1 + sum(n) div {CELL}").alias("blocks"))
    placed = common.written(spark, sized.join(blocks, "component").select("node", "component", "blocks", F.expr("pmod(xxhash64(node), blocks)").alias("block")), "join-cells")
    asked = pairs.join(placed.select(F.col("node").alias("u"), "component", F.col("block").alias("bu")), "u").join(placed.select(F.col("node").alias("v"), F.col("block").alias("bv")), "v")
    asked = common.written(spark, asked.selectExpr("component", "least(bu, bv) AS lo", "greatest(bu, bv) AS hi", "u", "v"), "join-asked")
    told = asked.select("component", "lo", "hi", F.explode(F.array("u", "v")).alias("u")).distinct().join(sets.select(F.col("sig").alias("u"), "tokens"), "u")
    told = told.select("component", "lo", "hi", "u", F.lit(None).cast("string").alias("v"), "tokens")
    asked = asked.withColumn("tokens", F.lit(None).cast("binary"))
    both = told.unionByName(asked).repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", F.col("v").asc_nulls_first())
    return both.mapInArrow(common.lean(_cells), "u string, v string, nu long, nv long, overlap long")


# --- 3. candidates


def _counts(batches):
    """Shingles with the number of a task's classes that hold them, some millions of shingles at a time."""
    import pyarrow as pa

    held = []

    def flush():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(tokens), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[lo : lo + (1 << 16)].view(np.int64)), pa.array(counts[lo : lo + (1 << 16)], pa.int64())], ["token", "c"])

    for batch in batches:
        held += [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        if sum(map(len, held)) >= SEGMENT:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _sketches(batches):
    """Parities of a set's hashes over 64 to 1024 cells, as many as the set calls for."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cells = min(max(1 << int(n - 1).bit_length(), 64), 1024)
            parity = np.bincount((np.frombuffer(data, np.uint64) >> np.uint64(20)).astype(np.int64) & cells - 1, minlength=cells) & 1
            out.append(np.packbits(parity.astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["star", "n", "sketch"])


def apart(n: np.ndarray, m: np.ndarray, sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Least Jaccard distances of sets of n and m, row by column, that sizes and parities allow.

    Cells whose parities differ hold an odd number of elements of one set alone, so the sets differ in as many at least.
    """
    words = min(sketches.shape[1], others.shape[1])
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1)  # noqa: E731  parities of merged cells
    differ = np.bitwise_count(fold(sketches)[:, None, :] ^ fold(others)[None, :, :]).sum(axis=2, dtype=np.int64)
    differ = np.maximum(differ, np.abs(n[:, None] - m[None, :]))
    total = n[:, None] + m[None, :]
    return 2 * differ / (total + differ)


def _candidates(threshold: int):
    """Pairs of stars of different components and groups that may be near enough, of one shingle's list, which come one
    by one and hold at most ``LIST`` stars."""

    names, numbers, seen = [], {}, set()  # the stars and pairs that a task has met; forgotten when there are many

    def arrays(rows):
        by: dict[int, list] = {}
        for row in rows:
            by.setdefault(len(row[5]), []).append(row)
        for width, own in by.items():
            for p in own:
                if numbers.setdefault(p[0], len(names)) == len(names):
                    names.append(p[0])
            yield np.array([numbers[p[0]] for p in own]), np.array([p[1] for p in own]), np.array([p[2] for p in own]), np.array([p[3] for p in own]), np.array([p[4] for p in own]), np.frombuffer(b"".join(p[5] for p in own), np.uint64).reshape(-1, width // 8)

    def pairs(rows):
        """New pairs, as numbers of their stars."""
        ones = list(arrays(rows))
        for i, (stars, comps, groups, n, r, sk) in enumerate(ones):
            for others, comps2, groups2, n2, r2, sk2 in ones[: i + 1]:
                near = (apart(n, n2, sk, sk2) <= 1 - threshold / 100 + r[:, None] + r2[None, :] + 1e-9) & (comps[:, None] != comps2[None, :]) & (groups[:, None] != groups2[None, :])
                a, b = np.nonzero(near)
                found = np.unique(np.minimum(stars[a], others[b]) << 32 | np.maximum(stars[a], others[b]))
                new = [x for x in found.tolist() if x not in seen]
                seen.update(new)
                yield from new

    def batch_of(found):
        import pyarrow as pa

        both = [sorted((names[x >> 32], names[x & 0xFFFFFFFF])) for x in found]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array([y for _, y in both], pa.string())], ["u", "v"])

    def run(batches):
        key, rows, found = None, [], []
        for batch in batches:
            for token, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if token != key:
                    found.extend(pairs(rows))
                    key, rows = token, []
                    if len(found) >= 50_000 or len(seen) >= SEEN:
                        yield batch_of(found)
                        found.clear()
                    if len(seen) >= SEEN:
                        seen.clear()
                        names.clear()
                        numbers.clear()
                rows.append(row)
        found.extend(pairs(rows))
        yield batch_of(found)

    return common.lean(run)


def _prefixes(levels, threshold: int):
    """Prefixes, packed, in order of rarity: shingles by the level of their cell, then by hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                tokens = np.frombuffer(data, np.uint64)
                order, n = levels.value[((tokens >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int64)], len(tokens)
                out.append(tokens[np.lexsort((tokens, order))[: n - -(-threshold * n // 100) + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["sig", "prefix"])

    return common.lean(run)


def _spelt(batches):
    """A row for each shingle of a packed prefix."""
    import pyarrow as pa

    for batch in batches:
        for star, comp, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            prefix = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array([star] * len(prefix), pa.string()), pa.array([comp] * len(prefix), pa.string())], ["token", "star", "comp"])


# --- 4. T-occurrence search


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted lists merged into one: a heap gives the two shortest runs, whose merger goes back, until one is left."""
    heap = [(len(x), i, x) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > 1:
        n, _, x = heapq.heappop(heap)
        m, _, y = heap[0]
        heapq.heapreplace(heap, (n + m, at, np.sort(np.concatenate([x, y]), kind="stable")))
        at += 1
    return heap[0][2] if heap else np.empty(0, np.int64)


def divide_skip(lists: list[np.ndarray], t: int, mu: float = 0.0085) -> tuple[np.ndarray, np.ndarray]:
    """(records, overlaps) of records that stand in at least ``t`` of the sorted ``lists``.

    The ``long`` longest lists are set aside: a record needs ``t - long`` of the others, which a heap merges, and is
    then looked up in the long lists by binary search for as long as it can still reach ``t``.
    """
    none = np.empty(0, np.int64)
    if t <= 0 or len(lists) < t:
        return none, none
    lists = sorted(lists, key=len)
    long = min(t - 1, int(t / (mu * np.log2(max(len(lists[-1]), 2)) + 1)))
    run = merged(lists[: len(lists) - long])
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else none
    records, counts = run[starts], np.diff(np.concatenate([starts, [len(run)]]))
    likely = counts >= t - long
    records, counts = records[likely], counts[likely]
    for j, x in enumerate(lists[len(lists) - long :]):
        if not len(records):
            break
        at = np.minimum(np.searchsorted(x, records), len(x) - 1)
        counts = counts + (x[at] == records)
        if j % 16 == 0:
            likely = counts + (long - 1 - j) >= t
            records, counts = records[likely], counts[likely]
    return records[counts >= t], counts[counts >= t]


def search_cell(index: list[tuple[str, str, np.ndarray]], queries: list[tuple[str, str, np.ndarray]], threshold: int = THRESHOLD) -> list[tuple[str, str]]:
    """Links of ``queries`` (class, component, set) with the ``index`` that join what all their links join: a forest of
    components, of fewer links than the cell has components. Queries of the component that has most of the index are
    searched in the rest of it alone."""
    if not index or not queries:
        return []
    index = sorted(index, key=lambda x: len(x[2]))
    sizes = np.array([len(x[2]) for x in index])
    tokens = np.concatenate([np.empty(0, np.uint64), *(x[2] for x in index)])
    order = np.argsort(tokens, kind="stable")
    owner, tokens = np.repeat(np.arange(len(index)), sizes)[order], tokens[order]
    numbers: dict[str, int] = {}
    whose = np.array([numbers.setdefault(x[1], len(numbers)) for x in index])
    asking = [numbers.setdefault(x[1], len(numbers)) for x in queries]
    up, weight = list(range(len(numbers))), np.bincount(whose, weights=sizes, minlength=len(numbers)).tolist()
    rest, rest_of, without = (owner, tokens), -1, 0.0  # the index without what a component, ``rest_of``, had of it then

    def root(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = up[y]
            x = up[x]
        return x

    out = []
    for (sig, _, own), mine in zip(queries, asking, strict=True):
        n, mine = len(own), root(mine)
        if weight[mine] >= without + len(tokens) / 8:
            other = (np.array([root(x) for x in range(len(up))]) != mine)[whose][owner]
            rest, rest_of, without = (owner[other], tokens[other]), mine, weight[mine]
        owners, held = rest if rest_of >= 0 and root(rest_of) == mine else (owner, tokens)
        # Sizes that can link; lists hold records by size, so the range is one slice of each.
        lo, hi = int(np.searchsorted(sizes, -(-threshold * n // 100))), int(np.searchsorted(sizes, 100 * n // threshold, side="right"))
        a, b = np.searchsorted(held, own), np.searchsorted(held, own, side="right")
        lists = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in (owners[i:j] for i, j in zip(a[b > a], b[b > a], strict=True))]
        lists = [x for x in lists if len(x)]
        for record, overlap in zip(*(x.tolist() for x in divide_skip(lists, required(n, -(-threshold * n // 100), threshold))), strict=True):
            if (theirs := root(int(whose[record]))) != mine and overlap >= required(n, int(sizes[record]), threshold):
                up[theirs] = mine
                weight[mine] += weight[theirs]
                out.append((sig, index[record][0]))
    return out


def _search(threshold: int):
    def run(cell):
        import pyarrow as pa

        rows = [(x, y, np.frombuffer(t, np.uint64), q) for x, y, t, q in zip(*(cell.column(n).to_pylist() for n in ("sig", "comp", "tokens", "asks")), strict=True)]
        found = search_cell([r[:3] for r in rows if not r[3]], [r[:3] for r in rows if r[3]], threshold)
        return pa.table([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], names=["u", "v"])

    return run


def _levels(spark: SparkSession, sets: DataFrame) -> np.ndarray:
    """By cell of a shingle's hash: the level (eight to a doubling) of its most frequent shingle, 0 for those of one or
    two classes. All shingles are counted; however many there are, the table has ``CELLS`` bytes."""
    counted = sets.select("tokens").mapInArrow(common.lean(_counts), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).filter("c > 2")
    cells = counted.groupBy(F.expr(f"cast(shiftrightunsigned(token, 20) & {CELLS - 1} AS int)").alias("cell")).agg(F.max(F.expr("cast(least(255, floor(8 * log2(c))) AS smallint)")).alias("level"))
    found, levels = cells.toArrow(), np.zeros(CELLS, np.uint8)
    levels[found.column("cell").to_numpy()] = found.column("level").to_numpy()
    return levels


def links(spark: SparkSession, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) between classes that join what the similarity joins, if not each pair."""
    keys = common.written(spark, sets.select("sig", "tokens").mapInArrow(common.lean(_glue_keys), "sig string, key long"), "join-keys")
    first = keys.groupBy("key").agg(F.min("sig").alias("v"), F.count("*").alias("c")).filter("c > 1")
    pairs = common.written(spark, keys.join(first, "key").filter("sig <> v").select(F.col("sig").alias("u"), "v").distinct(), "join-pairs")
    near = overlaps(pairs, sets).filter(f"100 * overlap >= {threshold} * (nu + nv - overlap)")
    glued = common.written(spark, near.select("u", "v", (1 - F.col("overlap") / (F.col("nu") + F.col("nv") - F.col("overlap"))).alias("d")), "join-glued")
    comps = components(spark, glued)
    best = glued.groupBy("u").agg(F.min(F.struct("d", "v")).alias("best")).select(F.col("u").alias("sig"), F.col("best.v").alias("centre"), F.col("best.d").alias("d"))
    members = sets.select("sig", "n").join(best, "sig", "left").join(comps.withColumnRenamed("node", "sig"), "sig", "left")
    members = common.written(spark, members.select("sig", "n", F.coalesce("centre", "sig").alias("star"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "sig").alias("comp")), "join-members")

    levels = spark.sparkContext.broadcast(_levels(spark, sets))
    prefixes = sets.select("sig", "tokens").mapInArrow(_prefixes(levels, threshold), "sig string, prefix binary")  # a quarter of a set is sent
    listed = members.join(prefixes, "sig").select("star", "comp", "prefix").mapInArrow(common.lean(_spelt), "token long, star string, comp string")
    # A shingle's list counts if it holds several components; the window spills, so a list may be of any length.
    listed = listed.repartition("token").dropDuplicates(["token", "star", "comp"])
    listed = listed.selectExpr("*", "min(comp) OVER (PARTITION BY token) AS least", "max(comp) OVER (PARTITION BY token) AS most", "min(star) OVER (PARTITION BY token) AS head", "count(*) OVER (PARTITION BY token) AS c")
    listed = common.written(spark, listed.filter("least <> most").select("token", "star", "comp", "head", "c"), "join-lists")
    # Long lists: each star with the list's first one, whatever their distance. What is in a cluster is searched exactly.
    grouped = common.written(spark, listed.filter(f"c > {LIST}").select(F.col("star").alias("u"), F.col("head").alias("v")).distinct(), "join-grouped")
    groups = components(spark, grouped).select(F.col("node").alias("star"), F.col("component").alias("grp"))
    radius = members.groupBy("star").agg(F.max("d").alias("r"))
    centres = sets.select("sig", "n", "tokens").mapInArrow(common.lean(_sketches), "star string, n long, sketch binary").join(radius, "star")
    met = listed.filter(f"c <= {LIST}").select("token", "star", "comp").join(centres.join(groups, "star", "left"), "star").selectExpr("token", "star", "comp", "coalesce(grp, star) AS grp", "n", "r", "sketch")
    stars = met.repartition("token").sortWithinPartitions("token").mapInArrow(_candidates(threshold), "u string, v string").distinct()
    far = near_overlaps(spark, common.written(spark, stars, "join-stars"), sets).join(radius.select(F.col("star").alias("u"), F.col("r").alias("ru")), "u").join(radius.select(F.col("star").alias("v"), F.col("r").alias("rv")), "v")
    close = far.filter(f"1 - overlap / (nu + nv - overlap) <= {1 - threshold / 100} + ru + rv + 1e-9").select("u", "v")
    clusters = components(spark, common.written(spark, close.unionByName(grouped), "join-close"))

    inside = common.written(spark, members.join(clusters.select(F.col("node").alias("star"), F.col("component").alias("cluster")), "star").select("cluster", "sig", "n", "comp"), "join-clusters")
    per = inside.groupBy("cluster", "comp").agg(F.sum("n").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"))
    per = per.select("cluster", F.col("top.comp").alias("largest"), F.expr(f"1 + size div {CELL}").alias("blocks"), F.expr(f"1 + (size - top.c) div {CELL}").alias("turns"))
    placed = inside.drop("n").join(per, "cluster").join(sets.select("sig", "tokens"), "sig")
    held = placed.select("cluster", F.expr("pmod(xxhash64(sig), blocks)").alias("block"), F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"), "sig", "comp", "tokens", F.lit(False).alias("asks"))
    asking = placed.filter("comp <> largest").select("cluster", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.expr("pmod(xxhash64(sig, 1), turns)").alias("turn"), "sig", "comp", "tokens", F.lit(True).alias("asks"))
    found = held.unionByName(asking).groupBy("cluster", "block", "turn").applyInArrow(_search(threshold), "u string, v string")
    return glued.select("u", "v").unionByName(found)


def join(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, the least id
    that links reach, and component, a name of the component that null ids have too (null without shingles).

    Two documents link when 100 * overlap >= threshold * union of their sets. Null and empty texts have no shingles and
    link with nothing, not even each other. Rows that share an id stay rows of their own; a null id is never the
    least one, and a component of null ids alone has none. An empty table gives no rows.
    """
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = filtered(spark, texts, k, threshold)
    classes = common.written(spark, rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("active").alias("active")), "join-classes")
    asked = classes.filter("active")
    # One document of each active class is read again; few enough ids are broadcast, else joined.
    ids = common.small(common.written(spark, asked.select(F.col("first").alias("id")).distinct(), "join-ids"))
    again = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text").mapInArrow(_class_sets(k), "sig string, n long, tokens binary")
    sets = common.written(spark, again.join(asked.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "join-sets")
    comps = components(spark, common.written(spark, links(spark, sets, threshold), "join-links"))
    named = classes.join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    final = named.join(least, "component").select("sig", "component_id", "component")
    full = rows.filter("n > 0").join(final, "sig").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "component")
    return full.unionByName(rows.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("component")))


def representatives(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component: the one of the least id (null last), then of the least hash of its
    text. Documents without shingles all stay. Of a representative's repeated rows one stays."""
    with common.scratch(spark):
        found = join(spark, docs, k, threshold).filter("component IS NOT NULL")
        rows = common.written(spark, found, "join-rows", keep=True)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")).select("component", F.col("f.doc_id").alias("first_id"), F.col("f.text_hash").alias("first_hash"))
    told = rows.join(first, "component").withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    dropped = told.filter("NOT is_first").select("doc_id", "text_hash").distinct()
    repeated = common.written(spark, told.filter("is_first").groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "join-repeated")
    kept = common.by_key(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return kept
    name = common.fresh("_hash", kept)
    once = common.by_key(kept, repeated, "left_semi").withColumn(name, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", name]).drop(name)
    return common.by_key(kept, repeated, "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
