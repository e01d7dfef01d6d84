"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered rare first. If two sets overlap in at least O shingles, their prefixes of |x| - O + l
shingles share at least l, for any l up to O. Each set picks its own l from the number of candidates that
its shortest prefix meets: a longer prefix costs one more shingle a step and asks for one more match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.llm.shared import may_hold, small_batches, staged, unstage
from hashgrove.llm.words import U64, Words, distinct, mix, pieces, shingles

SIZE, PERCENT = 5, 75
#: Longest prefix step, and the candidate cost that each step is to divide.
STEPS, COST = 4, 8
#: Sets on one prefix shingle beyond which pairs come from leaders first, then only between components.
BIG, LEADERS, STAR_SHARE = 64, 8, 8
#: Rows of a shingle beyond which it is dealt to several tasks; probes or members of a cell of a crowded group.
DEALT, CELL = 1024, 4096
#: How many of the most frequent shingles stand last in the order: the bound of what is broadcast.
FREQUENT, FREQUENT_LEAST = 200_000, 24
#: Candidates of a set that are verified at once; the others wait until components are known.
FIRST = 2
ROWS, BLOCK = 1 << 18, 1 << 20


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap that a set of n shingles has with any set it links with."""
    return -(-PERCENT * n // 100)


def text_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, A-Z folded."""
    for a, b, texts in pieces(column):
        h, owner = shingles(Words(texts, lower=True), SIZE)
        cut = np.searchsorted(owner, np.arange(b - a + 1))
        for i in range(b - a):
            yield distinct(h[cut[i] : cut[i + 1]])


def set_key(s: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int((mix(mix(s + U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True) + U64(len(s))))[0].view(np.int64))


def packed(s: np.ndarray) -> bytes:
    """A sorted set as six bytes a shingle: 48 bits keep a pair of sets of a thousand apart but once in 10**8."""
    return np.ascontiguousarray((s >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The FREQUENT most frequent of the shingles that any chunk of about two million holds often; sorted by hash, with counts.

    Only the order of shingles rests on it, never which pairs link.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            h.sort()
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.append(begin, len(h)))
            keep, h = n >= 3, h[begin]
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for s in text_sets(batch.column("text")):
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    top = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    top = top.assign(s=top.s.to_numpy(dtype=np.int64).view(U64)).sort_values("s")
    return np.stack((top.s.to_numpy(dtype=U64), top.n.to_numpy().astype(U64)))


def stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars: every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("x"), "v").union(edges.select("v", F.lit(None).cast("long")))
    ends = ends.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"), F.count("v").alias("up"))
    return ends.agg(F.count(F.when((F.col("least") != F.col("most")) | ((F.col("up") > 0) & (F.col("n") > F.col("up"))), 1))).first()[0] == 0


def contracted(links: DataFrame) -> DataFrame:
    """(v, c): the least vertex c that each vertex v of links (a, b) reaches, where that is another; by star contraction.

    Each round links every vertex's neighbours to the least of them (larger ones, then smaller ones), so paths
    shrink geometrically. An edge makes one edge at most in each half, repeated ones go where they meet on a vertex. Rounds
    are written to the shared folder, and only whether they are stars reaches the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.withColumnRenamed("u", "w").join(least.withColumnRenamed("u", "v"), "v").select(F.col("w").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # the least neighbour's own row gives way to that of u, so a vertex's rows stay as many
        small = large.join(low, "u").select("u", "v", "m").distinct().select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = staged(small, "edges")
        unstage(edges)
        edges = after
        if stars(edges):
            return edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("c"))


def components(links: DataFrame) -> DataFrame:
    """``contracted``, with those vertices of links that are the least of their component."""
    found = contracted(links)
    return found.union(found.select(F.col("c").alias("v"), "c").distinct())


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``contracted`` of the links behind comp and of these too: stars of comp stand for the links behind it."""
    return comp if links.isEmpty() else contracted(comp.select(F.col("v").alias("a"), F.col("c").alias("b")).union(links))


PROBES = pa.schema([("kind", pa.int8()), ("t", pa.int64()), ("k", pa.int64()), ("m", pa.int64()), ("other", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("levels", pa.list_(pa.int8()))])
PROBES_DDL = "kind byte, t long, k long, m long, other array<long>, sizes array<int>, levels array<byte>"


def empty_rows() -> dict[str, list]:
    return {f.name: [] for f in PROBES}


def probe_batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in PROBES], schema=PROBES)


def put(rows: dict[str, list], *row) -> None:
    for c, v in zip(rows.values(), row):
        c.append(v)


def paired(rows: dict[str, list], t: int, keys: np.ndarray, meta: np.ndarray) -> None:
    """Each set of a small group with the smaller sets of it that it may link with."""
    order = np.lexsort((keys, meta >> 3))
    keys, meta = keys[order], meta[order]
    size, level = meta >> 3, (meta & 7).astype(np.int8)
    low = np.searchsorted(size, needed(size))
    for i in np.flatnonzero(low < np.arange(len(keys))).tolist():
        put(rows, 0, t, int(keys[i]), int(meta[i]), keys[low[i] : i], size[low[i] : i].astype(np.int32), np.maximum(level[low[i] : i], level[i]))


def led(rows: dict[str, list], t: int, keys: np.ndarray, meta: np.ndarray, lead: np.ndarray, lead_size: np.ndarray) -> None:
    """The members of a crowded group, for later; for one shingle in STAR_SHARE also with the group's leaders."""
    star = t % STAR_SHARE == 0
    for k, m in zip(keys.tolist(), meta.tolist()):
        put(rows, 2, t, k, m, None, None, None)
        if star:
            n = m >> 3
            fit = (lead != k) & (np.minimum(lead_size, n) >= needed(np.maximum(lead_size, n)))
            if fit.any():
                put(rows, 1, t, k, m, lead[fit], lead_size[fit].astype(np.int32), np.zeros(int(fit.sum()), dtype=np.int8))


def candidates_of(crowd: int):
    """From rows (t, z, k, m = size * 8 + level) sorted by t, z, k: kind 0, a probe set with its smaller candidates on a
    small group; kind 1, its leaders on a crowded one; kind 2, a member of a crowded group, for later.

    A group (t, z) is crowded beyond ``crowd`` sets, and always where z > 0: its shingle is dealt to many tasks. No more
    than ``crowd`` sets of a group and one batch are held; the leaders, its first sets, stay for the rest of it.
    """
    def whole(rows: dict[str, list], t: int, z: int, k: np.ndarray, m: np.ndarray) -> None:
        keys, at = np.unique(k, return_index=True)
        if z or len(keys) > crowd:
            led(rows, t, keys, m[at], keys[:LEADERS], m[at][:LEADERS] >> 3)
        elif len(keys) > 1:
            paired(rows, t, keys, m[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        going = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "z", "k", "m")]
            rows = empty_rows()
            if going is not None and len(own[0]):
                t, z, last, lead, lead_size = going
                same = (own[0] == t) & (own[1] == z)
                n = len(same) if same.all() else int(same.argmin())
                keys, at = np.unique(own[2][:n], return_index=True)
                meta = own[3][:n][at]
                fresh = keys != last
                led(rows, t, keys[fresh], meta[fresh], lead, lead_size)
                going = (t, z, int(keys[-1]), lead, lead_size) if n == len(same) else None
                own = [c[n:] for c in own]
            if rest is not None:
                own = [np.concatenate(c) for c in zip(rest, own)]
                rest = None
            t, z, k, m = own
            if len(t):
                begin = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (z[1:] != z[:-1]))))
                end = np.append(begin[1:], len(t))
                many = (end - begin > 1) | (z[begin] > 0)
                many[-1] = False
                for a, b in zip(begin[many].tolist(), end[many].tolist()):
                    whole(rows, int(t[a]), int(z[a]), k[a:b], m[a:b])
                a = int(begin[-1])
                keys, at = np.unique(k[a:], return_index=True)
                if len(keys) > crowd:
                    meta = m[a:][at]
                    going = (int(t[a]), int(z[a]), int(keys[-1]), keys[:LEADERS], meta[:LEADERS] >> 3)
                    led(rows, int(t[a]), keys, meta, keys[:LEADERS], meta[:LEADERS] >> 3)
                else:
                    tail = np.sort(at) + a
                    rest = [c[tail] for c in own]
            if rows["t"]:
                yield probe_batch(rows)
        if rest is not None:
            rows = empty_rows()
            whole(rows, int(rest[0][0]), int(rest[1][0]), rest[2], rest[3])
            if rows["t"]:
                yield probe_batch(rows)

    return run


def cross_cells(big: DataFrame, comp: DataFrame, cell: int) -> DataFrame:
    """(cell, t, probe, main, k, m, c): crowded groups of more than one component, dealt to cells of about ``cell`` probes and members.

    Probes are the sets outside the group's largest component. Each meets every block of members once, whatever the
    group's size, so no task holds a group.
    """
    labelled = staged(big.join(comp.withColumnRenamed("v", "k"), "k", "left").select("t", "k", "m", F.coalesce("c", "k").alias("c")), "crowded")
    sizes = labelled.groupBy("t", "c").agg(F.count("*").alias("n")).groupBy("t").agg(F.count("*").alias("__comps"), F.sum("n").alias("__all"), F.max(F.struct("n", "c")).alias("__top")).where("__comps > 1")
    blocks = lambda n: F.ceil(n / cell).cast("int")
    sizes = sizes.select("t", F.col("__top.c").alias("main"), blocks(F.col("__all")).alias("__mb"), blocks(F.col("__all") - F.col("__top.n")).alias("__pb"))
    rows = labelled.join(sizes, "t")
    deal = lambda n: F.pmod(F.xxhash64("k", F.lit(7)), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumn("__p", all_of("__pb")).withColumn("__m", deal(F.col("__mb"))).withColumn("probe", F.lit(0))
    probes = rows.where("c <> main").withColumn("__m", all_of("__mb")).withColumn("__p", deal(F.col("__pb"))).withColumn("probe", F.lit(1))
    both = members.unionByName(probes)
    return both.select(F.xxhash64("t", "__p", "__m").alias("cell"), "t", "probe", "main", "k", "m", "c")


def cross_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cells sorted by cell: each probe with the cell's members of other components that it may link with.

    The larger set of a pair, then the larger key, is k whichever of the two probes: a pair's main component differs
    from shingle to shingle, and its shared shingles are counted by (k, other).
    """
    def pairs(t, probe, main, k, m, c) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(probe == 0)
        own = own[np.lexsort((k[own], m[own] >> 3))]
        size, level = m[own] >> 3, (m[own] & 7).astype(np.int8)
        rows, turned, held = empty_rows(), [], 0

        def flush() -> pa.RecordBatch:
            if turned:
                x, y = (np.concatenate(v) for v in zip(*turned))
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                for q in np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1):
                    i, at = int(x[q[0]]), y[q]
                    put(rows, 0, int(t[i]), int(k[i]), int(m[i]), k[at], (m[at] >> 3).astype(np.int32), np.maximum(m[at] & 7, m[i] & 7).astype(np.int8))
            return probe_batch(rows)

        for i in np.flatnonzero(probe == 1).tolist():
            n = int(m[i] >> 3)
            a, b = np.searchsorted(size, int(needed(np.int64(n)))), np.searchsorted(size, n * 100 // PERCENT, side="right")
            at = own[a:b]
            before = (m[at] >> 3 < n) | ((m[at] >> 3 == n) & (k[at] < k[i]))
            other = (t[at] == t[i]) & (c[at] != c[i])
            ok, after = other & before, at[other & ~before & (c[at] == main[i])]
            if ok.any():
                put(rows, 0, int(t[i]), int(k[i]), int(m[i]), k[at][ok], size[a:b][ok].astype(np.int32), np.maximum(level[a:b][ok], np.int8(m[i] & 7)))
            if len(after):
                turned.append((after, np.full(len(after), i)))
            held += int(ok.sum()) + len(after)
            if held > BLOCK:
                yield flush()
                rows, turned, held = empty_rows(), [], 0
        if held:
            yield flush()

    rest: list[np.ndarray] | None = None
    for batch in batches:
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "t", "probe", "main", "k", "m", "c")]
        if rest is not None:
            own = [np.concatenate(c) for c in zip(rest, own)]
        if len(own[0]):
            begin = np.flatnonzero(np.concatenate(([True], own[0][1:] != own[0][:-1]))).tolist()
            for a, b in zip(begin, begin[1:]):
                yield from pairs(*(c[a:b] for c in own[1:]))
            rest = [c[begin[-1] :] for c in own]
    if rest is not None:
        yield from pairs(*rest[1:])


def multi_match(adaptive: bool):
    """Candidates of each probe set that share enough prefix shingles, from rows sorted by the probe, k.

    With l steps, a pair shares at most c + max(O) - l shingles, where c counts those in both prefixes and O is
    ``needed`` of a size: shingles before the end of the nearer prefix are in both, the rest lie after it. So c must reach
    l, and what the pair's own least overlap asks beyond max(O). ``adaptive`` lengthens l by a probe's candidates,
    and grants the shingles of its crowded groups as matches; then a pair that shares any other shingle is decided here.
    Without it, l is 1: the later pass over crowded groups, for pairs that share nothing else.
    """
    def decide(table: pa.Table) -> pa.RecordBatch:
        k, kind, m = (table.column(c).to_numpy() for c in ("k", "kind", "m"))
        names, group = np.unique(k, return_inverse=True)
        size = np.zeros(len(names), dtype=np.int64)
        size[group] = m >> 3
        x, y, shared, asked = [], [], [], []
        for which in (0, 1):
            rows = np.flatnonzero(kind == which)
            if not len(rows):
                continue
            part = table.take(pa.array(rows)).combine_chunks()
            other, sizes, level = (part.column(c).combine_chunks() for c in ("other", "sizes", "levels"))
            g = np.repeat(group[rows], np.diff(other.offsets.to_numpy()))
            other, sizes, level = other.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64), level.flatten().to_numpy()
            if which == 0:
                cost = np.bincount(g[level <= 1], minlength=len(names))
                step = 1 + sum((cost > COST**i).astype(np.int64) for i in range(1, STEPS)) if adaptive else np.ones(len(names), dtype=np.int64)
                step = np.minimum(step, needed(size))
                crowded = (kind == 2) & ((m & 7) <= step[group])
                granted = np.bincount(group[crowded], minlength=len(names)) if adaptive else np.zeros(len(names), dtype=np.int64)
                near = level <= step[g]
                g, other, sizes = g[near], other[near], sizes[near]
            order = np.lexsort((other, g))
            g, other, sizes = g[order], other[order], sizes[order]
            begin = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (other[1:] != other[:-1])))) if len(g) else np.zeros(0, dtype=np.int64)
            count = np.diff(np.append(begin, len(g)))
            g, other, sizes = g[begin], other[begin], sizes[begin]
            if which == 0:
                pair = -(-PERCENT * (size[g] + sizes) // (100 + PERCENT))
                least = np.maximum(step[g], pair - needed(np.maximum(size[g], sizes)) + step[g])
                good = count + granted[g] >= least
                g, other, count = g[good], other[good], count[good]
            x.append(names[g])
            y.append(other)
            shared.append(count if which == 0 else np.zeros(len(g), dtype=np.int64))
            asked.append(least[good] if which == 0 else np.zeros(len(g), dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (x, y, shared, asked)], names=["x", "y", "shared", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), batch])
            k = table.column("k").to_numpy()
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                yield decide(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield decide(rest)

    return run


def matched(probes: DataFrame, adaptive: bool) -> DataFrame:
    rows = probes.drop("t").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(multi_match(adaptive), "x long, y long, shared long, asked long")


def prefix_rows(docs: DataFrame, order, dealt: int = DEALT) -> DataFrame:
    """(t, z, k, m) of the adaptive prefixes of every distinct set: t a shingle, k the set, m = size * 8 + the step that
    takes t in; z is 0, or from 1 on spreads a shingle seen over ``dealt`` times so that about so many rows meet in a task."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = order.value
        for batch in batches:
            seen: set[int] = set()
            ts, zs, ks, ms, held = [], [], [], [], 0
            for s in text_sets(batch.column("text")):
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                least = int(needed(np.int64(len(s))))
                take = min(len(s), len(s) - least + min(STEPS, least))
                rank = np.zeros(len(s), dtype=U64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    rank = np.where(frequent[at] == s, counts[at], U64(0))
                    if rank.any():
                        first = np.lexsort((s, rank))
                        s, rank = s[first], rank[first]
                ts.append(s[:take].view(np.int64))
                parts = -(-rank[:take].astype(np.int64) // dealt)
                zs.append(np.where(parts > 1, 1 + (mix(s[:take] ^ np.int64(key).view(U64)) >> U64(1)).view(np.int64) % np.maximum(parts, 1), 0))
                ks.append(np.full(take, key))
                ms.append(len(s) * 8 + np.maximum(1, np.arange(take) - (len(s) - least) + 1))
                held += take
                if held > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ts, zs, ks, ms)], names=["t", "z", "k", "m"])
                    ts, zs, ks, ms, held = [], [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ts, zs, ks, ms)], names=["t", "z", "k", "m"])

    return docs.select("text").mapInArrow(prefixes, "t long, z long, k long, m long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets, columns (k, s binary of sorted shingles), link; none is counted twice."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("p"), batch.column("q")):
                u, v = (unpacked(z.as_buffer()) for z in (p, q))
                w = np.sort(np.concatenate((u, v)))
                both = int((w[1:] == w[:-1]).sum())
                ok.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("k").alias("x"), F.col("s").alias("p")), sets.select(F.col("k").alias("y"), F.col("s").alias("q"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "p", "q").mapInArrow(check, "a long, b long")


def crowd_checked(pairs: DataFrame, big: DataFrame) -> DataFrame:
    """The pairs whose shared shingles, with those that both hold in crowded groups, are as many as asked; and which are
    among the FIRST likeliest of their probe set."""
    crowd = big.groupBy("k").agg(F.collect_set("t").alias("ts"))
    none = F.array().cast("array<long>")
    at = lambda end: crowd.select(F.col("k").alias(end), F.col("ts").alias(f"t{end}"))
    found = pairs.join(at("y"), "y", "left").join(at("x"), "x", "left")  # x last: the window then finds its rows together
    count = F.col("shared") + F.size(F.array_intersect(F.coalesce("tx", none), F.coalesce("ty", none)))
    found = found.select("x", "y", "asked", count.alias("shared")).where("shared >= asked")
    return found.withColumn("best", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "y")) <= FIRST).select("x", "y", "best")


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (x, y) whose ends are not yet in one component; the others cannot change any."""
    at = lambda end: comp.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
    found = pairs.join(at("x"), "x", "left").join(at("y"), "y", "left")
    return found.where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")


def link_documents(docs: DataFrame, crowd: int = BIG, dealt: int = DEALT, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, k (the set's name), h (the text's hash), c (the component's set) and component_id of every row of docs (doc_id, text).

    A component is named by its least doc_id, null if it has none; a null doc_id counts as the largest. Null and empty texts
    have no shingles, link with nothing and are their own component; equal sets are collapsed before pairing, so
    copies are never paired; each set's likeliest candidates are verified first, and near copies on a crowded shingle
    are linked to leaders, then all others only across components. ``crowd``, ``dealt`` and ``cell`` say how many sets on a
    shingle make it crowded, how many rows of it meet in one task, and how many of its sets are compared in one. Whole texts are used and no link is lost; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = [], []
            for s in text_sets(batch.column("text")):
                n.append(len(s))
                k.append(set_key(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["doc_id", "h", "n", "k"])

    members = staged(rows.mapInArrow(describe, "doc_id long, h long, n long, k long"), "members").withColumn("o", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    order = spark.sparkContext.broadcast(frequent_shingles(rows))
    probes = prefix_rows(rows, order, dealt).repartition("t", "z").sortWithinPartitions("t", "z", "k").mapInArrow(candidates_of(crowd), PROBES_DDL)
    probes = staged(probes, "probes")
    big = probes.where("kind = 2").select("t", "k", "m")
    first = staged(crowd_checked(matched(probes, True), big), "candidates")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, s = [], []
            seen: set[int] = set()
            for found in text_sets(batch.column("text")):
                key = set_key(found)
                if key not in seen:
                    seen.add(key)
                    k.append(key)
                    s.append(packed(found))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.binary())], names=["k", "s"])

    texts = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"), "h", "text")
    holders = staged(members.where("n > 0").groupBy("k").agg(F.min(F.struct("o", "h")).alias("doc")).select("k", "doc.o", "doc.h"), "holders")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only their own sets are read, each from its least document."""
        pairs = staged(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "pairs")
        ids = pairs.select(F.col("x").alias("k")).union(pairs.select(F.col("y").alias("k"))).distinct()
        ids = holders.join(ids, "k", "left_semi")
        own = may_hold(texts, F.xxhash64("o", "h"), ids, F.xxhash64("o", "h"), stage=False).where("__may")
        sets = staged(own.select("text").mapInArrow(extract, "k long, s binary"), "sets")
        links = staged(verified(pairs, sets), "links")
        for done in (sets, pairs):
            unstage(done)
        return links

    comp = contracted(linked(first.where("best")))
    comp = merged(comp, linked(apart(first.where("NOT best"), comp)))
    if not big.isEmpty():
        cross = cross_cells(big, comp, cell).repartition("cell").sortWithinPartitions("cell").mapInArrow(cross_candidates, PROBES_DDL)
        comp = merged(comp, linked(matched(cross, False)))
    own = members.join(comp.withColumnRenamed("v", "k"), "k", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("c", "k")))
    names = own.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return own.join(names, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), "k", "h", "c", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def digest(docs: DataFrame, **limits: int) -> DataFrame:
    """The columns of query op10."""
    return link_documents(docs, **limits).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group: those of the component's least doc_id, null the largest, and of its least
    text hash, repeated rows once; all columns stay. A text without shingles is a group of its id and text."""
    last = F.lit((1 << 63) - 1)
    one = link_documents(docs).select("c", F.coalesce("doc_id", last).alias("__o"), F.col("h").alias("__h"), (F.col("n_shingles") > 0).alias("some"))
    group = [F.when(F.col("some"), F.col("c")), F.when(~F.col("some"), F.col("__o")), F.when(~F.col("some"), F.col("__h"))]
    keep = one.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min(F.struct("__o", "__h")).alias("doc")).select("doc.__o", "doc.__h").distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("__o"), F.xxhash64("text").alias("__h"), F.struct("*").alias("__row"))
    return rows.join(keep, ["__o", "__h"], "left_semi").dropDuplicates(["__o", "__h"]).select("__row.*")


def oracle() -> str:
    """DuckDB SQL of op10: pairs on shared shingles, then a recursive walk."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, md5(array_to_string(w[i:i + {SIZE - 1}], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {SIZE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * i >= {PERCENT} * (a.n + b.n - i)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN r ON r.x = d.rid JOIN d e ON e.rid = r.y GROUP BY d.rid, d.doc_id, n.n"""
