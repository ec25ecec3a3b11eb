"""Embedding near-duplicates by NN-descent over balls of mutually linked vectors.

Equal vectors of a label are one class, found by a grouping. Classes within half
the threshold's angle of a leader all link with each other, whatever the rest
of the data; so a dense group is a few balls, its links are counted and never
listed, and the search runs on leaders.

Neighbour lists start from cells of random planes. A round joins the neighbours
and reverse neighbours of every leader, where one of two is new, and keeps the
best. A list whose entries all reach the threshold is saturated and doubled,
until none is. Rounds end when none finds a further threshold edge. The audit
then compares samples of leaders, drawn apart by how many edges they have, with
all leaders of their labels; edges that it misses are fed back and refined, and
a new sample is drawn, until the share of leaders with all edges found holds in
every sample. A sample that holds a whole label makes its result exact.

Threshold edges join balls. Where the angles of leaders and radii leave no
doubt, all their vectors link; else the two balls are compared, in blocks.

Rows: a vector that is null, zero, or holds null or non-finite components, and
one with a null label, links with nothing; vectors of different lengths never
link. Repeated rows are vectors of their own. A null id names a component only
where there is no other. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozemill.llm.common import components, saved

THRESHOLD = 0.93
#: Classes that are compared at once.
BLOCK = 512
#: Entries of a neighbour list at first; start tables of cells.
NEIGHBOURS, TABLES = 10, 4
#: Reverse neighbours that meet at once; leaders whose neighbours one group of a round joins.
REVERSE, TOGETHER = 32, 256
#: Leaders of each audit sample, and the share of them that must have every edge.
SAMPLE, AUDIT = 500, 0.99
#: Room for rounding, in radians.
SLACK = 1e-7
SEED = 29
_KEYS = ["label", "width"]


def unit(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of length one in double precision; all must have the same width."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = x.reshape(len(vectors), -1) if len(vectors) else x.reshape(0, 1)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(id, class, label, width, vec, n): one row per different comparable vector of a label."""
    grouped = vectors.groupBy(*_KEYS, "vec").agg(F.min("vec_id").alias("class"), F.count("*").alias("n"))
    return grouped.select(F.monotonically_increasing_id().alias("id"), "class", *_KEYS, "vec", "n")


# --- cells -------------------------------------------------------------------


def cells(nodes: DataFrame, tables: tuple[int, ...], block: int) -> DataFrame:
    """``nodes`` once per table, with table, cell and part: about ``block`` of a label on the same sides of random planes.

    Planes go through the medians of the label, so that a direction that all
    vectors share tells them apart no less; a cell that is still too large is dealt to parts.
    """
    sizes = nodes.groupBy(*_KEYS).agg(F.count("*").alias("size"))
    bits = F.when(F.col("size") > block, F.ceil(F.log2(F.col("size") / block))).otherwise(0).cast("int")
    wide = nodes.select("id", *_KEYS, "vec").join(sizes.select(*_KEYS, F.least(bits, F.lit(30)).alias("bits")), _KEYS)

    def run(batches):
        normals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            width, bits = (batch.column(i).to_numpy() for i in (2, 3))
            for table in tables:
                along: list[list[float]] = [[]] * len(batch)
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    if (table, w) not in normals:
                        normals[table, w] = np.random.default_rng([SEED, table, w]).normal(size=(w, 30))
                    values = unit(batch.column(4).take(pa.array(at))) @ normals[table, w]
                    for i, row in zip(at.tolist(), values, strict=True):
                        along[i] = row[: bits[i]].tolist()
                named = [pa.array(np.full(len(batch), table, np.int32)), pa.array(along, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *named], names=["id", *_KEYS, "table", "along"])

    label = nodes.schema["label"].dataType.simpleString()
    placed = saved(
        wide.select("id", *_KEYS, "bits", "vec").mapInArrow(
            run, f"id bigint, label {label}, width int, table int, along array<double>"
        )
    )
    of = [*_KEYS, "table"]
    middle = (
        placed.select(*of, F.posexplode("along").alias("plane", "x"))
        .groupBy(*of, "plane")
        .agg(F.percentile_approx("x", 0.5).alias("x"))
        .groupBy(*of)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("plane", "x"))), lambda p: p["x"]).alias("middle"))
    )
    sides = F.zip_with("along", F.coalesce("middle", F.array().cast("array<double>")), lambda a, m: F.when(a > m, "1").otherwise("0"))
    sided = placed.join(middle, of, "left").select("id", *of, F.array_join(sides, "").alias("cell"))
    full = sided.groupBy(*of, "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("id", "table"), F.col("parts")).alias("part")
    return nodes.join(sided.join(full, [*of, "cell"]).select("id", "table", "cell", part), "id")


# --- balls -------------------------------------------------------------------


def balls(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, leader, off): every class within half the threshold's angle of a leader, ``off`` radians away.

    Leaders are taken within blocks, then leaders among leaders, as long as that
    makes clearly fewer balls; a member follows only if it is as near to the new one.
    """
    near = math.acos(threshold) / 2 - SLACK

    def lead(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group.column("id").to_numpy()
        x = unit(group.column("vec"))
        leader, off = np.full(len(ids), -1), np.zeros(len(ids))
        for i in range(len(ids)):
            if leader[i] < 0:
                away = angle(x @ x[i])
                away[i] = 0.0
                own = (leader < 0) & (away <= near)
                leader[own], off[own] = ids[i], away[own]
        return pa.table({"id": ids, "leader": leader, "off": off})

    def grouped(some: DataFrame, table: int) -> DataFrame:
        return cells(some, (table,), block).groupBy(*_KEYS, "cell", "part").applyInArrow(lead, "id bigint, leader bigint, off double")

    def moved(batches):
        for batch in batches:
            width = batch.column(5).to_numpy()
            away = np.zeros(len(batch))
            for w in np.unique(width):
                at = pa.array(np.flatnonzero(width == w))
                pairs = unit(batch.column(3).take(at)) * unit(batch.column(4).take(at))
                away[at] = angle(pairs.sum(1))
            away[batch.column(0).to_numpy() == batch.column(6).to_numpy()] = 0.0
            goes = away <= near
            leader = np.where(goes, batch.column(6).to_numpy(), batch.column(1).to_numpy())
            off = np.where(goes, away, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leader), pa.array(off)], names=["id", "leader", "off"])

    found = saved(grouped(nodes, 100))
    before, table = nodes.count(), 101
    while True:
        leaders = found.select(F.col("leader").alias("id")).distinct()
        now = leaders.count()
        if now > 0.8 * before or now <= 1:
            return found
        before = now
        heads = saved(nodes.join(leaders, "id"))
        over = grouped(heads, table).select(F.col("id").alias("leader"), F.col("leader").alias("over"))
        wide = (
            found.join(over, "leader")
            .join(nodes.select("id", "vec", "width"), "id")
            .join(heads.select(F.col("id").alias("over"), F.col("vec").alias("over_vec")), "over")
            .select("id", "leader", "off", "vec", "over_vec", "width", "over")
        )
        found = saved(wide.mapInArrow(moved, "id bigint, leader bigint, off double"))
        table += 1


# --- neighbour lists ---------------------------------------------------------


def may_link(cosine: np.ndarray, radius: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two balls can hold a link."""
    return angle(cosine) <= math.acos(threshold) + radius + other + SLACK


_FOUND = "id bigint, other bigint, cosine double, edge boolean"


def _pairs(x: np.ndarray, ids: np.ndarray, radius: np.ndarray, worst: np.ndarray, fresh: np.ndarray | None, threshold: float, k: int):
    """Both directions of the pairs worth keeping: threshold edges, and the k best that beat a list's worst."""
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2.0)
    edge = may_link(cosine, radius[:, None], radius[None, :], threshold)
    np.fill_diagonal(edge, False)
    if fresh is not None:
        known = ~(fresh[:, None] | fresh[None, :])
        cosine[known], edge[known] = -2.0, False
    if len(ids) > k:
        cut = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        keep = edge | ((cosine >= cut) & (cosine > np.maximum(worst[:, None], -1.5)))
    else:
        keep = edge | (cosine > np.maximum(worst[:, None], -1.5))
    i, j = np.nonzero(keep)
    return ids[i], ids[j], cosine[i, j], edge[i, j]


def _table(parts: list) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, bool)]
    return pa.table(dict(zip(("id", "other", "cosine", "edge"), columns, strict=True)))


def started(heads: DataFrame, threshold: float, block: int, k: int) -> DataFrame:
    """First lists: every leader's best in the cells of each table."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, radius = group.column("id").to_numpy(), group.column("radius").to_numpy()
        return _table([_pairs(unit(group.column("vec")), ids, radius, np.full(len(ids), -2.0), None, threshold, k)])

    dealt = cells(heads.drop("total"), tuple(range(TABLES)), block)
    return dealt.groupBy(*_KEYS, "table", "cell", "part").applyInArrow(compare, _FOUND)


def trimmed(found: DataFrame, k: int) -> DataFrame:
    """Lists of different entries: all threshold edges, and others up to the list's size.

    The size is ``k``, doubled until the list is not saturated with edges. ``fresh``
    marks what the last round brought.
    """
    lists = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"), F.max("edge").alias("edge"), F.min("fresh").alias("fresh"))
    own = Window.partitionBy("id")
    edges = F.sum(F.col("edge").cast("int")).over(own)
    size = F.lit(k) * F.pow(2, F.greatest(F.lit(0), F.floor(F.log2(F.greatest(edges / k, F.lit(0.5)))) + 1))
    place = F.row_number().over(own.orderBy(F.col("edge").desc(), F.col("cosine").desc(), "other"))
    return lists.select("*", size.alias("size"), place.alias("place")).where("place <= size").drop("size", "place")


def refined(lists: DataFrame, heads: DataFrame, threshold: float, k: int, groups: int) -> DataFrame:
    """What one round finds: neighbours and reverse neighbours of a leader, joined with each other."""
    worst = lists.groupBy("id").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(F.lit(-2.0)).alias("worst"))
    forward = lists.select(F.col("id").alias("at"), F.col("other").alias("id"), "fresh", F.lit(0).alias("back"))
    reverse = lists.select(F.col("other").alias("at"), "id", "fresh", F.lit(1).alias("back"))
    # A leader that many lists name has its reverse neighbours dealt to parts; its own meet each part.
    parts = reverse.groupBy("at").agg(F.ceil(F.count("*") / REVERSE).alias("parts"))
    some = F.pmod(F.xxhash64("id", "at"), F.col("parts"))
    meet = forward.join(parts, "at", "left").select("at", "id", "fresh", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    meet = meet.union(reverse.join(parts, "at").select("at", "id", "fresh", some.cast("bigint")))
    meet = meet.groupBy("at", "part", "id").agg(F.max("fresh").alias("fresh"))
    busy = meet.where("fresh").select("at", "part").distinct()
    meet = meet.join(busy, ["at", "part"], "left_semi")
    wide = meet.join(heads.select("id", "vec", "radius", "width"), "id").join(worst, "id", "left")
    rows = wide.select(
        F.pmod(F.xxhash64("at", "part"), F.lit(groups)).alias("group"),
        "width", "at", "part", "id", "vec", "radius", "fresh", F.coalesce("worst", F.lit(-2.0)).alias("worst"),
    )

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("part", "ascending"), ("id", "ascending")])
        at, part, ids = (group.column(c).to_numpy() for c in ("at", "part", "id"))
        radius, worst = group.column("radius").to_numpy(), group.column("worst").to_numpy()
        fresh = np.asarray(group.column("fresh"))
        x = unit(group.column("vec"))
        new = np.flatnonzero((np.diff(at, prepend=at[0] - 1) != 0) | (np.diff(part, prepend=part[0]) != 0))
        found = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True):
            if b - a > 1:
                found.append(_pairs(x[a:b], ids[a:b], radius[a:b], worst[a:b], fresh[a:b], threshold, k))
        return _table(found)

    return rows.groupBy("group", "width").applyInArrow(join, _FOUND)


def audited(lists: DataFrame, heads: DataFrame, threshold: float, seed: int, sample: int) -> tuple[DataFrame | None, list[float]]:
    """(missing edges if there are any, share of leaders with every edge per sample): no edge found, few edges, many edges.

    A sample holds at most ``sample`` leaders; with their vectors it is sent to
    the tasks, which compare it with all leaders.
    """
    degree = lists.where("edge").groupBy("id").agg(F.count("*").alias("edges"))
    kind = F.when(F.col("edges").isNull(), 0).when(F.col("edges") < 4, 1).otherwise(2)
    drawn = heads.join(degree, "id", "left").select("id", *_KEYS, "vec", "radius", kind.alias("kind"), F.xxhash64("id", F.lit(seed)).alias("draw"))
    few = [drawn.where(F.col("kind") == k).orderBy("draw", "id").limit(sample) for k in (0, 1, 2)]
    some = few[0].union(few[1]).union(few[2]).collect()
    by_key: dict[tuple, list] = {}
    for r in some:
        by_key.setdefault((r["label"], r["width"]), []).append(r)
    asked = {
        key: (
            np.array([r["id"] for r in rows]),
            unit(pa.array([r["vec"] for r in rows], pa.list_(pa.float64()))),
            np.array([r["radius"] for r in rows]),
        )
        for key, rows in by_key.items()
    }

    def compare(batches):
        for batch in batches:
            ids, width, radius = (batch.column(i).to_numpy() for i in (0, 2, 4))
            labels = batch.column(1).to_pylist()
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, width.tolist(), strict=True)):
                if key in asked:
                    places.setdefault(key, []).append(i)
            found = []
            for key, at in places.items():
                known, y, r = asked[key]
                cosine = y @ unit(batch.column(3).take(pa.array(at))).T
                edge = may_link(cosine, r[:, None], radius[at][None, :], threshold)
                edge &= known[:, None] != ids[at][None, :]
                i, j = np.nonzero(edge)
                found.append((known[i], ids[at][j], cosine[i, j], np.ones(len(i), bool)))
            yield from _table(found).to_batches() if found else ()

    truth = heads.select("id", *_KEYS, "vec", "radius").mapInArrow(compare, _FOUND)
    missing = saved(truth.join(lists.where("edge").select("id", "other"), ["id", "other"], "left_anti").select("id", "other", "cosine", "edge"))
    lacking = {r["id"] for r in missing.select("id").distinct().collect()}
    shares = []
    for kind in (0, 1, 2):
        own = [r["id"] for r in some if r["kind"] == kind]
        shares.append(1 - sum(i in lacking for i in own) / len(own) if own else 1.0)
    return missing if lacking else None, shares


def search(heads: DataFrame, threshold: float, block: int = BLOCK, k: int = NEIGHBOURS, sample: int = SAMPLE) -> tuple[DataFrame, list[list[float]]]:
    """(edges in both directions, the shares of each audit): pairs of balls that can hold a link."""
    groups = max(heads.count() // TOGETHER, 1)
    new = F.lit(True).alias("fresh")
    old = F.lit(False).alias("fresh")

    def count_edges(lists: DataFrame) -> int:
        return lists.where("edge").count()

    lists = saved(trimmed(started(heads, threshold, block, k).select("*", new), k))
    edges, audits, rounds = count_edges(lists), [], 0
    while True:
        while True:
            found = refined(lists, heads, threshold, k, groups).select("*", new)
            lists = saved(trimmed(lists.select("id", "other", "cosine", "edge", old).union(found), k))
            before, edges, rounds = edges, count_edges(lists), rounds + 1
            if edges == before:
                break
        missing, shares = audited(lists, heads, threshold, SEED + len(audits), sample)
        audits.append(shares)
        if missing is not None:
            back = missing.select(F.col("other").alias("id"), F.col("id").alias("other"), "cosine", "edge")
            both = missing.union(back).select("*", new)
            lists = saved(trimmed(lists.select("id", "other", "cosine", "edge", old).union(both), k))
            edges = count_edges(lists)
        if min(shares) >= AUDIT:
            return lists.where("edge").select("id", "other", "cosine"), audits


# --- links -------------------------------------------------------------------


def linked(members: DataFrame, heads: DataFrame, edges: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """((id, linked), (a, b)): links of a class outside its ball, and pairs of balls with a link.

    ``members`` are the classes with their leader. ``sure``: leaders and radii
    are so near that all classes of two balls link; else they are compared in
    blocks of either ball.
    """
    limit = F.lit(math.acos(threshold))
    one = heads.select("id", F.col("radius").alias("r"))
    two = heads.select(F.col("id").alias("other"), F.col("radius").alias("q"), F.col("total").alias("many"))
    apart = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))
    judged = saved(
        edges.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).join(one, "id").join(two, "other")
        .select("id", "other", "many", (apart + F.col("r") + F.col("q") + SLACK <= limit).alias("sure"))
    )
    sure = judged.where("sure")
    by_ball = sure.groupBy(F.col("id").alias("leader")).agg(F.sum("many").alias("linked"))
    doubtful = judged.where(~F.col("sure") & (F.col("id") < F.col("other"))).select(F.col("id").alias("low"), F.col("other").alias("high"))
    sizes = members.groupBy("leader").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = members.join(sizes, "leader").select("id", "leader", "vec", "n", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    pairs = doubtful.join(sizes.select(F.col("leader").alias("low"), F.col("parts").alias("low_parts")), "low").join(
        sizes.select(F.col("leader").alias("high"), F.col("parts").alias("high_parts")), "high"
    )

    def side(own: str, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias("across")
        rows = pairs.select("low", "high", F.col(own).alias("leader"), each).join(dealt, "leader")
        first, second = ("part", "across") if own == "low" else ("across", "part")
        return rows.select("low", "high", F.col(first).cast("bigint").alias("i"), F.col(second).cast("bigint").alias("j"), F.lit(own == "low").alias("is_low"), "id", "vec", "n")

    def compare(group: pa.Table) -> pa.Table:
        low = np.asarray(group.column("is_low"))
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy().astype(float)
        x = unit(group.column("vec"))
        links = x[low] @ x[~low].T >= threshold
        many = np.zeros(len(ids))
        many[low], many[~low] = links @ n[~low], links.T @ n[low]
        some = many > 0
        ends = [np.full(int(some.sum()), group.column(c)[0].as_py()) for c in ("low", "high")]
        return pa.table({"id": ids[some], "linked": many[some].astype(np.int64), "a": ends[0], "b": ends[1]})

    compared = saved(
        side("low", "high").union(side("high", "low")).groupBy("low", "high", "i", "j").applyInArrow(compare, "id bigint, linked bigint, a bigint, b bigint")
    )
    outside = members.join(by_ball, "leader").select("id", "linked").union(compared.select("id", "linked"))
    joined = sure.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).union(compared.select("a", "b").distinct())
    return outside.groupBy("id").agg(F.sum("linked").alias("linked")), joined


def near_duplicates(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    report: list | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``rows``.

    ``report`` takes the shares of each audit, if a list is given.
    """
    vec: Column = F.col(embedding)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(label).isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    named = rows.select(
        F.col(vec_id).alias("vec_id"),
        F.when(usable, F.col(label)).alias("label"),
        F.when(usable, vec).alias("vec"),
        F.size(vec).alias("width"),
    )
    known = named.where("vec is not null")
    nodes = saved(classes_of(known))
    members = saved(nodes.join(balls(nodes, threshold, block), "id"))
    about = members.groupBy("leader").agg(F.max("off").alias("radius"), F.sum("n").alias("total"))
    heads = saved(nodes.join(about.withColumnRenamed("leader", "id"), "id").select("id", *_KEYS, "vec", "radius", "total"))
    edges, audits = search(heads, threshold, block, sample=sample)
    if report is not None:
        report += audits
    outside, joined = linked(members, heads, edges, threshold, block)
    roots = components(joined).select(F.col("node").alias("leader"), "root")
    whole = (
        members.join(heads.select(F.col("id").alias("leader"), "total"), "leader")
        .join(roots, "leader", "left")
        .join(outside, "id", "left")
        .select("label", "vec", "class", F.coalesce("root", "leader").alias("root"), (F.col("total") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    least = whole.groupBy("root").agg(F.min("class").alias("component_id"))
    by_class = whole.join(least, "root").select("label", "vec", "component_id", "n_links")
    joined = known.join(by_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = named.where("vec is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined.union(alone).withColumn("kept", kept)
