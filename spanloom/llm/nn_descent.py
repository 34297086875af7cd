"""Near-duplicate vectors by NN-descent.

Equal vectors of one label are one item.  A forest of random-hyperplane codes gives each item first
neighbours: items sorted by (tree, label, code) are cut into leaves, and within a leaf all items are
compared.  Then lists are refined: at every item the neighbours it has and that have it meet, pairs
with a new member are compared, and each end keeps its ``neighbours`` best.  Rounds end when few
lists change.  Items whose whole list lies above the threshold are saturated; the components of the
threshold graph that hold such items have their lists enlarged to all of the component, compared
block by block.  Recall is audited item by item, against all others of their label, on a sample that
grows until it has links of enough components; if its mean is under ``target``, lists and forest are
doubled and the descent goes on, and when that does not help, each label is compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.session import Workspace

#: Entries of a leaf, bits of a code, and items of a block in an enlarged list.
LEAF, BITS, BLOCK = 48, 40, 512
#: Items in the audit of recall at first and, at most, at once; components with links that end it.
AUDIT, AUDIT_MOST, ENOUGH = 256, 4096, 32


def unit(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def runs(batches, keys: list[str], most: int):
    """Record batches of whole runs of equal keys, of about ``most`` rows; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            new = _starts(table, keys)
            cut = int(new[-1])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _pairs(a, b, cos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos)], ["a", "b", "cos"])


def _codes(trees: int, width: int, first: int):
    planes = np.random.default_rng(17 + first).standard_normal((trees, width, BITS))

    def run(batches):
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            vectors = unit(batch.column("vec"), width) if batch.num_rows else np.zeros((0, width))
            for t in range(trees):
                code = (vectors @ planes[t] > 0) @ weights
                tree = pa.array(np.full(batch.num_rows, t, np.int32))
                yield pa.RecordBatch.from_arrays([tree, pa.array(code), *batch.columns], ["tree", "code", *batch.schema.names])

    return run


def _padded(table: pa.Table, starts: np.ndarray, width: int):
    """Runs of similar length together: (row numbers with -1 for none, unit vectors)."""
    sizes = np.diff(np.r_[starts, table.num_rows])
    vectors = unit(table.column("vec").combine_chunks(), width)
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        most = int(sizes[order[min(i + 127, len(order) - 1)]])
        own = order[i : i + 128]
        i += 128
        if most < 2:
            continue
        rows = starts[own][:, None] + np.arange(most)
        rows[np.arange(most) >= sizes[own][:, None]] = -1
        yield rows, np.where((rows >= 0)[:, :, None], vectors[rows], 0.0)


def _leaves(width: int, most: int):
    def run(batches):
        for table in runs(batches, ["tree", "grp"], 4 * LEAF * 64):
            starts = []
            edges = [*_starts(table, ["tree", "grp"]).tolist(), table.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                starts += range(a, b, LEAF)
            item = table.column("item").to_numpy()
            for rows, vectors in _padded(table, np.array(starts), width):
                cos = vectors @ vectors.transpose(0, 2, 1)
                none = rows < 0
                cos[none[:, :, None] | none[:, None, :]] = -2
                cos[:, np.arange(rows.shape[1]), np.arange(rows.shape[1])] = -2
                k = min(most, rows.shape[1] - 1)
                best = np.argpartition(-cos, k - 1, axis=2)[:, :, :k]
                value = np.take_along_axis(cos, best, 2)
                good = value > -1.5
                a = np.broadcast_to(rows[:, :, None], best.shape)[good]
                b = np.take_along_axis(np.broadcast_to(rows[:, None, :], cos.shape), best, 2)[good]
                yield _pairs(item[a], item[b], value[good])

    return run


def _meet(width: int):
    """At each meeting place: pairs with a new member, for the ends that they improve."""

    def run(batches):
        for table in runs(batches, ["place"], 8192):
            item, worst = table.column("item").to_numpy(), table.column("worst").to_numpy()
            fresh = table.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
            for rows, vectors in _padded(table, _starts(table, ["place"]), width):
                cos = vectors @ vectors.transpose(0, 2, 1)
                none = rows < 0
                new = fresh[rows]
                use = (new[:, :, None] | new[:, None, :]) & ~none[:, :, None] & ~none[:, None, :]
                use &= (item[rows][:, :, None] != item[rows][:, None, :]) & (cos > worst[rows][:, :, None])
                g, i, j = np.nonzero(use)
                yield _pairs(item[rows[g, i]], item[rows[g, j]], cos[g, i, j])

    return run


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a block of links: the first row that it is connected with, or -1."""
    none = len(linked)
    row = np.where(linked.any(axis=1), np.arange(none), none)
    while True:
        column = np.where(linked, row[:, None], none).min(axis=0, initial=none)
        after = np.minimum(row, np.where(linked, column[None, :], none).min(axis=1, initial=none))
        if (after == row).all():
            return np.where(row < none, row, -1), np.where(column < none, column, -1)
        row = after


def _blocks(width: int, threshold: float):
    """Links inside a pair of blocks of one component: with how many vectors each item is linked, and one item connected with it."""

    def rows(item: np.ndarray, n: np.ndarray, root: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (item, n, np.where(root < 0, item, roots[root]))], ["item", "n", "root"])

    def run(batches):
        for table in runs(batches, ["component", "low", "high"], 1):
            starts = [*_starts(table, ["component", "low", "high"]).tolist(), table.num_rows]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(i, j - i).combine_chunks()
                vectors = unit(part.column("vec").combine_chunks(), width)
                item, own, copies = (part.column(n).to_numpy() for n in ("item", "block", "copies"))
                low, high = own == part.column("low")[0].as_py(), own == part.column("high")[0].as_py()
                if not low.any() or not high.any():
                    continue
                linked = vectors[low] @ vectors[high].T >= threshold
                linked &= item[low][:, None] != item[high][None, :]
                first, second = _roots(linked)
                yield rows(item[low], linked @ copies[high], first, item[low])
                # A block with itself: its links are counted above, but the columns' roots join the two sides.
                apart = part.column("low")[0] != part.column("high")[0]
                yield rows(item[high], linked.T @ copies[low] * int(apart), second, item[low])

    return run


def _best(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best neighbours of each item, from rows (a, b, cos, fresh)."""
    one = rows.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return one.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


class Descent:
    """Neighbour lists (a, b, cos, fresh) over the items (item, grp, copies, vec)."""

    def __init__(self, items: DataFrame, width: int, work: Workspace, neighbours: int, trees: int):
        self.items, self.width, self.work, self.most, self.trees = items, width, work, neighbours, trees
        self.lists: DataFrame | None = None
        self.planted = 0
        self.size = items.count()
        self.parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _replace(self, lists: DataFrame) -> None:
        old, self.lists = self.lists, self.work.save(lists, "lists")
        if old is not None:
            self.work.drop(old)

    def plant(self) -> None:
        """Add the neighbours that a new forest gives."""
        order = ["tree", "grp", "code", "item"]
        coded = self.items.mapInArrow(_codes(self.trees, self.width, self.planted), f"tree int, code long, {_fields(self.items)}")
        coded = coded.select(*order, "vec").repartitionByRange(self.parts, *order).sortWithinPartitions(*order)
        found = coded.mapInArrow(_leaves(self.width, self.most), "a long, b long, cos double").withColumn("fresh", F.lit(True))
        self.planted += self.trees
        self._replace(_best(found if self.lists is None else found.union(self.lists), self.most))

    def refine(self) -> int:
        """One round of neighbours of neighbours; the number of list entries that are new."""
        lists = self.lists
        worst = lists.groupBy("a").agg(F.min("cos").alias("worst"), F.count("*").alias("n")).select(
            F.col("a").alias("item"), F.when(F.col("n") >= self.most, F.col("worst")).otherwise(-2.0).alias("worst")
        )
        there = lists.select(F.col("a").alias("place"), F.col("b").alias("item"), "fresh")
        # Of the items that have a very common neighbour, only some meet there, new entries first.
        crowd = Window.partitionBy("place").orderBy(F.desc("fresh"), F.xxhash64("item"))
        back = lists.select(F.col("b").alias("place"), F.col("a").alias("item"), "fresh")
        back = back.withColumn("k", F.row_number().over(crowd)).where(F.col("k") <= self.most).drop("k")
        own = self.items.select(F.col("item").alias("place"), "item", F.lit(False).alias("fresh"))
        met = there.union(back).union(own).groupBy("place", "item").agg(F.max("fresh").alias("fresh"))
        busy = lists.where("fresh").select(F.explode(F.array("a", "b")).alias("place")).distinct()
        met = met.join(busy, "place", "left_semi").join(worst, "item", "left").join(self.items.select("item", "vec"), "item")
        met = met.select("place", "item", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "fresh", "vec")
        dealt = met.repartition(self.parts, "place").sortWithinPartitions("place", "item")
        pairs = dealt.mapInArrow(_meet(self.width), "a long, b long, cos double").withColumn("fresh", F.lit(True))
        self._replace(_best(lists.withColumn("fresh", F.lit(False)).union(pairs), self.most))
        return self.lists.where("fresh").count()

    def run(self, rounds: int) -> None:
        self.plant()
        for _ in range(rounds):
            if self.refine() <= 0.002 * self.size * self.most:
                return

    def links(self, threshold: float) -> tuple[DataFrame, DataFrame]:
        """(node, component) of linked items, and (item, n): with how many vectors an item is linked."""
        above = self.lists.where(F.col("cos") >= threshold)
        edges = self.work.save(above.select("a", "b").union(above.select("b", "a")).distinct(), "edges")
        groups = components(edges, self.work)
        copies = self.items.select("item", "copies")
        full = above.groupBy("a").count().where(F.col("count") >= self.most)
        wide = groups.join(full, F.col("node") == F.col("a"), "left_semi").select("component").distinct()
        wide = self.work.save(wide, "saturated")
        narrow = edges.join(groups.join(wide, "component", "left_anti").select(F.col("node").alias("a")), "a")
        counts = narrow.join(copies.withColumnRenamed("item", "b"), "b").groupBy(F.col("a").alias("item")).agg(F.sum("copies").alias("n"))
        members = groups.join(wide, "component", "left_semi")
        more = self._compared(members.select("component", F.col("node").alias("item")), threshold).select("item", "n")
        return groups, self.work.save(counts.union(more).groupBy("item").agg(F.sum("n").alias("n")), "counts")

    def _compared(self, members: DataFrame, threshold: float) -> DataFrame:
        """All items of a component with each other, in pairs of blocks: item, n, root."""
        blocks = members.groupBy("component").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
        dealt = members.join(blocks, "component").select(
            "component", "item", "blocks", F.expr("cast(pmod(xxhash64(item), blocks) as int)").alias("block")
        )
        dealt = dealt.join(self.items.select("item", "copies", "vec"), "item").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["component", "low", "high"]
        dealt = dealt.select(
            "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "item", "block", "copies", "vec"
        )
        dealt = dealt.repartition(self.parts, *keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(_blocks(self.width, threshold), "item long, n long, root long")

    def exact(self, threshold: float) -> tuple[DataFrame, DataFrame]:
        """What :meth:`links` gives, from all pairs of each label."""
        found = self._compared(self.items.select(F.col("grp").alias("component"), "item"), threshold)
        found = self.work.save(found.where("n > 0 or item <> root"), "compared")
        edges = found.where("item <> root").select(F.col("item").alias("a"), F.col("root").alias("b"))
        return components(edges, self.work), self.work.save(found.groupBy("item").agg(F.sum("n").alias("n")), "counts")

    def recall(self, groups: DataFrame, counts: DataFrame, threshold: float) -> float:
        """The mean share of an item's links, against all items of its label, that was found.

        Items of one component count as one.  More items are audited until ``ENOUGH`` components
        with links are seen, or all items.
        """
        order = F.pmod(F.xxhash64("item", F.lit(5)), F.lit(1 << 40))
        low, size, linked, shares = 0, AUDIT, 0, 0.0
        while low < 1 << 40 and linked < ENOUGH:
            high = min(1 << 40, low + -(-(size << 40) // max(self.size, 1)))
            row = self._audit(self.items.where((order >= low) & (order < high)), groups, counts, threshold)
            linked, shares = linked + row[0], shares + (row[1] or 0.0)
            low, size = high, min(4 * size, AUDIT_MOST)
        return shares / linked if linked else 1.0

    def _audit(self, sample: DataFrame, groups: DataFrame, counts: DataFrame, threshold: float) -> tuple[int, float]:
        """Of the components of these items: how many have links, and the sum of the shares found."""
        width = self.width
        chosen = sample.collect()
        if not chosen:
            return 0, 0.0
        vectors = unit(pa.array([r.vec for r in chosen]), width)
        asked = self.items.sparkSession.sparkContext.broadcast(
            (vectors, np.array([r.grp for r in chosen]), np.array([r.item for r in chosen]))
        )

        def count(batches):
            for batch in batches:
                if batch.num_rows:
                    own, grp, item = asked.value
                    linked = own @ unit(batch.column("vec"), width).T >= threshold
                    linked &= grp[:, None] == batch.column("grp").to_numpy()[None, :]
                    linked &= item[:, None] != batch.column("item").to_numpy()[None, :]
                    n = linked @ batch.column("copies").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(item[n > 0]), pa.array(n[n > 0])], ["item", "n"])

        true = self.items.mapInArrow(count, "item long, n long").groupBy("item").agg(F.sum("n").alias("true"))
        true = self.work.save(true, "true")
        asked.unpersist()
        few = F.broadcast(true.select("item"))
        found = counts.join(few, "item", "left_semi").withColumnRenamed("item", "a")
        named = groups.join(few, F.col("node") == F.col("item"), "left_semi")
        both = true.join(F.broadcast(found), F.col("item") == F.col("a"), "left").join(F.broadcast(named), F.col("item") == F.col("node"), "left")
        share = F.coalesce("n", F.lit(0)) / F.col("true")
        one = both.groupBy(F.coalesce("component", "item").alias("root")).agg(F.avg(share).alias("share"))
        return one.agg(F.count("*"), F.sum("share")).first()


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    neighbours: int = 10,
    trees: int = 8,
    rounds: int = 5,
    target: float = 0.95,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared.  Rows whose label, id or vector is null,
    whose vector is zero, or holds a null or a component that is not finite, are linked with nothing.
    Equal vectors are linked with each other; ``n_links`` counts other rows.  ``component_id`` is the
    smallest id reachable; a row with a null id has none and is not kept.  Other columns are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "nn-descent")
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(
        F.col(label).isNotNull() & F.col(key).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), v.alias("vec"), valid.alias("valid"))
    # The code of a vector stands for it; -0.0 counts as 0.0.
    plain = F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("double"))
    coded = rows.select("vec_id", "valid", F.when(F.col("valid"), F.xxhash64("label", plain)).alias("item"))
    coded = work.save(coded, "rows")
    shaped = rows.where("valid").select("vec_id", "vec", F.xxhash64("label", plain).alias("item"), F.xxhash64("label", F.size("vec")).alias("grp"))
    width = shaped.agg(F.max(F.size("vec"))).first()[0]
    kind = dict(rows.dtypes)["vec_id"]
    if width is None:
        return coded.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    padding = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec"))
    items = shaped.groupBy("item", "grp").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("vec").alias("vec"))
    items = work.save(items.withColumn("vec", F.concat("vec", padding.cast(dict(rows.dtypes)["vec"]))), "items")

    descent = Descent(items, width, work, neighbours, trees)
    while True:
        descent.run(rounds)
        groups, counts = descent.links(threshold)
        if descent.recall(groups, counts, threshold) >= target:
            break
        if descent.most >= 8 * neighbours:
            groups, counts = descent.exact(threshold)
            break
        descent.most, descent.trees = 2 * descent.most, 2 * descent.trees
    rooted = items.join(groups, F.col("item") == F.col("node"), "left").select(
        "item", "first", "copies", F.coalesce("component", "item").alias("root")
    )
    rooted = work.save(rooted.join(counts, "item", "left"), "rooted")
    heads = work.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
    named = rooted.join(heads, "root").select("item", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = work.save(named, "named")
    out = coded.join(named, "item", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast(kind).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
