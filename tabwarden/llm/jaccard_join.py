"""Exact similarity join of shingle sets in the metric space of the Jaccard distance.

Texts that are equal are one class. The join has three steps.

*Pivots.* Two classes within the distance share a shingle among each one's rarest ``missing + 1``
shingles, ``missing`` being how many a set can do without. Each shared rare shingle makes the
least class that holds it a pivot, and the classes that hold it belong to the pivot's region: a
Voronoi region in which the pivots compete by rare contents, because unrelated texts all lie at
distance one and would be near no pivot picked at random. A class that meets several pivots lies
on a boundary and is replicated to each region.

*Regions.* In a region distances to the pivot are computed exactly. Members within the radius
link. By the triangle inequality another member x can link to such a y only if
``d(x, pivot) - d(y, pivot) <= radius``; only that window is compared. The members left over are
joined recursively with a pivot of their own, and again only inside windows. A region with many
members is dealt over tasks that each hold the pivot. What is left over is dealt anew, to pivots by
the rarest of all shingles that it still shares; what stays together even so is cut into blocks,
and each two blocks meet in a task of their own.

*Classes.* Links make components, by rounds of star contraction on the link table.

To know which shingles are rare, every set shows a part of its shingles: those whose hash lies
below ``shown`` of the range, the same for all sets, so rarity is counted over all documents and
not sampled. Sets that are small, or show too few, show all; two sets that could link always
have a common way of showing in which the argument holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.operators.bitmap import key_bitmap, with_hits
from tabwarden.llm.common import SPACE, counted_broadcast, slices
from tabwarden.llm.components import component_roots
from tabwarden.operators.skew import spread_join
from tabwarden.session import persisted_copy


@dataclass(frozen=True)
class JaccardRule:
    #: Link when 100 * intersection >= percent * union.
    percent: int = 75
    #: Words per shingle.
    width: int = 5
    #: Part of the hash range that a set shows.
    shown: float = 0.4
    #: Sets of fewer shingles show all of them.
    small: int = 128
    #: Members of a region that one task compares with the pivot.
    members: int = 4096

    def missing(self, n: int) -> int:
        """Shingles that a set of n can have outside a set it links with."""
        return n * (100 - self.percent) // 100

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100


def _show(rule: JaccardRule):
    """(class, text) -> (token, class, n, shown): the shingles that each set shows. Tokens of sets
    that show all are negative, so the two ways never meet."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabwarden.llm.fingerprints import shingle_sets, text_buffers

        bound = int(rule.shown * 2**63)
        seen: set[int] = set()
        for batch in slices(batches, 1 << 20):
            tokens, owners, counts, showns = [], [], [], []
            sets = shingle_sets(*text_buffers(batch.column("text")), rule.width)
            for cls, own in zip(batch.column("class").to_pylist(), sets, strict=True):
                n = len(own)
                if not n or cls in seen:
                    continue
                seen.add(cls)
                if len(seen) > 500_000:
                    seen.clear()
                part = own[: np.searchsorted(own, bound)]
                few = len(part) <= rule.missing(n)
                ways = []
                if n < rule.small or few:
                    ways.append(-own - 1)
                if 100 * n >= rule.percent * rule.small:
                    ways.append(part)
                for way in ways:
                    if len(way):
                        tokens.append(way)
                        owners.append(np.full(len(way), cls, np.int64))
                        counts.append(np.full(len(way), n, np.int32))
                        showns.append(np.full(len(way), len(way), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (tokens, owners, counts, showns)],
                    ["token", "class", "n", "shown"],
                )

    return run


def contacts(classed: DataFrame, rule: JaccardRule) -> DataFrame:
    """``pivot, class``: the regions, from ``class, text`` rows."""
    shown = classed.select("class", "text").mapInArrow(_show(rule), "token long, class long, n int, shown int")
    by_token = Window.partitionBy("token")
    shared = shown.select(
        "*",
        F.count("*").over(by_token).alias("spread"),
        F.min("class").over(by_token).alias("low"),
        F.max("class").over(by_token).alias("high"),
    ).where("low != high")
    rarest = shared.groupBy("class", (F.col("token") < 0).alias("all"), "n", "shown").agg(
        F.sort_array(F.collect_set(F.struct("spread", "token"))).alias("met")
    )
    needed = F.floor(F.col("n") * (100 - rule.percent) / 100).cast("int") + 1
    # Shingles that no other class has are the rarest and come first; they meet nobody.
    left = F.least(needed, F.col("shown")) - (F.col("shown") - F.size("met"))
    met = rarest.where(left > 0).select("class", F.explode(F.slice("met", 1, left)).alias("m"))
    by_shared = Window.partitionBy("token")
    return (
        met.select(F.col("m.token").alias("token"), "class")
        .select("class", F.min("class").over(by_shared).alias("pivot"), F.max("class").over(by_shared).alias("high"))
        .where("pivot != high")
        .select("pivot", "class")
        .distinct()
    )


def _sets(rule: JaccardRule):
    """Every row's set size, and the set itself (bytes) where it is wanted, once per task."""

    def run(batches):
        import pyarrow as pa

        from tabwarden.llm.fingerprints import shingle_sets, text_buffers

        given: set[str] = set()
        for batch in slices(batches, 1 << 20):
            sets = shingle_sets(*text_buffers(batch.column("text")), rule.width)
            wanted = batch.column("wanted").to_pylist()
            nodes = batch.column("node").to_pylist()
            out = []
            for own, want, node in zip(sets, wanted, nodes, strict=True):
                give = want and node not in given
                out.append(own.tobytes() if give else None)
                if give:
                    given.add(node)
                    if len(given) > 200_000:
                        given.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "class", "node")]
                + [pa.array([len(s) for s in sets], pa.int64()), pa.array(out, pa.binary())],
                ["doc_id", "class", "node", "n_shingles", "shingles"],
            )

    return run


class Region:
    """Sets of one region, for exact distances from one of them to many."""

    def __init__(self, nodes: list[str], sets: list):
        import numpy as np

        self.nodes, self.sets = nodes, sets
        self.sizes = np.array([len(s) for s in sets])

    def common(self, one: int, others):
        """Shingles that ``one`` has in common with each of ``others``."""
        import numpy as np

        flat = np.concatenate([self.sets[i] for i in others])
        own = self.sets[one]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        return np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(self.sizes[others])[:-1])))

    def compare(self, one: int, others, percent: int):
        """(distance, linked) to each of ``others``."""
        both = self.common(one, others)
        union = self.sizes[one] + self.sizes[others] - both
        return 1 - both / union, 100 * both >= percent * union


def region_links(nodes: list[str], sets: list, rule: JaccardRule):
    """Links that connect every two members of a region that a chain of links connects.

    Recursive pivots: the first member is the pivot of the rest; who links to it is its core.
    The others meet the core only inside the triangle window, and one another with a pivot of
    their own. One link from a member to a core is enough, as a core hangs together.
    """
    import numpy as np

    region = Region(nodes, sets)
    slack = rule.radius + 1e-9
    # (members still to be joined, their distance to the last pivot); the window to a new pivot
    # uses the last distances
    pending = np.arange(len(nodes))
    last = None
    to_last = np.zeros(len(nodes))
    while len(pending) > 1:
        pivot, others = int(pending[0]), pending[1:]
        near = np.ones(len(others), bool) if last is None else np.abs(last[1:] - last[0]) <= slack
        sizes = region.sizes[others]
        near &= (100 * np.minimum(sizes, region.sizes[pivot])) >= rule.percent * np.maximum(sizes, region.sizes[pivot])
        # The first pivot's distances are needed for all: they make the windows.
        asked = np.ones(len(others), bool) if last is None else near
        distance = np.full(len(others), np.inf)
        linked = np.zeros(len(others), bool)
        if asked.any():
            distance[asked], linked[asked] = region.compare(pivot, others[asked], rule.percent)
        core = others[linked]
        yield from ((nodes[pivot], nodes[i]) for i in core)
        rest = others[~linked]
        if len(core) and len(rest):
            core_distance = distance[linked]
            rest_distance = distance[~linked]
            edge = np.isinf(rest_distance) | (rest_distance <= core_distance.max() + slack)
            for i, d in zip(rest[edge], rest_distance[edge], strict=True):
                window = core if np.isinf(d) else core[core_distance >= d - slack]
                if last is not None:
                    window = window[np.abs(to_last[window] - to_last[i]) <= slack]
                window = window[
                    100 * np.minimum(region.sizes[window], region.sizes[i])
                    >= rule.percent * np.maximum(region.sizes[window], region.sizes[i])
                ]
                for at in range(0, len(window), 64):
                    some = window[at : at + 64]
                    _, hit = region.compare(int(i), some, rule.percent)
                    if hit.any():
                        yield nodes[int(i)], nodes[int(some[np.argmax(hit)])]
                        break
        if last is None:
            to_last[others] = distance
        last = to_last[rest]
        pending = rest


def _join_regions(rule: JaccardRule, star_only: bool):
    """Sorted (pivot, part, many, first, node, shingles) rows -> links (a, b). Of regions dealt
    over parts only the distances to the pivot are taken: links, and the others with theirs."""

    def regions(batches):
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("pivot", "part", "many", "first", "node", "shingles")]
            for pivot, part, many, first, node, shingles in zip(*columns, strict=True):
                if (pivot, part) != key:
                    if rows:
                        yield key, rows
                    key, rows = (pivot, part), []
                rows.append((many, first, node, shingles))
        if rows:
            yield key, rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["a", "b", "pivot", "distance"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64()]
        out: list[tuple] = []

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for (pivot, _), rows in regions(batches):
            unique = {}
            for many, first, node, shingles in rows:
                unique.setdefault(node, (many, first, np.frombuffer(shingles, np.int64)))
            nodes, sets = list(unique), [v[2] for v in unique.values()]
            many = rows[0][0]
            if len(nodes) > 1 and many and star_only:
                region = Region(nodes, sets)
                distance, linked = region.compare(0, np.arange(1, len(nodes)), rule.percent)
                for node, d, hit in zip(nodes[1:], distance.tolist(), linked.tolist(), strict=True):
                    out.append((nodes[0], node, None if hit else pivot, d))
                    if hit:
                        out.append((nodes[0], node, pivot, -d - 1))
            elif len(nodes) > 1:
                out.extend((a, b, None, None) for a, b in region_links(nodes, sets, rule))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return run


_LINKS = "a string, b string, pivot long, distance double"


def _tokens(batches):
    """(pivot, node, core, shingles) -> (pivot, node, core, n, token): all shingles of each set."""
    import numpy as np
    import pyarrow as pa

    for batch in slices(batches, 1 << 20, "shingles"):
        sets = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
        counts = np.array([len(s) for s in sets], np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), counts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in ("pivot", "node", "core")]
            + [pa.array(np.repeat(counts, counts)), pa.array(np.concatenate(sets))],
            ["pivot", "node", "core", "n", "token"],
        )


def _dealt_again(left: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """``pivot, part, node``: parts of about ``members`` at most, in which every two members of a
    region (``pivot, node, core`` rows) meet that could link and are not both in its core.

    Here each member shows all its shingles and rarity is counted inside the region, so members
    that share a passage and little else no longer meet. A set may be in ``sets`` more than once:
    that changes counts of a shingle, but for all its members alike.
    """
    tokens = sets.select("node", "shingles").join(counted_broadcast(left), "node").select("pivot", "node", "core", "shingles")
    tokens = persisted_copy(tokens.mapInArrow(_tokens, "pivot long, node string, core boolean, n long, token long"), "left-tokens")
    ends = (F.min("node").alias("low"), F.max("node").alias("high"))
    shared = tokens.groupBy("pivot", "token").agg(F.count("*").alias("spread"), *ends).where("low != high")
    rarest = tokens.join(shared.select("pivot", "token", "spread"), ["pivot", "token"]).groupBy("pivot", "node", "core", "n").agg(
        F.sort_array(F.collect_set(F.struct("spread", "token"))).alias("met")
    )
    needed = F.floor(F.col("n") * (100 - rule.percent) / 100).cast("int") + 1
    rest = (needed - (F.col("n") - F.size("met"))).cast("int")
    met = persisted_copy(
        rarest.withColumn("rest", rest).where("rest > 0")
        .select("pivot", "node", "core", F.explode(F.slice("met", 1, F.col("rest"))).alias("m"))
        .select("pivot", "node", "core", F.col("m.token").alias("token")),
        "left-met",
    )
    lows = met.groupBy("pivot", "token").agg(*ends).where("low != high").select("pivot", "token", "low")
    regions = persisted_copy(
        met.join(lows, ["pivot", "token"]).select(F.xxhash64("pivot", "low").alias("pivot"), "node", "core").distinct(), "left-regions"
    )
    # Blocks of half a part: first those of members outside the core, then those of the core.
    blocks = lambda core: F.ceil(2 * F.count_if(F.col("core") == core) / rule.members)
    sized = regions.groupBy("pivot").agg(F.count("*").alias("size"), blocks(False).alias("own"), blocks(True).alias("cores")).where("own > 0")
    block = F.when(F.col("core"), F.col("own") + F.pmod(F.xxhash64("node"), F.col("cores"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("own"))
    )
    blocked = regions.join(sized, "pivot").withColumn("total", F.col("own") + F.col("cores")).withColumn("block", block)
    with_all = F.sequence(F.lit(0).cast("long"), F.when(F.col("core"), F.col("own")).otherwise(F.col("total")) - 1)
    pairs = F.transform(
        F.array_except(with_all, F.array("block")),
        lambda other: F.least(other, F.col("block")) * F.col("total") + F.greatest(other, F.col("block")),
    )
    whole = F.col("size") <= rule.members
    return blocked.select("pivot", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"), "node")


def _links(regions: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """``a, b``: links between classes, from the regions and the sets of their members."""
    size = F.count("*").over(Window.partitionBy("pivot"))
    sized = regions.withColumn("parts", F.ceil(size / rule.members).cast("int"))
    own_part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    dealt = sized.select(
        "pivot",
        "class",
        (F.col("class") == F.col("pivot")).alias("first"),
        (F.col("parts") > 1).alias("many"),
        F.explode(
            F.when(F.col("class") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own_part))
        ).alias("part"),
    )
    order = ["pivot", "part", F.desc("first"), "node"]
    # Within the bound the sets move once, to their regions; beyond it once more, by class.
    dealt = counted_broadcast(persisted_copy(dealt, "dealt"))
    rows = sets.join(dealt, "class").select("pivot", "part", "many", "first", "node", "shingles")
    found = persisted_copy(
        rows.repartition("pivot", "part").sortWithinPartitions(*order).mapInArrow(_join_regions(rule, True), _LINKS), "links"
    )
    links = found.where("distance IS NULL OR pivot IS NULL").select("a", "b")
    # What large regions left over: members outside the core, and the core inside their window.
    outside = found.where("pivot IS NOT NULL AND distance >= 0").select("pivot", F.col("b").alias("node"), "distance")
    if outside.isEmpty():
        return links
    inner = outside.groupBy("pivot").agg(F.min("distance").alias("least"))
    core = (
        found.where("pivot IS NOT NULL AND distance < 0")
        .select("pivot", F.col("b").alias("node"), (-F.col("distance") - 1).alias("distance"))
        .join(inner, "pivot")
        .where(F.col("distance") >= F.col("least") - rule.radius - 1e-9)
        .select("pivot", "node")
    )
    left = outside.select("pivot", "node", F.lit(False).alias("core")).unionByName(core.withColumn("core", F.lit(True)))
    again = _dealt_again(persisted_copy(left.distinct(), "left"), sets, rule)
    again = counted_broadcast(persisted_copy(again, "dealt-again"))
    rows = sets.join(again, "node").select("pivot", "part", F.lit(False).alias("many"), F.lit(False).alias("first"), "node", "shingles")
    more = (
        rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "node").mapInArrow(_join_regions(rule, False), _LINKS)
    )
    return links.union(more.select("a", "b"))


def similar_documents(documents: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """One row per document: ``doc_id, node, n_shingles, component_id``.

    ``node`` is the class of equal texts. ``component_id`` is the least doc_id that links reach.
    Null texts and texts without words have no shingles and link with nothing: their
    ``component_id`` is their doc_id. Rows that repeat a doc_id, equal or not, stay rows of
    their own; a null doc_id is in its component without naming it. Columns other than ``doc_id,
    text`` are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    classed = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("class"))
    regions = persisted_copy(contacts(classed, rule), "regions")
    wanted = regions.select("class").distinct().withColumn("wanted", F.lit(True))
    # Beyond what may be broadcast the texts are shuffled by class.
    rows = classed.withColumn("node", F.md5("text")).join(counted_broadcast(wanted), "class", "left")
    sized = persisted_copy(
        rows.mapInArrow(_sets(rule), "doc_id long, class long, node string, n_shingles long, shingles binary"), "shingles"
    )
    sets = sized.where("shingles IS NOT NULL").select("class", "node", "shingles")
    roots = component_roots(_links(regions, sets, rule))
    placed = sized.select("doc_id", "node", "n_shingles").join(
        roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left"
    )
    placed = persisted_copy(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    least = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies"))
    # A component may hold a third of all documents.
    named = spread_join(placed, persisted_copy(least, "components"), ["root"], "copies", "left", hot_rows=1000)
    return named.select(
        "doc_id",
        "node",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(documents: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """The documents with one of each component left: the one with the least doc_id (a null id is
    the largest), among equals the least by text digest, and one of rows equal in both.

    Documents without words stay. All columns stay. Everything is decided on ids and digests; then a row
    stays where it is unless a bitmap of the dropped and the repeated ones hits it. Only rows that are hit are
    shuffled with their text, once.
    """
    found = persisted_copy(similar_documents(documents, rule), "similar")
    row = ["unknown", "id", "node"]
    found = found.where("n_shingles > 0").select(
        F.col("doc_id").isNull().alias("unknown"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        "node",
        F.coalesce("component_id", F.lit(-1)).alias("component"),
        F.when(F.col("component_id").isNull(), F.col("node")).alias("own"),
    )
    rows = found.groupBy(*row, "component", "own").agg(F.count("*").alias("n"))
    keepers = rows.groupBy("component", "own").agg(F.min(F.struct(*row)).alias("least")).select("least.*", F.lit(True).alias("stays"))
    special = rows.join(keepers, row, "left").where("stays IS NULL OR n > 1").select(*row, F.col("stays").isNull().alias("gone"))
    special = persisted_copy(special, "special")
    bitmap = key_bitmap(special, *row)
    text = F.coalesce("text", F.lit(""))
    own = [f"__{c}" for c in row]
    marked = documents.withColumns(
        {"__unknown": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__node": F.md5(text)}
    )
    marked = with_hits(marked, bitmap, *own).withColumn("__hit", F.col("__hit") & text.rlike(f"[^{SPACE}]"))
    in_place = marked.where("NOT __hit")
    gone = special.where("gone").select(*(F.col(c).alias(f"__{c}") for c in row))
    others = marked.where("__hit").dropDuplicates(own).join(gone, own, "left_anti")
    return in_place.unionByName(others).select(*documents.columns)
