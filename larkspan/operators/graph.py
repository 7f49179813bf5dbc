"""Graph operators on two tables: nodes `(id, ...)` and edges `(source, target, ...)`.

Iterative operators cut their lineage with reliable checkpoints in the shared folder. Every step is an
equi join or an aggregate with map-side partial results, so a hub node does not gather its edges in
one task: its edges are reduced before the shuffle, and the join that meets them again has one row per
node on the other side, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.session import cut_lineage

NODE = T.StructType([T.StructField(n, T.StringType()) for n in "id label file_type source_file source_location".split()])
EDGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in "source target relation confidence source_file".split()]
    + [T.StructField("weight", T.DoubleType())]
)
CALL = T.StructType([T.StructField(n, T.StringType()) for n in "caller_nid callee source_file".split()])
GRAPH = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("edges", T.ArrayType(EDGE)),
        T.StructField("raw_calls", T.ArrayType(CALL)),
    ]
)


def parse_graph(df: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, calls) of graph documents; a node id that occurs in several documents is kept once."""
    g = df.select(F.from_json(document, GRAPH).alias("g"))
    nodes = g.select(F.inline("g.nodes")).groupBy("id").agg(F.min(F.struct("label", "file_type", "source_file", "source_location")).alias("n"))
    return nodes.select("id", "n.*"), g.select(F.inline("g.edges")), g.select(F.inline("g.raw_calls"))


def read_graph(spark, path: str):
    """`parse_graph` over a folder of JSON files."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return parse_graph(docs, "value")


def link_edges(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One edge per link of a page."""
    links = F.regexp_extract_all(F.col(html), F.lit('href="([^"]+)"'), F.lit(1))
    return pages.select(F.col(key).alias("source"), F.explode(links).alias("target"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours, listed from both ends, without self loops."""
    e = edges.select("source", "target").filter("source <> target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Edges incident to each node; a self loop counts at both ends."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    """Nodes with at most `most` edges, also those without any."""
    d = nodes.select("id").join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return d.filter(F.col("degree") <= most)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node id that can be reached. Alternates the two star steps to a fixpoint.

    Each step links neighbours to their smallest neighbour; the number of rounds grows with the logarithm
    of the graph, not with its diameter.
    """
    pairs = cut_lineage(
        edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).filter("u <> v").distinct()
    )
    mark, now = None, ()
    while now != mark:
        mark = now
        pairs = cut_lineage(_small_star(_large_star(pairs)))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    found = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    near = pairs.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
        pairs.select(F.col("v").alias("n"), F.col("u").alias("w"))
    )
    low = near.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
    return (
        near.filter("w > n").join(low, "n").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    linked = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter("u <> v").distinct()


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, community): label propagation for a fixed number of rounds, all nodes at once.

    A node takes the most frequent label of its neighbours, the smallest one on ties.
    """
    near = cut_lineage(both_ways(edges))
    labels = nodes.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        seen = near.join(labels, near["target"] == labels["id"]).select(F.col("source").alias("id"), "community")
        votes = seen.groupBy("id", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("_next"))
        labels = labels.join(best, "id", "left").select("id", F.coalesce("_next", "community").alias("community"))
        labels = cut_lineage(labels)
    return labels


def community_sizes(members: DataFrame, least: int = 3) -> DataFrame:
    """Community sizes; those below `least` are thin."""
    return members.groupBy("community").agg(F.count("*").alias("n")).withColumn("thin", F.col("n") < least)


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct internal edges over possible pairs, per community with at least two nodes."""
    e = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct()
    a = members.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = e.join(a, "a").join(b, "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inside"))
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).filter("n >= 2")
    return sizes.join(inside, "community", "left").select(
        "community", "n", F.coalesce("inside", F.lit(0).cast("long")).alias("inside"),
        (F.coalesce("inside", F.lit(0)) * 2.0 / (F.col("n") * (F.col("n") - 1))).alias("cohesion"),
    )


def crossing_edges(edges: DataFrame, members: DataFrame, wanted: Column) -> DataFrame:
    """Wanted edges whose ends lie in different communities."""
    a = members.select(F.col("id").alias("source"), F.col("community").alias("from_community"))
    b = members.select(F.col("id").alias("target"), F.col("community").alias("to_community"))
    return edges.filter(wanted).join(a, "source").join(b, "target").filter("from_community <> to_community")


def bridge_scores(edges: DataFrame, nodes: DataFrame, most: int = 20_000_000) -> DataFrame:
    """(id, score) of every node: exact betweenness over ordered pairs.

    Shortest paths leave a biconnected block only through a cut node, so paths are walked inside blocks: a node of a block
    stands for all nodes that hang from it outside the block (its weight), and pairs that a cut node parts are counted
    from the sizes of the parts. A node of degree one, or a tree, needs no walk. Nodes with the same neighbours have the
    same score; two of them go on, which keeps the blocks as they are. Rows of the walks are bounded by the squares of
    the classes of each block; starts are taken in rounds of about `most` such rows.

    Self loops and repeated edges change nothing; nodes without edges score 0, null ends of edges take no part.
    """
    near, members = _two_of_a_kind(both_ways(edges.filter("source is not null and target is not null")))
    tree = _with_blocks(near, _spanning_forest(near, members))
    hung = _hung(tree, members)
    cut = _parted_pairs(hung)
    total = cut.unionByName(_walked(near, hung, most))
    scores = members.join(total.groupBy("id").agg(F.sum("score").alias("score")), F.col("first") == total["id"])
    scores = scores.select(members["id"], "score")
    return nodes.select("id").distinct().join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _kinds(near: DataFrame, keys: list[str]) -> list[Column]:
    """What tells sets of neighbours apart: their number and two sums of hashes."""
    return [F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(k), *keys).cast("decimal(38,0)")).alias(f"m{k}") for k in (0, 1)]]


def _two_of_a_kind(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours among the first two nodes of each set of equal neighbours, and all members.

    Members are (id, first, second, many, lone): the nodes kept of their kind, the number of the kind, whether they have
    one neighbour. The first stands for itself, the second for all others.
    """
    near = cut_lineage(near)
    marked = cut_lineage(near.groupBy(F.col("source").alias("id")).agg(*_kinds(near, ["target"])))
    keys = ["n", "m0", "m1"]
    kinds = marked.groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("many"))
    named = marked.join(kinds, keys).select("id", "first", "many", (F.col("n") == 1).alias("lone"))
    seconds = named.filter("id <> first").groupBy("first").agg(F.min("id").alias("second"))
    members = cut_lineage(named.join(seconds, "first", "left").select("id", "first", "second", "many", "lone"))
    kept = members.filter("id = first or id = second").select("id")
    ends = near.join(kept.withColumnRenamed("id", "source"), "source", "left_semi")
    return cut_lineage(ends.join(kept.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")), members


def _spanning_forest(near: DataFrame, members: DataFrame) -> list[DataFrame]:
    """Levels of (id, parent, root, many, lone), breadth first from the smallest node of each component.

    A neighbour lies at most one level off, so only two levels are looked at to know what is new.
    """
    kept = members.filter("id = first or id = second").select(
        "id", F.when(F.col("id") == F.col("first"), F.lit(1)).otherwise(F.col("many") - 1).cast("long").alias("many"), "lone"
    )
    roots = components(kept.select("id"), near).filter("id = component").select("id")
    ends = near.join(kept, near["target"] == kept["id"]).select("source", "target", "many", "lone")
    level = cut_lineage(kept.join(roots, "id").select("id", F.lit(None).cast("string").alias("parent"), F.col("id").alias("root"), "many", "lone"))
    levels = [level]
    while True:
        here = level.select(F.col("id").alias("source"), "root")
        met = ends.join(here, "source").join(level.select(F.col("id").alias("target")), "target", "left_anti")
        if len(levels) > 1:
            met = met.join(levels[-2].select(F.col("id").alias("target")), "target", "left_anti")
        level = cut_lineage(met.groupBy(F.col("target").alias("id")).agg(*[F.min(c).alias(n) for c, n in (("source", "parent"), ("root", "root"), ("many", "many"), ("lone", "lone"))]))
        if level.isEmpty():
            return levels
        levels.append(level)


def _with_blocks(near: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """The levels with the block of the edge from each node to its parent; roots have none.

    An edge beside the tree closes a cycle: both ends climb to where they meet, and the tree edges on the way are in one
    block. Pairs of one level climb together and repeated ones are merged; what they unite are links between tree edges
    (named by their lower ends), whose components are the blocks.
    """
    depth = None
    for k, level in enumerate(levels):
        part = level.select("id", "parent", F.lit(k).alias("depth"))
        depth = part if depth is None else depth.unionByName(part)
    depth = cut_lineage(depth)
    a = depth.select(F.col("id").alias("source"), F.col("depth").alias("d1"))
    b = depth.select(F.col("id").alias("target"), F.col("depth").alias("d2"), "parent")
    # each edge beside the tree once, its lower end as the target
    beside = near.join(a, "source").join(b, "target").filter("parent <> source and (d2 > d1 or (d2 = d1 and target > source))")
    beside = cut_lineage(beside.select("source", "target", "d1", "d2", "parent"))
    skew = beside.filter("d2 > d1")
    links = [skew.select(F.col("target").alias("source"), F.col("parent").alias("target"))]
    # the lower end of a slanting edge climbs first, so that all pairs lie in one level
    flat = skew.select(F.least("source", "parent").alias("a"), F.greatest("source", "parent").alias("b"), F.col("d1").alias("d"))
    flat = flat.unionByName(beside.filter("d2 = d1").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("d1").alias("d")))
    flat = cut_lineage(flat.distinct())
    pairs = flat.filter("false").select("a", "b")
    for k in range(len(levels) - 1, 0, -1):
        pairs = pairs.unionByName(flat.filter(F.col("d") == k).select("a", "b")).distinct()
        up = levels[k].select("id", "parent")
        climbed = pairs.join(up.select(F.col("id").alias("a"), F.col("parent").alias("pa")), "a")
        climbed = cut_lineage(climbed.join(up.select(F.col("id").alias("b"), F.col("parent").alias("pb")), "b"))
        links.append(climbed.select(F.col("a").alias("source"), F.col("b").alias("target")))
        apart = climbed.filter("pa <> pb")
        links += [apart.select(F.col("a").alias("source"), F.col("pa").alias("target")), apart.select(F.col("b").alias("source"), F.col("pb").alias("target"))]
        pairs = apart.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
    linked = links[0]
    for more in links[1:]:
        linked = linked.unionByName(more)
    below = depth.filter("depth > 0").select("id")
    block = cut_lineage(components(below, linked).select("id", F.col("component").alias("block")))
    return [level.join(block, "id", "left") for level in levels]


def _hung(levels: list[DataFrame], members: DataFrame) -> DataFrame:
    """(block, id, head, part, many, lone, weight, all) of each node in each of its blocks.

    `part` is the number of nodes on the block's side of the node, `weight` that of all others, itself included, and
    `all` that of the component. Sizes are summed from the deepest level up.
    """
    rows, below = None, None
    for level in reversed(levels):
        here = level.withColumn("inside", F.lit(0).cast("long")).withColumn("size", F.col("many"))
        if below is not None:
            sums = [F.sum("size").alias("part"), F.min("many").alias("leaves"), F.min("lone").alias("leaf")]
            heads = below.groupBy(F.col("parent").alias("id"), "block").agg(*sums)
            own = level.select("id", "root", F.col("block").alias("own"))
            head = heads.join(own, "id").filter("own is null or block <> own")
            rows_here = head.select("block", "id", F.lit(True).alias("head"), "root", "part", F.lit(1).cast("long").alias("many"), "leaves", "leaf")
            rows = rows_here if rows is None else rows.unionByName(rows_here)
            total = heads.groupBy("id").agg(F.sum("part").alias("under"))
            inside = heads.join(own, "id").filter("block = own").select("id", F.col("part").alias("in_own"))
            here = level.join(total, "id", "left").join(inside, "id", "left")
            here = here.withColumn("inside", F.coalesce("in_own", F.lit(0).cast("long"))).withColumn("size", F.col("many") + F.coalesce("under", F.lit(0).cast("long")))
        here = cut_lineage(here.select("id", "parent", "root", "many", "lone", "block", "inside", "size"))
        # the nodes beside the block: itself and what hangs from it by other blocks
        low = here.filter("block is not null").select(
            "block", "id", F.lit(False).alias("head"), "root", (F.col("size") - F.col("many") + 1 - F.col("inside")).alias("part"), "many",
            F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("boolean").alias("leaf"),
        )
        rows = low if rows is None else rows.unionByName(low)
        below = here
    sizes = below.select("root", F.col("size").alias("all"))
    found = cut_lineage(rows).join(sizes, "root")
    weight = F.when(F.col("head"), F.col("all") - F.col("part")).otherwise(F.col("part"))
    return cut_lineage(found.withColumn("weight", weight).withColumn("part", F.col("all") - F.col("weight")).select("block", "id", "head", "part", "many", "leaves", "leaf", "weight", "all"))


def _parted_pairs(hung: DataFrame) -> DataFrame:
    """(id, score): ordered pairs of nodes that lie in different blocks of a node. Leaves are parts of one node each."""
    part = F.col("part").cast("double")
    square = F.when(F.coalesce("leaf", F.lit(False)), F.col("leaves").cast("double")).otherwise(part * part)
    found = hung.groupBy("id").agg(F.sum(square).alias("same"), F.max("all").cast("double").alias("all"))
    return found.select("id", ((F.col("all") - 1) * (F.col("all") - 1) - F.col("same")).alias("score"))


def _walked(near: DataFrame, hung: DataFrame, most: int) -> DataFrame:
    """(id, score) of the paths inside blocks of three nodes and more, each end counted with its weight.

    Nodes of a block with the same neighbours there are one class, walked once: `size` is their number, `weight` the sum
    of their weights. The others of a start's class are met two levels on; no path goes on from there.
    """
    big = hung.groupBy("block").agg(F.count("*").alias("n")).filter("n > 2").select("block")
    rows = cut_lineage(hung.join(big, "block", "left_semi").select("block", "id", "many", F.col("weight").cast("double").alias("weight")))
    a = rows.select("block", F.col("id").alias("source"))
    b = rows.select("block", F.col("id").alias("target"))
    # two nodes share one block at most, so an edge comes with its block alone
    inner = cut_lineage(near.join(a, "source").join(b, ["block", "target"]))
    kinds = inner.groupBy("block", F.col("source").alias("id")).agg(*_kinds(inner, ["target"]))
    keys = ["block", "n", "m0", "m1"]
    marked = cut_lineage(kinds.join(rows, ["block", "id"]))
    found = marked.groupBy(*keys).agg(
        F.min("id").alias("first"), F.sum("many").cast("double").alias("size"),
        F.sum(F.col("many") * F.col("weight")).alias("weight"), F.sum(F.col("many") * F.col("weight") * F.col("weight")).alias("squares"),
    ).withColumn("class", F.struct("block", "first"))
    classes = cut_lineage(found)
    names = cut_lineage(marked.join(classes.select(*keys, "class"), keys).select("block", "id", "class"))
    sizes = classes.select(F.col("class").alias("target"), "size", "weight")
    firsts = classes.select("block", F.col("first").alias("source"), F.col("class"))
    ends = names.select("block", F.col("id").alias("target"), F.col("class").alias("to"))
    links = inner.join(firsts, ["block", "source"]).join(ends, ["block", "target"]).select(F.col("class").alias("source"), F.col("to").alias("target")).distinct()
    links = cut_lineage(links.join(sizes, "target").select("source", "target", "size", "weight"))
    pairs = classes.groupBy("block").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    rounds = max(1, -(-pairs // most))
    total = None
    starts = classes.select(F.col("class").alias("start"), F.col("size").alias("starts"), F.col("weight").alias("start_weight"), "squares")
    for k in range(rounds):
        some = starts.filter(F.pmod(F.xxhash64("start"), F.lit(rounds)) == k)
        part = cut_lineage(_dependencies(links, some).groupBy("id").agg(F.sum("delta").alias("score")))
        total = part if total is None else total.unionByName(part)
    return names.join(total.withColumnRenamed("id", "class"), "class").select("id", "score")


def _dependencies(near: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, delta): how much each class depends on the starts, times the start's weight.

    Breadth-first frames count shortest paths level by level; dependencies then flow back along the levels. Each frame
    has at most one row per (start, class), and what is new is told from the last two frames.
    """
    level = cut_lineage(starts.select("start", F.col("start").alias("id"), F.lit(1.0).alias("paths"), F.lit(1.0).alias("size"), F.lit(0.0).alias("weight"), (F.col("starts") == 1).alias("closed")))
    levels = [level]
    own = F.col("start") == F.col("target")
    begun = starts.select("start", "starts", "start_weight", "squares")
    while True:
        step = level.select("start", "id", (F.col("paths") * F.col("size")).alias("paths")).join(near, level["id"] == near["source"])
        summed = step.groupBy("start", "target").agg(F.sum("paths").alias("paths"), F.first("size").alias("size"), F.first("weight").alias("weight"))
        seen = level.filter("closed").select("start", F.col("id").alias("target"))
        if len(levels) > 1:
            seen = seen.unionByName(levels[-2].filter("closed").select("start", F.col("id").alias("target")))
        fresh = summed.join(seen, ["start", "target"], "left_anti")
        if len(levels) == 2:
            fresh = fresh.join(begun, "start")
            fresh = fresh.withColumn("size", F.when(own, F.col("starts") - 1).otherwise(F.col("size"))).withColumn(
                "weight", F.when(own, F.col("start_weight") - F.col("squares") / F.col("start_weight")).otherwise(F.col("weight"))
            )
        level = cut_lineage(fresh.select("start", F.col("target").alias("id"), "paths", "size", "weight", F.lit(True).alias("closed")))
        if level.isEmpty():
            break
        levels.append(level)
    total, below = None, None
    for i in range(len(levels) - 1, 0, -1):
        here = levels[i]
        if below is None:
            here = here.withColumn("delta", F.lit(0.0))
        else:
            here = here.join(below, ["start", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = cut_lineage(here)
        total = here if total is None else total.unionByName(here)
        above = levels[i - 1].select("start", F.col("id").alias("up"), F.col("paths").alias("up_paths"))
        back = here.join(near.select("source", F.col("target").alias("up")), here["id"] == F.col("source"))
        flow = back.select("start", "paths", "delta", "size", "weight", "up").join(above, ["start", "up"])
        share = F.col("up_paths") / F.col("paths") * (F.col("weight") + F.col("size") * F.col("delta"))
        below = flow.groupBy("start", F.col("up").alias("id")).agg(F.sum(share).alias("delta"))
    if total is None:
        return level.select("start", "id", F.lit(0.0).alias("delta"))
    return total.join(starts.select("start", "start_weight"), "start").select("start", "id", (F.col("delta") * F.col("start_weight")).alias("delta"))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Directed cycles of up to `longest` nodes, self loops included, each once: it starts at its smallest node."""
    e = cut_lineage(edges.select("source", "target").distinct())
    step = e.select(F.col("source").alias("_last"), F.col("target").alias("_next"))
    paths = e.filter("target >= source").select(F.array("source").alias("path"), F.col("target").alias("_next"))
    done = None
    for length in range(1, longest + 1):
        closed = paths.filter(F.col("_next") == F.col("path")[0]).select("path")
        done = closed if done is None else done.unionByName(closed)
        if length == longest:
            break
        grown = paths.filter((F.col("_next") > F.col("path")[0]) & ~F.array_contains("path", F.col("_next"))).select(
            F.concat("path", F.array("_next")).alias("path"), F.col("_next").alias("_last")
        )
        paths = grown.join(step, "_last").select("path", "_next").filter(F.col("_next") >= F.col("path")[0])
        if length % 3 == 0:
            paths = cut_lineage(paths)
    return done


def audit_list(edges: DataFrame, wanted: Column, examples: int = 2) -> DataFrame:
    """Per node the number of wanted edges and the first examples. Only the examples are gathered."""
    e = edges.filter(wanted)
    ends = e.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(
        e.select(F.col("target").alias("id"), F.col("source").alias("other"))
    )
    counts = ends.groupBy("id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other"))
    first = ends.distinct().withColumn("_r", rank).filter(F.col("_r") <= examples)
    shown = first.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("examples"))
    return counts.join(shown, "id")


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls joined to the nodes of their label; a label that several nodes share is ambiguous."""
    labels = nodes.groupBy("label").agg(F.count("*").alias("_n"), F.min("id").alias("target"))
    return calls.join(labels, F.col("callee") == F.col("label"), "left").select(
        F.col("caller").alias("source"), "callee", "target",
        F.when(F.col("_n").isNull(), "UNRESOLVED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("INFERRED").alias("confidence"),
    )
