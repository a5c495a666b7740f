"""Taxonomy and lineage operators: tours, roll-ups, lowest common ancestors.

``nodes``: id, depth, parent, rank, name; the root is its own parent. Lineages are arrays of names, broad to specific.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded_hash
from .lineage import cut, dropped, with_position

ROOT, CELLULAR = 1, 131567


def tour(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """``id, parent, depth, entry, exit, path``: the tree in the order of a walk from the root, every node before those
    below it (J11). ``path`` leads from the root to the node.

    A node lies below another if its entry lies in that one's ``entry .. exit``, and what several nodes share is what the
    one of the smallest and the one of the largest entry share. Paths grow fourfold in each round, so depth d takes log4(d)
    tables; entries are positions in the order of the paths, counted by ranges and moved by what stands before. The result is
    a table that depends on the taxonomy alone: make it once, hand it to every operator below. A cycle, or a depth over ``max_depth``, raises. A
    parent that the table lacks makes its child a root.
    """
    up = nodes.select("id", "parent").where("id <> parent").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    paths, growing = _watched(nodes.select("id").join(up, "id", "left").select("id", F.col("parent").alias("far"), F.array("id").alias("path")))
    for _ in range(max_depth.bit_length() // 2 + 1):
        if not growing:
            break
        grown, growing = _watched(_doubled(_doubled(paths)))
        dropped(paths)
        paths = grown
    if growing:
        raise ValueError(f"paths are still growing at a depth of more than {max_depth}; the table may have a cycle")
    placed = with_position(paths.select("id", "path"), ["path"], "entry")
    below = paths.select(F.explode("path").alias("id")).groupBy("id").agg(F.count("*").alias("_size"))
    toured = placed.join(below, "id").join(nodes.select("id", "parent", "depth"), "id").select("id", "parent", "depth", "entry", (F.col("entry") + F.col("_size") - 1).alias("exit"), "path")
    whole = cut(toured)
    dropped(paths)
    return whole


def _watched(paths: DataFrame) -> tuple[DataFrame, int]:
    """The paths as a table, and how many of them still grow, counted from the table. An ``Observation`` would stay in the
    session, which could then not send Spark's two-class models to the tasks any more: their summary holds the session."""
    table = cut(paths)
    return table, table.where("far is not null").count()


def _doubled(paths: DataFrame) -> DataFrame:
    """Each path with that of the node above its first one in front."""
    above = paths.select(F.col("id").alias("far"), F.col("far").alias("_far"), F.col("path").alias("_path"))
    return paths.join(above, "far", "left").select("id", F.col("_far").alias("far"), F.concat(F.coalesce("_path", F.array().cast(paths.schema["path"].dataType)), "path").alias("path"))


def closure(toured: DataFrame) -> DataFrame:
    """``id, ancestor, depth``: every node of a tour with itself and all its ancestors (J11); depth is the ancestor's."""
    pairs = toured.select("id", F.explode("path").alias("ancestor"))
    return pairs.join(toured.select(F.col("id").alias("ancestor"), "depth"), "ancestor").select("id", "ancestor", "depth")


def to_taxa(hits: DataFrame, accessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Taxon of each accession, missing ones 0; and the accessions missing (J10). ``accessions``: accession, taxon."""
    out = hits.join(accessions, "accession", "left").withColumn("taxon", F.coalesce("taxon", F.lit(0)))
    return out, hits.select("accession").distinct().join(accessions, "accession", "left_anti")


def known_or_root(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Taxa that the table does not have count as root."""
    own = nodes.select(F.col("id").alias("taxon"), F.lit(True).alias("_known"))
    return hits.join(own, "taxon", "left").withColumn("taxon", F.when(F.col("_known") | (F.col("taxon") == 0), F.col("taxon")).otherwise(F.lit(ROOT))).drop("_known")


def with_magnitudes(queries: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """Magnitude of each query, 1 where none is given (J12). ``magnitudes``: id, magnitude."""
    return queries.join(magnitudes, "id", "left").withColumn("magnitude", F.coalesce("magnitude", F.lit(1.0)))


def taxon_contains(pairs: DataFrame, toured: DataFrame) -> DataFrame:
    """Pairs ``parent, child`` whose parent is the child or above it (A25): the child's entry lies in the parent's interval."""
    above = toured.select(F.col("id").alias("parent"), F.col("entry").alias("_from"), F.col("exit").alias("_to"))
    own = toured.select(F.col("id").alias("child"), F.col("entry").alias("_at"))
    return pairs.join(own, "child").join(above, "parent").where("_at between _from and _to").select(*pairs.columns)


def _prefixes(path: str = "path"):
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, F.lit(1), i))


def roll_up(lineages: DataFrame, max_depth: int | None = None, min_score: float | None = None) -> DataFrame:
    """``path, magnitude, count, unassigned, score``: sums over every prefix, the root being the empty path.

    ``lineages``: path, magnitude and perhaps score. ``unassigned`` is what ends at a node. Deeper levels are cut off at
    ``max_depth``; rows below ``min_score`` are left out. ``score`` is the mean weighted by magnitude.
    """
    rows = lineages if "score" in lineages.columns else lineages.withColumn("score", F.lit(None).cast("double"))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    if max_depth is not None:
        rows = rows.withColumn("path", F.slice("path", 1, max_depth))
    spread = rows.withColumn("full", F.size("path")).withColumn("node", F.explode(_prefixes()))
    m = F.col("magnitude")
    weight = F.sum(F.when(F.col("score").isNotNull(), m))
    return spread.groupBy(F.col("node").alias("path")).agg(
        F.sum(m).alias("magnitude"),
        F.count("*").alias("count"),
        F.sum(F.when(F.size("node") == F.col("full"), m).otherwise(0.0)).alias("unassigned"),
        F.try_divide(F.sum(F.col("score") * m), weight).alias("score"),
    )


def log_score(col, floor: float):
    """log10 of a score; what is not positive gets the floor."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c > 0, F.log10(c)).otherwise(F.lit(float(floor)))


def leaf_values(lineages: DataFrame) -> DataFrame:
    """``path, magnitude``: values set at leaves; a node without a value of its own is the sum of its children.

    Of several values of a path the one of the largest ``pos`` counts, or the largest where there is no such column.
    """
    own = lineages.groupBy("path").agg(F.max_by("magnitude", "pos" if "pos" in lineages.columns else "magnitude").alias("own"))
    nodes = lineages.select(F.explode(_prefixes()).alias("path")).distinct().join(own, "path", "left")
    depth = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    done = nodes.where(F.size("path") == depth).select("path", F.coalesce("own", F.lit(0.0)).alias("magnitude"))
    every = done
    for d in range(depth - 1, -1, -1):  # as many rounds as levels
        sums = done.groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.sum("magnitude").alias("below"))
        done = nodes.where(F.size("path") == d).join(sums, "path", "left").select("path", F.coalesce("own", "below", F.lit(0.0)).alias("magnitude"))
        every = every.unionByName(done)
    return every


def ec_roll_up(rows: DataFrame) -> DataFrame:
    """Roll-up of dotted numbers; empty ones go to ``No hits`` (A20). ``rows``: ec, magnitude."""
    path = F.when(F.coalesce("ec", F.lit("")) == "", F.array(F.lit("No hits"))).otherwise(F.split("ec", r"\."))
    return roll_up(rows.select(path.alias("path"), "magnitude"))


def collapsed(nodes: DataFrame, no_rank: bool = False, cellular: bool = False) -> DataFrame:
    """Nodes that melt into their parent (A21): ``no rank`` ones but the root, if asked for or cellular organisms."""
    melt = (F.col("rank") == "no rank") & (F.col("id") != ROOT) & (F.lit(no_rank) | (F.col("id") == CELLULAR)) & ~(F.lit(cellular) & (F.col("id") == CELLULAR))
    return nodes.where(melt)


def taxon_roll_up(hits: DataFrame, nodes: DataFrame, toured: DataFrame, max_depth: int | None = None, no_rank: bool = False, cellular: bool = False) -> DataFrame:
    """``taxon, magnitude, count, unassigned, score`` of every ancestor of a hit (A21). ``hits``: taxon, magnitude, score.

    Taxon 0 is ``No hits`` and stays alone; unknown taxa count as root; melted nodes count for their nearest ancestor that
    stays. The mean score leaves the root without one. Hits are summed by taxon before they meet ancestors, so what is
    carried up the tree has the size of the taxonomy.
    """
    m, score = F.col("magnitude"), F.col("score")
    own = known_or_root(hits, nodes).groupBy("taxon").agg(F.sum(m).alias("m"), F.count("*").alias("n"), F.sum(score * m).alias("scored"), F.sum(F.when(score.isNotNull(), m)).alias("weight"))
    melted = collapsed(nodes, no_rank, cellular).select(F.col("id").alias("ancestor"))
    stays = closure(toured).join(melted, "ancestor", "left_anti")
    if max_depth is not None:
        stays = stays.where(F.col("depth") <= max_depth)
    deepest = stays.groupBy("id").agg(F.max("depth").alias("last"))
    up = own.join(stays.join(deepest, "id").withColumnRenamed("id", "taxon"), "taxon", "left")
    node = F.coalesce("ancestor", F.lit(0))
    ends = F.col("ancestor").isNull() | (F.col("depth") == F.col("last"))
    return up.groupBy(node.alias("taxon")).agg(
        F.sum("m").alias("magnitude"), F.sum("n").alias("count"), F.sum(F.when(ends, F.col("m")).otherwise(0.0)).alias("unassigned"), F.try_divide(F.sum(F.when(node != ROOT, F.col("scored"))), F.sum(F.when(node != ROOT, F.col("weight")))).alias("score")
    )


def best_hits(hits: DataFrame, threshold: float = 0.0, true_max: bool = False) -> DataFrame:
    """Hits within ``threshold`` of the query's top score, the first hit's by position (A22, W5); or the true maximum.

    Of hits at the same position the one of the higher score, then of the lower taxon, comes first.
    """
    by = Window.partitionBy("query")
    top = F.max("score").over(by) if true_max else F.first("score").over(by.orderBy("pos", F.desc("score"), "taxon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hits.withColumn("_top", top).where(F.col("score") >= F.col("_top") - threshold).drop("_top")


def lca(best: DataFrame, toured: DataFrame) -> DataFrame:
    """``query, taxon, score``: deepest ancestor that all best hits share, mean score over them.

    ``best``: query, taxon, score. Taxa that the tour does not have are not looked at; a query without any gets -1. One
    aggregate finds the smallest and largest entry of a query: their paths share what all of its hits share.
    """
    own = best.select("query", "taxon", "score").join(toured.select(F.col("id").alias("taxon"), "entry"), "taxon", "left")
    ends = own.groupBy("query").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi"), F.avg("score").alias("score"))
    low = toured.select(F.col("entry").alias("lo"), F.col("id").alias("_id"), F.col("exit").alias("_exit"), F.col("path").alias("_low"))
    both = ends.join(low, "lo", "left").join(toured.select(F.col("entry").alias("hi"), F.col("path").alias("_high")), "hi", "left")
    level = F.sequence(F.lit(1), F.least(F.size("_low"), F.size("_high")))
    same = F.array_max(F.transform(level, lambda k: F.when(F.element_at("_low", k) == F.element_at("_high", k), k)))
    shared = F.when(F.col("hi") <= F.col("_exit"), F.col("_id")).when(same.isNotNull(), F.element_at("_low", same))
    return both.select("query", F.coalesce(shared, F.lit(-1)).alias("taxon"), "score")


def blast_best(hits: DataFrame, nodes: DataFrame, threshold: float = 3.0, factor: float | None = None, score: str = "bits", floor: float = -300.0, include_unknown: bool = False) -> DataFrame:
    """Best tabular hits (A23): bit score within ``threshold`` of the first, or e-value within ``factor`` of the first's.

    ``hits``: query, taxon, pos, identity, bits, evalue. ``score``: identity, bits or evalue (log10, 0 to ``floor``).
    """
    own = hits if include_unknown else hits.join(nodes.select(F.col("id").alias("taxon")), "taxon", "left_semi")
    first = Window.partitionBy("query").orderBy("pos", F.desc("bits"), "taxon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = own.withColumn("_bits", F.first("bits").over(first)).withColumn("_e", F.first("evalue").over(first))
    near = F.col("bits") >= F.col("_bits") - threshold if factor is None else F.col("evalue") <= F.col("_e") * factor
    value = log_score("evalue", floor) if score == "evalue" else F.col(score)
    return kept.where(near).select("query", "taxon", "pos", value.alias("score"))


def random_hit(best: DataFrame, seed: int = 0) -> DataFrame:
    """One of the best hits of each query, by a seeded hash instead of chance."""
    return best.groupBy("query").agg(F.max_by(F.struct("taxon", "score"), F.struct(seeded_hash(seed, "query", "taxon", "pos"), "taxon", "pos", "score")).alias("x")).select("query", "x.*")


def members(hits: DataFrame, page: int = 10_000) -> DataFrame:
    """``taxon, page, members``: all query ids at each node in order, in pages numbered from 0 of ``page`` ids.

    Ids are ranked in ranges of the table sorted by taxon and id, so that a taxon of any size is spread over tasks.
    """
    own = hits.select("taxon", "query").distinct()
    n = max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cut(own.repartitionByRange(n, "taxon", "query").withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("taxon", "_range").agg(F.count("*").alias("n"))
    before = counts.select("taxon", "_range", (F.sum("n").over(Window.partitionBy("taxon").orderBy("_range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("taxon", "_range").orderBy("query")) - 1
    ranked = dealt.withColumn("_n", rank).join(before, ["taxon", "_range"])
    ranked = ranked.select("taxon", "query", F.floor((F.col("_n") + F.col("before")) / F.lit(page)).alias("page"))
    return ranked.groupBy("taxon", "page").agg(F.array_sort(F.collect_list("query")).alias("members"))
