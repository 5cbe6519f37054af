"""Commit graphs: chains of first parents, mainlines, fork points of merges, and what merged branches changed.

A graph is cut into chains: each commit continues the line of first parents towards the deepest of its descendants by
first parents, so a mainline is one chain and a branch another. A commit is (chain, pos), pos growing by one along the
chain; what lies below it on its chain needs no walking. Only the other parents, links from chain to chain, are followed.
Chains come from tree contraction, and pointer doubling of what is left: rounds grow with the logarithm of the number of
commits, and what all of them move with that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amendry.functions import text as T
from amendry.operators.mining import edit_merges, section_rows, split_sections, text_paths
from amendry.plans.scratch import written

_NODE = ["project_id", "commit"]
#: Commits that are placed by pointer doubling; of more, most are taken out before.
_FEW = 2_000_000


def _nodes(commits: DataFrame) -> DataFrame:
    """(project_id, commit, id, every): commits and parents that have no row of their own, written once. Ids are in the
    order of names; `every` has the parents of each different row of a commit, and nothing for parents without a row."""
    own = F.array(F.struct("commit", "parents"))
    named = F.transform(F.filter("parents", lambda x: x.isNotNull()), lambda x: F.struct(x.alias("commit"), F.lit(None).cast("array<string>").alias("parents")))
    rows = commits.select("project_id", F.explode(F.concat(own, F.coalesce(named, F.array()))).alias("x")).select("project_id", "x.*")
    nodes = rows.groupBy(*_NODE).agg(F.collect_set("parents").alias("every"))
    return written(nodes.orderBy("commit", "project_id").withColumn("id", F.monotonically_increasing_id()), "nodes")


def _edges(nodes: DataFrame) -> DataFrame:
    """(id, nth, to, first): all parents by id, written; `first` marks what a commit's chain continues with, once a commit."""
    rows = nodes.select("project_id", "id", F.explode(F.transform("every", lambda x: F.struct(x.alias("parents"), (x == F.array_min("every")).alias("own")))).alias("x"))
    each = rows.select("project_id", "id", F.col("x.own").alias("own"), F.posexplode("x.parents").alias("nth", "commit"))
    found = each.join(nodes.select(*_NODE, F.col("id").alias("to")), _NODE)
    return written(found.select("id", "nth", "to", (F.col("own") & (F.col("nth") == 0)).alias("first")), "edges")


def _contracted(state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of tree contraction: what is left of (id, up, len, kids, best), and the commits taken out.

    Commits without children go, after their parent has seen how deep they are. Of commits with one child those go that
    come before child and parent in an order drawn anew each round, a third of a long line; the child's edge then leads
    past them. `via` is the neighbour whose place gives theirs, `len` the distance to it.
    """
    leaf, deep = F.col("kids") == 0, F.struct((F.col("best.height") + F.col("len")).alias("height"), F.col("best.tip").alias("tip"))
    seen = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
        F.max(F.when(leaf, deep)).alias("seen"), F.count_if(leaf).alias("leaves"), F.max("id").alias("only"), F.max("len").alias("below")
    )
    order = lambda x: F.xxhash64(x, F.lit(turn))
    past = (F.col("kids") == 1) & F.col("up").isNotNull() & (F.col("leaves") == 0) & (order("id") < order("up")) & (order("id") < order("only"))
    best = F.greatest("best", F.coalesce("seen", "best"))
    each = state.join(seen, "id", "left").select("id", "up", "len", (F.col("kids") - F.coalesce("leaves", F.lit(0))).alias("kids"), best.alias("best"), leaf.alias("leaf"), F.coalesce(past, F.lit(False)).alias("past"), "only", "below")
    each = written(each, "contracted")
    gone = each.where("past")
    no_place, no_best = F.lit(None).cast("long"), F.lit(None).cast("struct<height:bigint,tip:bigint>")
    told = gone.select(F.col("up").alias("id"), deep.alias("seen"), no_place.alias("next"), no_place.alias("more"))
    told = told.union(gone.select(F.col("only").alias("id"), no_best.alias("seen"), F.col("up").alias("next"), F.col("len").alias("more")))
    told = told.groupBy("id").agg(F.max("seen").alias("seen"), F.max("next").alias("next"), F.max("more").alias("more"))
    left = each.where("NOT leaf AND NOT past").join(told, "id", "left")
    left = left.select("id", F.coalesce("next", "up").alias("up"), (F.col("len") + F.coalesce("more", F.lit(0))).alias("len"), "kids", best.alias("best"))
    out = each.where("leaf OR past").select("id", F.when(F.col("leaf"), F.col("up")).otherwise(F.col("only")).alias("via"), F.when(F.col("leaf"), F.col("len")).otherwise(F.col("below")).alias("len"), "leaf", "best")
    return written(left, "chains"), out


def _doubled(state: DataFrame) -> DataFrame:
    """(id, best, pos) by pointer doubling, from (id, up, len, best): in each round all rows move, so it is for few."""
    number = state.count()
    state = state.select("id", "up", F.col("len").alias("steps"), "best")
    for k in range(64):
        rising = state.where("up IS NOT NULL")
        if rising.isEmpty():
            break
        if 1 << k > number:  # more steps than commits
            raise ValueError("commits are their own ancestors")
        # `up` is 2^k edges away: the deepest tip seen from there, and the jump twice as long.
        seen = rising.groupBy(F.col("up").alias("id")).agg(F.max(F.struct((F.col("best.height") + F.col("steps")).alias("height"), F.col("best.tip").alias("tip"))).alias("seen"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        jumped = rising.join(above, "up").select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "best")
        moved = jumped.unionByName(state.where("up IS NULL")).join(seen, "id", "left")
        state = written(moved.select("id", "up", "steps", F.greatest("best", F.coalesce("seen", "best")).alias("best")), "chains")
    return state.select("id", "best", F.col("steps").alias("pos"))


def _placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chain, pos) of all commits, a chain named by the id of its last one, written.

    The forest of first parents shrinks round by round until `_FEW` commits are left, which are placed by doubling; those
    taken out follow, the last ones first. Rounds shrink by a constant share, so all of them together move a few times the
    commits, however deep the history is.
    """
    first = edges.where("first").select("id", F.col("to").alias("up"))
    kids = first.groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    state = nodes.select("id").join(first, "id", "left").join(kids, "id", "left")
    best = F.struct(F.lit(0).cast("long").alias("height"), F.col("id").alias("tip"))
    state = written(state.select("id", "up", F.col("up").isNotNull().cast("long").alias("len"), F.coalesce("kids", F.lit(0)).alias("kids"), best.alias("best")), "chains")
    number, levels = state.count(), []
    while number > _FEW:
        state, out = _contracted(state, len(levels))
        levels.append(out)
        before, number = number, state.count()
        if number == before:
            break
    placed = _doubled(state)
    for out in reversed(levels):
        at = placed.select(F.col("id").alias("via"), F.col("best").alias("of_via"), F.col("pos").alias("at"))
        below = F.struct((F.col("of_via.height") + F.col("len")).alias("height"), F.col("of_via.tip").alias("tip"))
        pos = F.when(F.col("leaf"), F.coalesce("at", F.lit(0)) + F.col("len")).otherwise(F.col("at") - F.col("len"))
        found = out.join(at, "via", "left").select("id", F.when(F.col("leaf"), F.col("best")).otherwise(F.greatest("best", below)).alias("best"), pos.alias("pos"))
        placed = placed.union(written(found, "chains"))
    return written(placed.select("id", F.col("best.tip").alias("chain"), "pos"), "placed")


def chains(commits: DataFrame) -> DataFrame:
    """(project_id, commit, chain, pos) of all commits and of parents that have no row of their own, which are roots.

    A chain is named by its last commit. Parents that form a circle are an error. Rounds move numbers only, given in the
    order of the commits' names; names come back at the end. Of rows that repeat a commit with other parents, the chain
    follows the first in order.
    """
    nodes = _nodes(commits)
    placed = _placed(nodes, _edges(nodes))
    tips = nodes.select(F.col("id").alias("chain"), F.col("commit").alias("name"))
    return nodes.join(placed, "id").join(tips, "chain").select(*_NODE, F.col("name").alias("chain"), "pos")


def _links(edges: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chain, pos, to_chain, to_pos, to_low): parents that don't continue their child's chain, and (chain, low), where
    chains begin that don't end in a root. `to_low` is the first position of `to_chain`."""
    to = placed.select(F.col("id").alias("to"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    found = edges.join(placed, "id").join(to, "to").where("NOT (nth = 0 AND chain = to_chain)")
    found = written(found.select("chain", "pos", "to_chain", "to_pos", "first"), "across")
    lows = found.where("first").select("chain", F.col("pos").alias("low"))
    each = found.select("chain", "pos", "to_chain", "to_pos").distinct()
    each = each.join(lows.withColumnsRenamed({"chain": "to_chain", "low": "to_low"}), "to_chain", "left")
    return written(each.select("chain", "pos", "to_chain", "to_pos", F.coalesce("to_low", F.lit(0)).alias("to_low")), "links"), lows


def mainline(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(project_id, commit): the commits that first parents lead to from each project's head, itself included."""
    nodes = _nodes(commits)
    edges = _edges(nodes)
    placed = _placed(nodes, edges)
    to = placed.select(F.col("id").alias("to"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    hops = edges.where("nth = 0").join(placed, "id").join(to, "to").where("chain <> to_chain")
    hops = written(hops.select("chain", "to_chain", "to_pos").distinct(), "hops")
    front = written(heads.select(*_NODE).join(nodes, _NODE).select("id").join(placed, "id").select("chain", "pos"), "front")
    passed = [front]
    while not front.isEmpty():
        front = written(front.join(hops, "chain").select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")).distinct(), "front")
        passed.append(front)
    reach = passed[0]
    for x in passed[1:]:
        reach = reach.union(x)
    upto = reach.groupBy("chain").agg(F.max("pos").alias("upto"))
    return nodes.join(placed.join(upto, "chain").where("pos <= upto").select("id"), "id").select(*_NODE)


def _reached(sides: DataFrame, links: DataFrame, window: int) -> DataFrame:
    """(m, side, of, chain, pos, low, floor): how far up each chain the sides of a merge reach; `floor` is how far up all
    do, null where not all reach the chain.

    `sides` has (m, side, of, chain, pos, low), the place where each of `of` sides of merge m begins, and the first
    position of its chain. Sides follow the links of the last `window` positions of the chains they have reached, twice as
    many each round, each once, and none below a commit that all reach; a merge leaves when nothing is new and nothing
    above its common commits is left. So the work follows the length of the branch, not of the history, and commits above
    the common ones are complete. A round deals what is reached by merge once; all that is asked about a merge is then
    together.
    """
    own, on = ["m", "side", "of", "chain", "low"], Window.partitionBy("m", "chain")
    floor = F.when(F.count(F.lit(1)).over(on) == F.col("of"), F.min("pos").over(on))
    state = sides.select(*own, "pos").repartition("m").withColumns({"floor": floor, "top": F.col("pos")})
    state, found = written(state.withColumn("busy", F.lit(True)), "reach"), []
    while not state.isEmpty():
        lower = F.greatest(F.coalesce("floor", F.lit(-1)), F.col("pos") - window)
        open_ = state.withColumn("lower", lower).where("top > lower")
        # At most `window` positions lie in two bins; joined by chain alone, each merge would meet all links of a mainline.
        bins = open_.withColumn("bin", F.explode(F.sequence(F.floor((F.col("lower") + 1) / window), F.floor(F.col("top") / window))))
        leaving = links.withColumnRenamed("pos", "leaves").withColumn("bin", F.floor(F.col("leaves") / window))
        way = bins.select("m", "side", "of", "chain", "bin", "lower", "top").join(leaving, ["chain", "bin"]).where("leaves <= top AND leaves > lower")
        new = way.select("m", "side", "of", F.col("to_chain").alias("chain"), F.col("to_low").alias("low"), F.col("to_pos").alias("pos"), F.lit(None).cast("long").alias("was"))
        merged = state.select(*own, "pos", F.col("pos").alias("was")).union(new).repartition("m").groupBy(*own).agg(F.max("pos").alias("pos"), F.max("was").alias("was"))
        merged = merged.withColumns({"floor": floor, "moved": F.coalesce("was", F.lit(-1)) < F.col("pos")})
        # Of chains that didn't move, what is above is followed already.
        left = F.col("moved") | (F.col("pos") - window > F.coalesce("floor", F.col("low") - 1))
        top = F.when(F.col("moved"), F.col("pos")).otherwise(F.col("pos") - window)
        merged = merged.select(*own, "pos", "floor", top.alias("top"), F.max(left).over(Window.partitionBy("m")).alias("busy"))
        state = written(merged, "reach")
        found.append(state.where("NOT busy"))
        state = state.where("busy")
        window *= 2
    ends = found[0] if found else state
    for x in found[1:]:
        ends = ends.union(x)
    return ends


def _not_behind(ends: DataFrame, links: DataFrame, window: int) -> DataFrame:
    """Common commits of a merge that no other of its common commits descends from: (m, chain, pos, low, of), with one
    on a chain and `of` in all.

    Where there are several, each is a side that walks down until all meet: what all reach lies below every one of them
    and leads to none, so what is below needs no walking.
    """
    over = _reached(ends.where("of > 1").select("m", F.col("chain").alias("side"), "of", "chain", "pos", "low"), links, window)
    upto = over.where("side <> chain").groupBy("m", "chain").agg(F.max("pos").alias("upto"))
    return ends.join(upto, ["m", "chain"], "left").where("upto IS NULL OR upto < pos").drop("upto")


def fork_points(commits: DataFrame, merges: DataFrame, window: int = 16) -> DataFrame:
    """(project_id, commit, fork): the nearest common ancestor of each merge's two parents.

    `commits` and `merges` have project_id, commit and parents (array). The fork is the common ancestor that no other
    common one descends from, the least id if several (criss-cross merges); a parent that is an ancestor of the other is
    the fork itself. Merges whose parents share no history have no row; merges of more than two parents are left out.
    """
    merges = merges.where(F.size("parents") == 2).select(*_NODE, "parents").dropDuplicates(_NODE)
    merges = written(merges.withColumn("m", F.monotonically_increasing_id()), "merges")
    nodes = _nodes(commits)
    edges = _edges(nodes)
    placed = _placed(nodes, edges)
    links, lows = _links(edges, placed)
    parents = merges.select("project_id", "m", F.posexplode("parents").alias("side", "commit"))
    sides = parents.join(nodes.select(*_NODE, "id"), _NODE).select("m", "side", "id").join(placed, "id").join(lows, "chain", "left")
    reach = _reached(sides.select("m", "side", F.lit(2).cast("long").alias("of"), "chain", "pos", F.coalesce("low", F.lit(0)).alias("low")), links, window)
    ends = reach.where("side = 0 AND floor IS NOT NULL").select("m", "chain", "low", F.col("floor").alias("pos")).repartition("m")
    ends = written(ends.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("m"))), "ends")
    forks = _not_behind(ends, links, window).join(placed, ["chain", "pos"]).groupBy("m").agg(F.min("id").alias("id"))
    return forks.join(nodes.select("id", F.col("commit").alias("fork")), "id").join(merges, "m").select(*_NODE, "fork")


def merged_branches(commits: DataFrame, heads: DataFrame | None = None, prefix: str = "edit/", tips: DataFrame | None = None) -> DataFrame:
    """(project_id, commit, branch, base, fork, tip) of each merged edit branch: where it began and its last commit.

    With `heads` (project_id, commit) only merges on the line of first parents of a head count, with `tips` (project_id,
    tip) only those of a branch that ends in one. Merges without a common ancestor, and those of a branch that the mainline
    already held (fork and tip are one commit), are dropped.
    """
    if tips is not None:
        commits = commits.join(tips.select("project_id").distinct(), "project_id", "left_semi")
    merges = edit_merges(commits, prefix)
    if tips is not None:
        merges = merges.withColumn("tip", F.element_at("parents", 2)).join(tips, ["project_id", "tip"], "left_semi").drop("tip")
    if heads is not None:
        merges = merges.join(mainline(commits, heads), _NODE, "left_semi")
    merges = written(merges, "merges")
    found = merges.join(fork_points(commits, merges), _NODE).withColumn("tip", F.element_at("parents", 2))
    return found.where("fork <> tip").select(*_NODE, "branch", "base", "fork", "tip")


def merged_section_pairs(commits: DataFrame, revisions: DataFrame, heads: DataFrame | None = None, prefix: str = "edit/", max_chars: int = 12000, path: str | None = None) -> DataFrame:
    """Sections that merged edit branches changed: their text at the fork and at the branch's last commit.

    `revisions` holds the text of files (project_id, path, ref, text) by commit. Files of text suffixes whose text
    differs and that both commits hold are split; one file alone with `path`. Rows are those of `section_pairs` with
    merged_branch and merge_commit.
    """
    texts = revisions.where(F.col("path") == path) if path is not None else revisions
    texts = texts.join(text_paths(texts), "path", "left_semi")
    # Only merges whose branch ends in a commit with texts can have rows, so no others are walked.
    tips = written(texts.select("project_id", F.col("ref").alias("tip")).distinct(), "tips")
    branches = written(merged_branches(commits, heads, prefix, tips), "branches")
    at = lambda ref, name: texts.select("project_id", "path", F.col("ref").alias(ref), F.col("text").alias(name))
    files = branches.join(at("fork", "base_text"), ["project_id", "fork"]).join(at("tip", "edit_text"), ["project_id", "tip", "path"])
    changed = written(files.where("base_text <> edit_text").select("project_id", "path", "commit", "branch", "fork", "tip", "base_text", "edit_text"), "changed")
    keys = ["project_id", "path", "commit"]
    sides = changed.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_text").alias("text")) for s in ("base", "edit")))).alias("x")).select(*keys, "x.*")
    sections = split_sections(sides, keys=(*keys, "side"))
    side = lambda s, name: sections.where(F.col("side") == s).select(*keys, "section_key", F.col("body").alias(name))
    both = side("base", "source_text").join(side("edit", "edited_text"), [*keys, "section_key"], "full_outer")
    whence = changed.select(*keys, "branch", "fork", "tip")
    pairs = section_rows(both, max_chars).join(whence, keys)
    reference = T.source_reference(F.col("path"), F.col("fork"), F.col("tip"), F.col("fork"), F.col("tip"), F.col("section_key"))
    return pairs.withColumn("source_reference", reference).withColumnsRenamed({"commit": "merge_commit", "branch": "merged_branch"}).drop("fork", "tip")
