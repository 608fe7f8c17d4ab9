"""First-child / next-sibling links of records, turned into full hierarchies.

A record that exactly one link enters lies in the tree of the *head* above it; heads are the entries of the sets and the
records that no link or several links enter.  Pointer jumping finds head, depth and path inside the tree of every record at
once, so that the rounds follow the logarithm of the longest chain.  Trees whose head is a root fall apart at
the children of roots.  What remains is a graph of such *units*, as high as links are damaged.  Its leaves are peeled
bottom-up: each round sends lists of descendants (as rows, never as one array) and subtree sizes to the parents.  What
cannot be peeled contains the closed loops; these are taken out and peeling goes on with what lies above them.  In the
reverse order of peeling, roots, depths and paths are handed down.

Defined results: repeated rows of a record count once (the first received), links that are null, 0 or point
to no record are ignored, records without an id are dropped, records not reached keep null root and depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import Rounds, cut, cut_counted, modest_broadcasts

IDS = "array<bigint>"


@dataclass
class Trees:
    """``members``: (id, head, pos, depth, top, inside) of records below heads; ``cyclic``: ids on loops that nothing enters.

    ``pos`` counts links from the head, ``depth`` those to a first child, ``top`` is where the first of these leads,
    ``inside`` holds their sources, if paths are wanted.  ``ups[k]`` is (id, up): the record 2^k links above.
    """

    members: DataFrame
    cyclic: DataFrame
    ups: list[DataFrame]


@dataclass
class Peeled:
    """``states``: (unit, whole, unknown, n_open, peel_round) of the units left in each round, ``lists``: (holder, unit) of the units at and below a holder, by round."""

    states: Rounds
    lists: Rounds
    sent: Rounds
    rounds: int = 0

    def units(self) -> DataFrame:
        """The state of every unit in the round in which it was peeled."""
        return self.states.all().where("n_open = 0").drop("n_open")


def _nodes(records: DataFrame) -> DataFrame:
    first = F.struct("received_at", F.coalesce("next_sibling", F.lit(0)).alias("next"), F.coalesce("first_child", F.lit(0)).alias("child"), "file_set_id")
    one = records.where("record_id is not null").groupBy(F.col("record_id").alias("id")).agg(F.min(first).alias("v"))
    return cut(one.select("id", F.col("v.next").alias("next"), F.col("v.child").alias("child"), F.col("v.file_set_id").alias("file_set_id")))


def _links(nodes: DataFrame) -> DataFrame:
    """(src, dst, kind) with kind n or c, both ends existing."""
    pair = F.array(F.struct(F.col("next").alias("dst"), F.lit("n").alias("kind")), F.struct(F.col("child").alias("dst"), F.lit("c").alias("kind")))
    all_links = nodes.select(F.col("id").alias("src"), F.inline(pair)).where("dst != 0")
    return cut(all_links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))


def _trees(nodes: DataFrame, links: DataFrame, starts: DataFrame, paths: bool) -> Trees:
    """Records by head.  Each round doubles the links that are jumped; a record is done once it points to its head.

    If no more than 2^r records are still open after r rounds, the next round reaches the heads of all but those that
    hang below a loop without entry, and these then point to records on the loop.
    """
    entering = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("src", "kind")).alias("by"))
    ids = nodes.select("id").join(entering, "id", "left").join(starts.withColumn("start", F.lit(True)), "id", "left")
    head, child = (F.coalesce("n", F.lit(0)) != 1) | F.coalesce("start", F.lit(False)), F.col("by.kind") == "c"
    none = F.array().cast(IDS)
    inside = F.when(~head & child, F.array("by.src")).otherwise(none) if paths else none
    begin = ids.select("id", F.when(head, F.col("id")).otherwise(F.col("by.src")).alias("ptr"), (~head).cast("bigint").alias("pos"), (~head & child).cast("bigint").alias("depth"), F.when(~head & child, F.col("id")).alias("top"), inside.alias("inside"), head.alias("done"))
    held = Rounds(nodes.sparkSession, f"id bigint, ptr bigint, pos bigint, depth bigint, top bigint, inside {IDS}, done boolean")
    state, active = held.add(begin, "not done")
    rounds = 0
    while active:
        last = active <= 2**rounds
        known = held.all().where("done").unionByName(state.where("not done"))
        above = known.select(F.col("id").alias("ptr"), *[F.col(c).alias(f"_{c}") for c in ("ptr", "pos", "depth", "top", "inside", "done")])
        moved = state.where("not done").join(above, "ptr").select("id", F.col("_ptr").alias("ptr"), (F.col("pos") + F.col("_pos")).alias("pos"), (F.col("depth") + F.col("_depth")).alias("depth"), F.coalesce("_top", "top").alias("top"), F.concat("_inside", "inside").alias("inside"), F.col("_done").alias("done"))
        state, active = held.add(moved, "not done")
        rounds += 1
        if last and active <= 2**rounds:
            break
    members = held.all().where("done").select("id", F.col("ptr").alias("head"), "pos", "depth", "top", "inside")
    cyclic = state.where("not done").select(F.col("ptr").alias("id")).distinct()
    ups = [held.at(k).where(f"not done and pos = {2**k}").select("id", F.col("ptr").alias("up")) for k in range(len(held.paths))]
    return Trees(members, cyclic, ups)


def _root_heads(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Heads whose chains of siblings are roots: the entries, and heads that such a chain leads to."""
    steps = edges.where("kind = 'n' and top is null").select("head", "to")
    held = Rounds(starts.sparkSession, "head bigint")
    front, n = held.add(starts.select(F.col("id").alias("head")))
    while n:
        step = front.join(steps, "head").select(F.col("to").alias("head")).distinct()
        front, n = held.add(step.join(held.all(), "head", "left_anti"))
    return held.all()


def _wanted(links: DataFrame, units: DataFrame) -> DataFrame:
    """Root units whose lists someone else needs: entered from below a root or from no root, or following such a unit."""
    root_units = units.where("is_root").select("unit").distinct()
    into = links.join(root_units.withColumnRenamed("unit", "to"), "to", "left_semi")
    held = Rounds(links.sparkSession, "unit bigint")
    front, n = held.add(into.where("not chain").select(F.col("to").alias("unit")).distinct())
    while n:
        step = front.join(into.where("chain"), "unit").select(F.col("to").alias("unit")).distinct()
        front, n = held.add(step.join(held.all(), "unit", "left_anti"))
    return held.all()


def _peel(state: DataFrame, links: DataFrame, list_links: DataFrame, out: Peeled) -> DataFrame:
    """Peel ``state`` (unit, whole, unknown, n_open) as far as it goes, adding to ``out``; what is left over.

    Each round takes the units without an open child and sends sizes and lists to their parents.
    """
    send = list_links.select(F.col("unit").alias("parent"), F.col("to").alias("holder")).distinct()
    state, n_leaves = out.states.add(state.withColumn("peel_round", F.lit(out.rounds)), "n_open = 0")
    while n_leaves:
        leaves = state.where("n_open = 0")
        got = out.sent.all().withColumnRenamed("parent", "holder").join(leaves.select(F.col("unit").alias("holder")), "holder", "left_semi")
        lists = out.lists.add(leaves.select(F.col("unit").alias("holder"), "unit").union(got.select("holder", "unit")).distinct())[0]
        out.sent.add(lists.join(send, "holder").select("parent", "unit").distinct())
        sizes = links.join(leaves.select(F.col("unit").alias("to"), "whole", "unknown"), "to")
        sent = sizes.groupBy("unit").agg(F.sum("whole").alias("more"), F.max("unknown").alias("other"), F.count("*").alias("n"))
        rest = state.where("n_open > 0").join(sent, "unit", "left")
        out.rounds += 1
        zero = F.lit(0)
        columns = [(F.col("whole") + F.coalesce("more", zero)).alias("whole"), (F.col("unknown") | F.coalesce("other", F.lit(False))).alias("unknown"), (F.col("n_open") - F.coalesce("n", zero)).alias("n_open")]
        state, n_leaves = out.states.add(rest.select("unit", *columns, F.lit(out.rounds).alias("peel_round")), "n_open = 0")
    return state


def _loops(residual: DataFrame) -> DataFrame:
    """(unit, loop) of the units on closed loops, from links (unit, to) that could not be peeled.

    Links whose source nothing enters are trimmed; then the largest id that reaches a unit is spread along
    the links, and a unit that reaches its own colour back is on the loop of that colour.
    """
    held = Rounds(residual.sparkSession, "unit bigint, loop bigint")
    left, now = cut_counted(residual.select("unit", "to").distinct())
    while True:
        before = -1
        while now and now != before:
            before = now
            trimmed = left.join(left.select(F.col("to").alias("unit")).distinct(), "unit", "left_semi").join(left.select(F.col("unit").alias("to")).distinct(), "to", "left_semi")
            left, now = cut_counted(trimmed.select("unit", "to"))
        if not now:
            return held.all()
        colour, changed = cut(left.select("unit").union(left.select("to")).distinct().select("unit", F.col("unit").alias("colour"))), 1
        while changed:
            sent = left.join(colour, "unit").select(F.col("to").alias("unit"), F.col("colour").alias("sent")).groupBy("unit").agg(F.max("sent").alias("sent"))
            new = colour.join(sent, "unit", "left").select("unit", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("changed"))
            new, changed = cut_counted(new, "changed")
            colour = new.drop("changed")
        inside = left.join(colour, "unit").join(colour.select(F.col("unit").alias("to"), F.col("colour").alias("to_colour")), "to").where("colour = to_colour").select("unit", "to", "colour")
        inside = cut(inside)
        # Walk backwards from each colour's own unit.
        back = Rounds(residual.sparkSession, "unit bigint, colour bigint")
        front, n = back.add(inside.where("to = colour").select("unit", "colour").distinct())
        while n:
            step = inside.join(front.select(F.col("unit").alias("to"), "colour"), ["to", "colour"]).select("unit", "colour").distinct()
            front, n = back.add(step.join(back.all(), ["unit", "colour"], "left_anti"))
        held.add(back.all().select("unit", F.col("colour").alias("loop")))
        gone = cut(colour.where("unit = colour").select("unit").union(back.all().select("unit")).distinct())
        left, now = cut_counted(left.join(gone, "unit", "left_anti").join(gone.withColumnRenamed("unit", "to"), "to", "left_anti").select("unit", "to"))


def _and_above(ids: DataFrame, trees: Trees) -> DataFrame:
    """The ids and all records above them in their trees: jumps of falling size reach every distance."""
    for up in reversed(trees.ups):
        ids = ids.join(up, "id", "left").select(F.explode(F.array_compact(F.array("id", "up"))).alias("id")).distinct()
    return ids


@dataclass
class Hierarchy:
    """What ``build`` found; ``descendants`` and ``records`` are made from it."""

    nodes: DataFrame
    links: DataFrame
    trees: Trees
    units: DataFrame
    edges: DataFrame
    below_roots: DataFrame
    looped: DataFrame
    peeled: Peeled

    def descendants(self) -> DataFrame:
        """(root_id, record_id) of every record below a root: the lists that peeling sent to the children of roots."""
        pairs = self.below_roots.withColumnRenamed("unit", "holder").join(self.peeled.lists.all(), "holder").select("root_id", "unit")
        return pairs.distinct().join(self.units.select("unit", F.col("id").alias("record_id")), "unit").select("root_id", "record_id")

    @property
    def records(self) -> DataFrame:
        """(record_id, file_set_id, status, root_id, parent_id, depth, path, n_descendants, peel_round), one row per record.

        A record linked from two places takes the smallest (root, path length, path) and counts once per link in
        n_descendants; n_descendants is null for records above a loop, whose subtree could not be peeled.
        """
        placed, below = self._placed(), self._below()
        rounds = self.peeled.units().select("unit", "peel_round")
        rows = self.units.join(placed, "unit", "left").join(rounds, "unit", "left")
        rows = self.nodes.select("id", "file_set_id").join(rows, "id", "left").join(below, "id", "left").join(self.looped.withColumn("on_loop", F.lit(True)), "id", "left")
        loop, root = F.coalesce("on_loop", F.lit(False)), F.coalesce("is_root", F.lit(False))
        path = F.concat("v.path", "inside")
        seen = ~loop & F.col("v").isNotNull()
        return rows.select(
            F.col("id").alias("record_id"),
            "file_set_id",
            F.when(loop, "loop").when(root, "root").when(seen, "below").otherwise("unreached").alias("status"),
            F.when(~loop & root, F.col("id")).when(seen, F.col("v.root_id")).alias("root_id"),
            F.when(seen & ~root, F.element_at(path, -1)).alias("parent_id"),
            F.when(~loop & root, 0).when(seen, F.size(path)).alias("depth"),
            F.when(~loop & root, F.col("id").cast("string")).when(seen, F.concat_ws("/", path.cast("array<string>"), F.col("id").cast("string"))).alias("path"),
            F.when(~loop & (F.coalesce("unknown", F.lit(0)) == 0), F.coalesce("n", F.lit(0))).alias("n_descendants"),
            "peel_round",
        )

    def _placed(self) -> DataFrame:
        """(unit, v: root_id, size, path) of every unit below a root, handed down against the order of peeling."""
        held = Rounds(self.nodes.sparkSession, f"unit bigint, v struct<root_id:bigint,size:int,path:{IDS}>")
        rounds = self.peeled.units().select("unit", "peel_round")
        first = self.below_roots.select("unit", F.col("root_id").alias("root"), F.array("root_id").alias("path"))
        steps = cut(self.edges.join(rounds.select(F.col("unit").alias("to"), "peel_round"), "to"))
        for t in reversed(range(self.peeled.rounds)):
            own = first.join(rounds.where(F.col("peel_round") == t), "unit").select("unit", "root", "path")
            path = F.concat("v.path", "inside", F.when(F.col("kind") == "c", F.array("src")).otherwise(F.array().cast(IDS)))
            given = steps.where(F.col("peel_round") == t).join(held.all(), "unit").select(F.col("to").alias("unit"), F.col("v.root_id").alias("root"), path.alias("path"))
            held.add(own.union(given).groupBy("unit").agg(F.min(F.struct(F.col("root").alias("root_id"), F.size("path").alias("size"), "path")).alias("v")))
        return held.all()

    def _below(self) -> DataFrame:
        """(id, n, unknown) of the records that have a child: sizes below it, summed over jumps of rising size."""
        whole = self.peeled.units().select(F.col("unit").alias("to"), "whole", "unknown")
        sent = self.edges.where("not split").join(whole, "to", "left").groupBy(F.col("src").alias("id")).agg(F.sum("whole").alias("more"), F.max(F.coalesce("unknown", F.lit(True)).cast("int")).alias("other"))
        zero = F.lit(0)
        sums = cut(self.nodes.select("id").join(sent, "id", "left").select("id", (1 + F.coalesce("more", zero)).alias("n"), F.coalesce("other", zero).alias("unknown")))
        for up in self.trees.ups:
            sent = up.join(sums, "id").groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more"), F.max("unknown").alias("other"))
            sums = cut(sums.join(sent, "id", "left").select("id", (F.col("n") + F.coalesce("more", zero)).alias("n"), F.greatest("unknown", F.coalesce("other", zero)).alias("unknown")))
        return self.links.where("kind = 'c'").join(sums.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "n", "unknown")


def build(records: DataFrame, file_sets: DataFrame, paths: bool = True) -> Hierarchy:
    """Hierarchies of ``records`` (record_id, file_set_id, next_sibling, first_child, received_at) from the entries in ``file_sets`` (first_root_record).

    Without ``paths`` only descendants can be asked for.
    """
    with modest_broadcasts(records.sparkSession):
        return _build(records, file_sets, paths)


def _build(records: DataFrame, file_sets: DataFrame, paths: bool) -> Hierarchy:
    nodes = _nodes(records)
    links = _links(nodes)
    starts = cut(file_sets.select(F.col("first_root_record").alias("id")).where("id is not null").distinct().join(nodes.select("id"), "id", "left_semi"))
    trees = _trees(nodes, links, starts, paths)
    heads = trees.members.where("id = head").select(F.col("id").alias("dst"))
    edges = cut(links.join(heads, "dst", "left_semi").join(trees.members.withColumnRenamed("id", "src"), "src").select("head", "top", "inside", "pos", "src", F.col("dst").alias("to"), "kind"))
    root_heads = _root_heads(starts, edges)

    # Trees of roots fall apart at the children of roots.
    flagged = trees.members.join(root_heads.withColumn("rooted", F.lit(True)), "head", "left")
    split = F.coalesce("rooted", F.lit(False)) & F.col("top").isNotNull()
    is_root = F.coalesce("rooted", F.lit(False)) & F.col("top").isNull()
    own_inside = F.when(split, F.slice("inside", F.lit(2), F.greatest(F.size("inside") - 1, F.lit(0)))).otherwise(F.col("inside"))
    units = cut(flagged.select("id", F.when(split, F.col("top")).otherwise(F.col("head")).alias("unit"), is_root.alias("is_root"), "head", own_inside.alias("inside")))
    tops = units.where("unit = id and unit != head").select("id", F.col("head").alias("unit"))
    to_tops = tops.join(links.where("kind = 'c'").withColumnRenamed("dst", "id"), "id").select("unit", "src", F.col("id").alias("to"), "kind", F.array().cast(IDS).alias("inside"), F.lit(False).alias("chain"), F.lit(True).alias("split"))
    placed = edges.join(units.select(F.col("id").alias("src"), "unit", "is_root", F.col("inside").alias("own")), "src")
    chain = F.col("is_root") & (F.col("kind") == "n")
    between = cut(placed.select("unit", "src", "to", "kind", F.col("own").alias("inside"), chain.alias("chain"), F.lit(False).alias("split")).union(to_tops))

    # Peel, take out the loops, peel what was above them.
    wanted = _wanted(between, units)
    unwanted = units.where("is_root").select("unit").distinct().join(wanted, "unit", "left_anti")
    list_links = between.join(unwanted, "unit", "left_anti")
    children = links.where("kind = 'c'").join(units.where("is_root").select(F.col("id").alias("src")), "src").select(F.col("src").alias("root_id"), F.col("dst").alias("unit"))
    children = cut(children)
    spark = nodes.sparkSession
    out = Peeled(Rounds(spark, "unit bigint, whole bigint, unknown boolean, n_open bigint, peel_round int"), Rounds(spark, "holder bigint, unit bigint"), Rounds(spark, "parent bigint, unit bigint"))
    opened = between.groupBy("unit").agg(F.count("*").alias("n_open"))
    sizes = units.groupBy("unit").agg(F.count("*").alias("whole"))
    state = sizes.join(opened, "unit", "left").select("unit", "whole", F.lit(False).alias("unknown"), F.coalesce("n_open", F.lit(0)).alias("n_open"))
    stuck = _peel(state, between, list_links, out)
    residual = between.join(stuck.select("unit"), "unit", "left_semi").join(stuck.select(F.col("unit").alias("to")), "to", "left_semi")
    on_loops = _loops(residual)
    alive = stuck.join(on_loops.select("unit"), "unit", "left_anti").select("unit", "whole")
    ahead = residual.join(on_loops.select(F.col("unit").alias("to"), F.lit(True).alias("looped")), "to", "left").groupBy("unit").agg(F.count_if(F.col("looped").isNull()).alias("n_open"), F.count_if("looped").alias("n_loops"))
    state = alive.join(ahead, "unit", "left").select("unit", "whole", (F.coalesce("n_loops", F.lit(0)) > 0).alias("unknown"), F.coalesce("n_open", F.lit(0)).alias("n_open"))
    _peel(state, between, list_links, out)

    # On a loop is what lies above its links; a loop without entry is known from the jumps.
    inner = residual.join(on_loops, "unit").join(on_loops.select(F.col("unit").alias("to"), F.col("loop").alias("to_loop")), "to").where("loop = to_loop")
    looped = cut(_and_above(inner.select(F.col("src").alias("id")).distinct(), trees).union(trees.cyclic).distinct())
    below_roots = cut(children.join(looped.withColumnRenamed("id", "root_id"), "root_id", "left_anti"))
    return Hierarchy(nodes, links, trees, units, between, below_roots, looped, out)
