"""Transitive closures of graphs with cycles: nodes on common cycles are contracted first and expanded last.

Nodes that reach each other reach the same nodes, so a fixpoint over single nodes derives the square of their number,
each pair once per edge.  Here a group of such nodes is one node of a smaller graph, whose closure is evaluated as
any other; its pairs of groups then become pairs of nodes, each made once and not stored.  Groups needn't be whole
components: any set of nodes that reach each other may be contracted, what isn't only costs more rounds.  So up to
``LOCAL_EDGES`` edges one task finds all components, and closes their graph too if it is small; larger graphs are
searched by labels first, round by round.

Pairs of two blocks of nodes are made as Arrow batches, in runs that Parquet's encodings shrink most, and a task that makes
many has one block of second nodes, so the codes of a file's second column are single bytes: what the whole result takes, in
time and on disk, is then little more than its writer's own work.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surmise.sources.store import Store
from surmise.terms import INTRINSIC, Literal, Rule, Variable

#: The contracted graph's edges, as a relation.
EDGES = "surmise_edges"
#: One task searches a graph of so many edges at most: some hundred MB.
LOCAL_EDGES = 1 << 22
#: That task also closes a graph of so many groups at most (a group has a bit for each).
LOCAL_GROUPS = 4096
#: Searches for groups, and rounds of one search, at most: more would find more groups, but no other pairs.
MOST_PASSES, MOST_ROUNDS = 3, 40
#: A group's nodes stand in blocks of so many (their codes fit a byte; two are the 504 values that Parquet packs at once).
BLOCK = 252
#: A task makes about so many pairs of two blocks; there are so many tasks at most.
TASK_PAIRS, MOST_TASKS = 1 << 24, 20000
#: Two blocks of so many pairs at least are unfolded as Arrow batches.
ARROW_PAIRS = 1024
#: Blocks of so many nodes at most in all are broadcast: 8 MB of numbers.
BROADCAST_NODES = 1 << 20


def _ends(lit: Literal) -> tuple[str, str] | None:
    """The names of a positive literal's two different variables."""
    if not lit.positive or lit.name in INTRINSIC or len(lit.args) != 2 or not all(isinstance(a, Variable) for a in lit.args):
        return None
    a, b = (a.name for a in lit.args)
    return (a, b) if a != b else None


def _step(rule: Rule) -> tuple[str, str] | None:
    """(a, b) of a rule q(x, z) :- a(x, y), b(y, z), in either order."""
    ends = [_ends(lit) for lit in (rule.head, *rule.body)]
    if len(ends) != 3 or None in ends:
        return None
    for i, j in ((0, 1), (1, 0)):
        a, b = ends[1 + i], ends[1 + j]
        if a[1] == b[0] and a[1] not in ends[0] and (a[0], b[1]) == ends[0]:
            return rule.body[i].name, rule.body[j].name
    return None


def _copied(rule: Rule) -> str | None:
    """e of a rule q(x, y) :- e(x, y)."""
    return rule.body[0].name if len(rule.body) == 1 and _ends(rule.head) and _ends(rule.head) == _ends(rule.body[0]) else None


def closure_rules(name: str, rules: Sequence[Rule], given: bool) -> list[Rule] | None:
    """Rules that close ``EDGES`` into ``name``, if ``rules`` make ``name`` the transitive closure of what its plain rules derive."""
    plain = [r for r in rules if all(x.name != name for x in r.body)]
    steps = [_step(r) for r in rules if r not in plain]
    if not steps or None in steps:
        return None
    copied = {_copied(r) for r in plain}
    others = {x for s in steps for x in s} - {name}
    if (name, name) in steps:
        if not others <= copied:
            return None
        body = (name, name)
    else:
        # with other tuples at the start these rules would prolong them at one end only
        if given or len(others) != 1 or copied != others:
            return None
        body = tuple(name if x == name else EDGES for x in steps[0])
    x, y, z = map(Variable, "xyz")
    return [Rule(Literal(name, (x, y)), (Literal(EDGES, (x, y)),)), Rule(Literal(name, (x, z)), (Literal(body[0], (x, y)), Literal(body[1], (y, z))))]


def closed_locally(edges: DataFrame, most_groups: int) -> DataFrame:
    """(kind, x, y, block, vs) of a graph that one task holds: what it is of, by ``kind``.

    ``block``: the nodes vs of a numbered block of a component of several nodes, x; ``edge``: of the contracted graph, where nodes
    outside such components stand for themselves; ``pair``: of its closure, instead of edges, unless it has more than
    ``most_groups`` nodes.
    """
    size = BLOCK

    # nothing of this module is named inside, so executors needn't have it
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tables = [(b.column(0), b.column(1)) for b in batches if b.num_rows]
        if not tables:
            return
        coded = pa.concat_arrays([x for x, _ in tables] + [y for _, y in tables]).dictionary_encode()
        ends = coded.indices.to_numpy()
        half, n = len(ends) // 2, len(coded.dictionary)
        order = np.argsort(ends[:half], kind="stable")
        first = np.searchsorted(ends[:half][order], np.arange(n + 1)).tolist()
        to, at = ends[half:][order].tolist(), first[:n]
        index, low, group = [0] * n, [0] * n, [-1] * n
        count, stack, tops = 0, [], []
        for root in range(n):
            if index[root]:
                continue
            work = [root]
            while work:
                v = work[-1]
                if not index[v]:
                    count += 1
                    index[v] = low[v] = count
                    stack.append(v)
                if at[v] < first[v + 1]:
                    w = to[at[v]]
                    at[v] += 1
                    if not index[w]:
                        work.append(w)
                    elif group[w] < 0:
                        low[v] = min(low[v], index[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1]] = min(low[work[-1]], low[v])
                    if low[v] == index[v]:
                        tops.append(v)
                        while group[v] < 0:
                            group[stack.pop()] = v
        group, values = np.array(group), coded.dictionary

        def rows(kind, x, y=None, block=None, vs=None):
            at = (lambda i: None if i is None else values.take(pa.array(i)))
            cells = ((pa.array([kind] * len(x)), None), (at(x), None), (at(y), values.type), (block, pa.int64()), (vs, pa.list_(values.type)))
            return pa.RecordBatch.from_arrays([pa.nulls(len(x), like) if a is None else a for a, like in cells], names=["kind", "x", "y", "block", "vs"])

        kept = np.nonzero(np.bincount(group, minlength=n)[group] > 1)[0]
        rank = np.argsort(pc.array_sort_indices(values).to_numpy())
        kept = kept[np.lexsort((rank[kept], group[kept]))]
        starts = np.searchsorted(group[kept], c := np.unique(group[kept]))
        for a, b, name in zip(starts.tolist(), [*starts[1:].tolist(), len(kept)], c.tolist()):
            for k in range(a, b, size):
                own = kept[k : min(b, k + size)]
                yield rows("block", [name], None, pa.array([k // size]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), values.take(pa.array(own))))
        ends = np.unique(group[ends[:half]].astype(np.int64) * n + group[ends[half:]])
        xs, ys = ends // n, ends % n
        if len(tops) > most_groups:
            for k in range(0, len(xs), 10000):
                yield rows("edge", xs[k : k + 10000], ys[k : k + 10000])
            return
        # components come after those that they reach
        place = np.zeros(n, np.int64)
        place[tops] = np.arange(len(tops))
        reach, width = [0] * len(tops), (len(tops) + 7) // 8
        order = np.argsort(place[xs], kind="stable")
        for x, y in zip(place[xs[order]].tolist(), place[ys[order]].tolist()):
            reach[x] |= reach[y] | 1 << y
        tops = np.array(tops)
        for x, bits in enumerate(reach):
            if bits:
                own = np.unpackbits(np.frombuffer(bits.to_bytes(width, "little"), np.uint8), bitorder="little")
                own = tops[np.nonzero(own)[0]]
                yield rows("pair", np.full(len(own), tops[x]), own)

    kind = edges.schema["x"].dataType.simpleString()
    return edges.select("x", "y").coalesce(1).mapInArrow(run, f"kind string, x {kind}, y {kind}, block long, vs array<{kind}>")


def _labels(store: Store, edges: DataFrame, best) -> DataFrame:
    """(v, f, b): a node that v reaches and one that reaches v, the ``best`` ones after enough rounds.

    Each round looks along the edges and from the labels on, so distances double where labels lie ahead.
    """
    nodes = edges.select(F.col("x").alias("v")).union(edges.select("y")).distinct()
    path, state = store.write(nodes.select("v", F.col("v").alias("f"), F.col("v").alias("b")), "labels")
    for _ in range(MOST_ROUNDS):
        none = F.lit(None).cast(state.schema["v"].dataType)
        there = state.toDF("w", "wf", "wb")
        seen = [
            state.select("v", "f", "b", F.col("f").alias("f0"), F.col("b").alias("b0")),
            edges.join(there, F.col("y") == F.col("w")).select("x", "wf", none, none, none),
            edges.join(there, F.col("x") == F.col("w")).select("y", none, "wb", none, none),
            state.where("f != v").join(there, F.col("f") == F.col("w")).select("v", "wf", none, none, none),
            state.where("b != v").join(there, F.col("b") == F.col("w")).select("v", none, "wb", none, none),
        ]
        found = seen[0]
        for s in seen[1:]:
            found = found.union(s)
        found = found.groupBy("v").agg(best("f").alias("f"), best("b").alias("b"), F.max("f0").alias("f0"), F.max("b0").alias("b0"))
        new, table = store.write(found.select("v", "f", "b", ((F.col("f") != F.col("f0")) | (F.col("b") != F.col("b0"))).alias("moved")), "labels")
        still = not table.where("moved").isEmpty()
        store.drop([path])
        path, state = new, table.select("v", "f", "b")
        if not still:
            break
    return state


def groups(store: Store, edges: DataFrame) -> DataFrame | None:
    """(v, c): nodes that reach each other, with their group's node; None if no such nodes were found.

    A node that reaches a node and is reached by it belongs to its group, however many rounds found that out.
    """
    rest, found = edges.where("x != y"), None
    for k in range(MOST_PASSES):
        _, rest = store.write(rest, "rest")
        n = rest.count()
        if not n:
            break
        if n <= LOCAL_EDGES:
            _, own = store.write(closed_locally(rest, 0).where("kind = 'block'").select(F.explode("vs").alias("v"), F.col("x").alias("c")), "groups")
            if not own.isEmpty():
                found = own if found is None else found.union(own)
            break
        state = _labels(store, rest, F.min if k % 2 else F.max)
        pairs = state.where("f = b AND f != v").select("v", F.col("f").alias("c"))
        names = pairs.select("c").distinct()
        # the group's own node may have got another label when rounds ran out
        own = pairs.join(names.toDF("n"), F.col("v") == F.col("n"), "left_anti").union(names.select("c", "c"))
        _, own = store.write(own.toDF("v", "c"), "groups")
        if not own.isEmpty():
            found = own if found is None else found.union(own)
        # other cycles lie where labels agree
        left = state.join(own.select(F.col("v").alias("n")), F.col("v") == F.col("n"), "left_anti")
        a, b = left.toDF("v1", "f1", "b1"), left.toDF("v2", "f2", "b2")
        rest = rest.join(a, F.col("x") == F.col("v1")).join(b, F.col("y") == F.col("v2")).where("f1 = f2 AND b1 = b2").select("x", "y")
    return found


def contracted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges between groups; a node outside them is its own group."""
    a, b = members.toDF("va", "ca"), members.toDF("vb", "cb")
    out = edges.join(a, F.col("x") == F.col("va"), "left").join(b, F.col("y") == F.col("vb"), "left")
    return out.select(F.coalesce("ca", "x").alias("x"), F.coalesce("cb", "y").alias("y")).distinct()


def contraction(store: Store, edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """The contracted graph's edges, or else its closure's pairs, and the blocks (c, block, vs) of its groups, if any."""
    if edges.count() > LOCAL_EDGES:
        members = groups(store, edges)
        if members is None:
            return edges, None, None
        return store.write(contracted(edges, members), "edges")[1], None, blocked(store, members)
    _, table = store.write(closed_locally(edges, LOCAL_GROUPS), "local")
    kinds = {kind for (kind,) in table.select("kind").distinct().collect()}
    blocks = table.where("kind = 'block'").select(F.col("x").alias("c"), "block", "vs") if "block" in kinds else None
    if "edge" not in kinds:
        return None, table.where("kind = 'pair'").select("x", "y"), blocks
    return table.where("kind = 'edge'").select("x", "y") if blocks else edges, None, blocks


def blocked(store: Store, members: DataFrame) -> DataFrame:
    """(c, block, vs): the nodes of each group, in numbered blocks; large groups are numbered in parts of some thousand nodes."""
    sizes = members.groupBy(F.col("c").alias("g")).agg(F.ceil(F.count("*") / (64 * BLOCK)).alias("n"))
    placed = members.join(sizes, F.col("c") == F.col("g")).select("c", F.pmod(F.xxhash64("v"), F.col("n")).alias("part"), "n", "v")
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy("v")) - 1
    placed = placed.select("c", (F.col("part") + F.col("n") * F.floor(place / BLOCK)).alias("block"), "v")
    return store.write(placed.groupBy("c", "block").agg(F.sort_array(F.collect_list("v")).alias("vs")), "blocks")[1]


def _unfolded(lists: DataFrame) -> DataFrame:
    """The pairs (x, y) of each row's lists xs and ys.

    Each node of xs comes with all of ys: x stands in runs and the bytes of y's codes repeat, so both shrink to a few
    hundredths in Parquet.  Where ys are too few for runs it's the other way round.
    """

    # nothing of this module is named inside, so executors needn't have it
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(outer, inner):
            """Each node of outer with all of inner."""
            k, n = len(inner), max(1, 65536 // len(inner))
            n = min(n, len(outer))
            again, along = np.repeat(np.arange(n), k), inner.take(pa.array(np.tile(np.arange(k), n)))
            for i in range(0, len(outer), n):
                part = outer.slice(i, n)
                yield part.take(pa.array(again[: len(part) * k])), along.slice(0, len(part) * k)

        for b in batches:
            lists = [(c.offsets.to_pylist(), c.values) for c in b.columns]
            for row in range(b.num_rows):
                xs, ys = (v.slice(at[row], at[row + 1] - at[row]) for at, v in lists)
                turned = len(ys) < 8 < len(xs)
                for outer, inner in pairs(ys, xs) if turned else pairs(xs, ys):
                    yield pa.RecordBatch.from_arrays([inner, outer] if turned else [outer, inner], names=["x", "y"])

    kind = lists.schema["xs"].dataType.elementType.simpleString()
    return lists.select("xs", "ys").mapInArrow(run, f"x {kind}, y {kind}")


def _dealt(refs: DataFrame, total: float, tasks: int) -> tuple[DataFrame, int]:
    """Pairs of blocks with the number of a task, and how many tasks there are, for ``total`` pairs of nodes and about ``tasks`` tasks.

    A block of second nodes that fills an eighth of a task has one or more of its own; the others share some.
    """
    goal = total / tasks
    blocks = refs.groupBy(F.col("y").alias("oy"), F.col("by").alias("oby")).agg(F.sum("n").alias("t"))
    blocks = blocks.withColumn("parts", F.when(F.col("t") * 8 >= goal, F.ceil(F.col("t") / goal)))
    parts, rest = blocks.agg(F.coalesce(F.sum("parts"), F.lit(0)), F.sum(F.when(F.col("parts").isNull(), F.col("t")))).head()
    shared = math.ceil((rest or 0) / goal)
    own = blocks.where("parts IS NOT NULL").withColumn("last", F.sum("parts").over(Window.orderBy("oy", "oby").rowsBetween(Window.unboundedPreceding, 0)))
    found = refs.join(own, (F.col("y") == F.col("oy")) & F.col("by").eqNullSafe(F.col("oby")), "left")
    # a group's blocks take turns
    turn = F.pmod(F.hash("x").cast("long") + F.coalesce("bx", F.lit(0)), F.col("parts"))
    task = F.coalesce(F.col("last") - 1 - turn, parts + F.pmod(F.hash("y", "by"), F.lit(max(1, shared))))
    return found.select("x", "bx", "y", "by", task.cast("int").alias("task")), parts + shared


def expanded(store: Store, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pairs of nodes behind the different pairs (x, y) of groups, whose nodes stand in blocks (c, block, vs)."""
    spark = pairs.sparkSession
    index = blocks.select("c", "block", F.size("vs").cast("double").alias("n"))
    groups = index.select(F.col("c").alias("g")).distinct()
    plain = pairs.join(groups, F.col("x") == F.col("g"), "left_anti").join(groups, F.col("y") == F.col("g"), "left_anti")
    refs = pairs.join(index.toDF("cx", "bx", "nx"), F.col("x") == F.col("cx"), "left").join(index.toDF("cy", "by", "ny"), F.col("y") == F.col("cy"), "left")
    refs = refs.where("cx IS NOT NULL OR cy IS NOT NULL").withColumn("n", F.coalesce("nx", F.lit(1.0)) * F.coalesce("ny", F.lit(1.0)))
    _, refs = store.write(refs.select("x", "bx", "y", "by", "n", (F.col("n") >= ARROW_PAIRS).alias("large")), "refs")
    few = (index.agg(F.sum("n")).head()[0] or 0) <= BROADCAST_NODES
    first, second = blocks.toDF("c1", "b1", "xs"), blocks.toDF("c2", "b2", "ys")
    out = plain
    for large, total in refs.groupBy("large").agg(F.sum("n")).collect():
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, int(total / TASK_PAIRS)))
        lists, by = refs.where(F.col("large") == large).select("x", "bx", "y", "by", "n"), []
        if large:
            lists, tasks = _dealt(lists, total, tasks)
            by = ["task"]
        if few:
            # the lists come to the pairs, dealt out evenly; a join's own exchange would have few partitions for so many rows
            lists = lists.repartitionById(tasks, *by) if by else lists.repartition(tasks)
            first, second = F.broadcast(first), F.broadcast(second)
        lists = lists.join(first, (F.col("x") == F.col("c1")) & (F.col("bx") == F.col("b1")), "left")
        lists = lists.join(second, (F.col("y") == F.col("c2")) & (F.col("by") == F.col("b2")), "left")
        lists = lists.select(F.coalesce("xs", F.array("x")).alias("xs"), F.coalesce("ys", F.array("y")).alias("ys"), *by)
        if not few:
            lists = lists.repartitionById(tasks, *by) if by else lists.repartition(tasks)
        out = out.union(_unfolded(lists) if large else lists.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")))
    return out
