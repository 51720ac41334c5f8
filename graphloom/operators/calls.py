"""Operators over one large call graph: fixpoints as joins of a frontier, distributed by symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import kernels as K
from graphloom.operators.components import components as linked
from graphloom.plans.shared import cut

#: Steps of a fixpoint that one job takes before its result is written.
HOPS = 3
#: New rows of a closure that are sent to where the calls are, a step at a time, instead of dealing all calls again.
FEW_NEW = 100_000
#: Such steps that one job takes at most; fewer, where by the mean number of a caller's calls more than FEW_NEW would be sent.
FEW_HOPS = 6
#: Calls of one weak component whose strong components or labels one task finds; more are settled in rounds of joins.
FEW_CALLS = 500_000
#: Calls of small weak components that one task gets on average.
DEAL = 50_000


def reversed_calls(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def symbols_of(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("caller").alias("id")).union(calls.select("callee")).distinct()


def closure(calls: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``start, node, depth`` for every seed ``start`` and all that it reaches, itself at depth 0; fewest calls.

    Where seeds have a ``node``, what it reaches counts for their ``start``. With ``most``, all within so many calls is found,
    and maybe some beyond. Each round sends only what the last one found; rounds follow the longest shortest path. The calls are made once, however
    they are derived. As long as few rows are new they are broadcast, so that a round only reads the calls; the fewer, the
    more steps it takes.
    """
    calls = cut(calls.select("caller", "callee"), "calls")
    state, depth = cut(seeds.select("start", F.col("node" if "node" in seeds.columns else "start").alias("node"), F.lit(0).alias("depth")).distinct().withColumn("new", F.lit(True)), "closure"), 0
    mean = calls.agg(F.count("*") / F.greatest(F.lit(1), F.approx_count_distinct("caller"))).first()[0]
    while (most is None or depth < most) and (n := state.where("new").count()):
        if n <= FEW_NEW:
            hops, front = 1, state.where("new").select("start", "node")
            while hops < min(FEW_HOPS, FEW_HOPS if most is None else most - depth) and n * max(1, mean) ** (hops + 1) <= FEW_NEW:
                hops += 1
            rows = [state.select("start", "node", "depth", F.lit(True).alias("known"))]
            for _ in range(hops):
                depth += 1
                front = calls.join(F.broadcast(front), F.col("node") == F.col("caller")).select("start", F.col("callee").alias("node")).distinct()
                rows.append(front.select("start", "node", F.lit(depth).alias("depth"), F.lit(False).alias("known")))
            state = reduce(DataFrame.unionAll, rows).groupBy("start", "node").agg(F.min("depth").alias("depth"), F.bool_or("known").alias("known"))
            # the last step's have not been sent on
            state = state.select("start", "node", "depth", (~F.col("known") & (F.col("depth") == depth)).alias("new"))
            state = cut(state, "closure")
            continue
        for _ in range(HOPS):
            depth += 1
            # each row stays, once for each call that it sends on: what a round needs is read once
            to = state.join(calls, (F.col("node") == F.col("caller")) & F.col("new"), "left")
            own = F.struct("node", "depth", F.lit(True).alias("known"))
            sent = F.when(F.col("callee").isNotNull(), F.struct(F.col("callee").alias("node"), F.lit(depth).alias("depth"), F.lit(False).alias("known")))
            rows = to.select("start", F.inline(F.array_compact(F.array(own, sent))))
            state = rows.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.bool_or("known").alias("known")).select("start", "node", "depth", (~F.col("known")).alias("new"))
        state = cut(state, "closure")
    return state.drop("new")


def reached(calls: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``id``: what any seed (``start``) reaches, itself included; each symbol is found once, whichever seeds reach it."""
    return closure(calls, seeds.select(F.lit(0).cast("long").alias("start"), F.col("start").alias("node")), most).select(F.col("node").alias("id"))


def reachable_symbols(calls: DataFrame, entry: DataFrame) -> DataFrame:
    """Symbols that the entries (``start``) reach, without themselves unless a cycle leads back."""
    first = calls.join(entry.select(F.col("start").alias("caller")), "caller").select(F.col("callee").alias("start")).distinct()
    return reached(calls, first)


def dead_symbols(symbols: DataFrame, calls: DataFrame, entry: DataFrame) -> DataFrame:
    """``id, reason``: symbols that no entry reaches; entries live."""
    live = reached(calls, entry)
    called = calls.select(F.col("callee").alias("id")).distinct().withColumn("called", F.lit(True))
    rows = symbols.select("id").join(live, "id", "left_anti").join(called, "id", "left")
    return rows.select("id", F.when(F.col("called"), "called by dead symbols only").otherwise("never called").alias("reason"))


def _settled(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """``id, way, label`` once every label has gone as far as it can: along ``arcs`` (``src, dst, way``), the least wins.

    A round sends only what the last one changed, HOPS rounds to a written table.
    """
    state = state.withColumn("moved", F.lit(True))
    while True:
        for _ in range(HOPS):
            to = state.join(arcs.toDF("src", "dst", "w"), (F.col("id") == F.col("src")) & (F.col("way") == F.col("w")) & F.col("moved"), "left")
            own = F.struct("id", "label", F.col("label").alias("own"))
            sent = F.when(F.col("dst").isNotNull(), F.struct(F.col("dst").alias("id"), "label", F.lit(None).cast("long").alias("own")))
            rows = to.select("way", F.inline(F.array_compact(F.array(own, sent))))
            state = rows.groupBy("id", "way").agg(F.min("label").alias("label"), F.max("own").alias("own")).select("id", "way", "label", (F.col("label") < F.col("own")).alias("moved"))
        state = cut(state, "labels")
        if state.where("moved").isEmpty():
            return state.select("id", "way", "label")


def _contracted(arcs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Arcs without the ends and the insides of chains, and for each round what it took out: ``id, before, after``.

    A round drops symbols that nothing calls or that call nothing, and of those with one caller and one callee all whose
    hash is less than such neighbours' have: their two arcs become one. So chains, however long, take few rounds. It ends
    where FEW_CALLS are left, or where a round takes out little.
    """
    taken: list[DataFrame] = []
    arcs = cut(arcs, "arcs")
    n = arcs.count()
    while n > FEW_CALLS:
        ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        degree = arcs.select(F.inline(ends)).groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        s, d = degree.toDF("src", "so", "si"), degree.toDF("dst", "do", "di")
        through = lambda o, i: (F.col(o) == 1) & (F.col(i) == 1)
        place = lambda c: F.xxhash64(c, F.lit(len(taken)))
        kept = arcs.join(s, "src").join(d, "dst").where("si > 0 and do > 0").select("src", "dst", through("so", "si").alias("ps"), through("do", "di").alias("pd"))
        kept = cut(kept, "kept")
        into = kept.where(F.col("pd") & (~F.col("ps") | (place("dst") < place("src")))).select(F.col("dst").alias("id"), F.col("src").alias("before"))
        out = kept.where(F.col("ps") & (~F.col("pd") | (place("src") < place("dst")))).select(F.col("src").alias("id"), F.col("dst").alias("after"))
        picked = cut(into.join(out, "id"), "picked")
        left = kept.select("src", "dst").join(picked.select(F.col("id").alias("src")), "src", "left_anti").join(picked.select(F.col("id").alias("dst")), "dst", "left_anti")
        arcs = cut(left.select("src", "dst").union(picked.where("before != after").select("before", "after")).distinct(), "arcs")
        taken.append(picked)
        was, n = n, arcs.count()
        if n > 0.95 * was:
            break
    return arcs, taken


def _apart(arcs: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Written ``arcs`` (``src, dst``) of weak components of FEW_CALLS at most, dealt so that none is in two partitions, their
    number, and the arcs of all larger ones."""
    n = arcs.count()
    if n <= FEW_CALLS:
        return arcs.coalesce(1), n, arcs.where("false")
    own = arcs.join(linked(arcs.toDF("a", "b")).toDF("src", "part"), "src", "left")
    own = cut(own.select("src", "dst", F.coalesce("part", "src").alias("part")), "parts")
    large = cut(own.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > FEW_CALLS), "large")
    many = cut(own.join(large, "part", "left_semi").select("src", "dst"), "many")
    few = n - many.count()
    return own.join(large, "part", "left_anti").repartition(few // DEAL + 1, "part").select("src", "dst"), few, many


def strong_components(calls: DataFrame) -> DataFrame:
    """``id, component`` (smallest member) for every symbol of a call.

    Weak components of FEW_CALLS at most are dealt to tasks, which settle them. In larger ones, as soon as no more than
    FEW_CALLS are left, one task settles these. Until then chains are
    contracted, and of what is left each round finds for every symbol the least label that reaches it and the
    least that it reaches (labels are hashes, so that no order of ids makes rounds many). Where both are the same, that
    symbol's component is found; calls between symbols of unlike pairs of labels lie in no cycle and are left out of the
    next round, in which every class of equal pairs finds at least the component of its least label. A contracted symbol is
    in a component if its caller and its callee are in the same one.
    """
    ids = symbols_of(calls)
    few, n, many = _apart(cut(calls.where("caller != callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct(), "arcs"))
    label = lambda c: F.xxhash64(c)
    done: list[DataFrame] = [ids.where("false").select("id", label("id").alias("label"))]
    if n:
        done.append(K.strong_components(few).select("id", label("member").alias("label")))
    rest, taken = _contracted(many)
    while left := rest.count():
        if left <= FEW_CALLS:
            done.append(K.strong_components(rest.coalesce(1)).select("id", label("member").alias("label")))
            break
        ways = F.array(F.struct("src", "dst", F.lit(0).alias("way")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way")))
        arcs = cut(rest.select(F.inline(ways)), "arcs")
        start = arcs.select(F.col("src").alias("id")).distinct().select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), label("id").alias("label"))
        pairs = cut(_settled(arcs, start).groupBy("id").agg(F.min(F.when(F.col("way") == 0, F.col("label"))).alias("to"), F.min(F.when(F.col("way") == 1, F.col("label"))).alias("from")), "pairs")
        done.append(pairs.where("`to` = `from`").select("id", F.col("to").alias("label")))
        open_ = pairs.where("`to` != `from`")
        a, b = open_.toDF("src", "t1", "f1"), open_.toDF("dst", "t2", "f2")
        rest = cut(arcs.where("way = 0").select("src", "dst").join(a, "src").join(b, "dst").where("t1 = t2 and f1 = f2").select("src", "dst"), "rest")
    found = reduce(DataFrame.unionByName, done)
    for k, picked in enumerate(reversed(taken)):
        a, b = found.toDF("before", "la"), found.toDF("after", "lb")
        own = picked.join(a, "before", "left").join(b, "after", "left").select("id", F.coalesce("la", label("before")).alias("label"), F.coalesce("lb", label("after")).alias("other"))
        found = found.unionByName(own.where("label = other").select("id", "label"))
        found = cut(found, "found") if k % HOPS == HOPS - 1 else found
    named = ids.join(found, "id", "left").select("id", F.coalesce("label", label("id")).alias("label"))
    named = cut(named, "named")
    return named.join(named.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component")


#: Hubs of the first round of labels, by how much later rounds have more, and how many are taken from a sort at most.
HUBS, MORE_HUBS, FEW_HUBS = 16, 16, 65_536


def reachability_labels(calls: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index of what reaches what: ``component, hub`` of hubs that a component reaches, and of hubs that reach it.

    ``a`` reaches ``b`` if their components are the same, or some hub is among those that a's reaches and those that reach
    b's. Every component is a hub for itself; rounds of ever more of them, those with most calls first, spread from each hub
    both ways, and stop where an earlier hub tells the same. So labels are few where many ways lead through few symbols.
    Weak components of FEW_CALLS at most are labelled by the tasks that they are dealt to, hub by hub; only larger ones take
    rounds of joins.
    """
    few, n, arcs = _apart(cut(condensation(calls, components), "condensed"))
    own = cut(K.reach_labels(few), "labels") if n else arcs.select(F.col("src").alias("component"), F.col("dst").alias("hub"), F.lit(0).alias("way"))
    small = [own.where(F.col("way") == way).select("component", "hub") for way in (0, 1)]
    if arcs.isEmpty():
        return small[0], small[1]
    ends = arcs.select(F.col("src").alias("node")).unionAll(arcs.select("dst")).groupBy("node").agg(F.count("*").alias("n"))
    nodes = cut(ends, "hubs")
    left, size = nodes.count(), HUBS
    none = arcs.sparkSession.createDataFrame([], "node long, hub long")
    out, into = none, none
    # calls first, a hash where they are equal
    place = F.col("n") + F.pmod(F.xxhash64("node"), F.lit(2**20)) / 2.0**20
    rest = nodes.select("node", place.alias("place"))
    while left > 0:
        hubs = rest
        if left > size:
            if size <= FEW_HUBS:
                least = rest.orderBy(F.desc("place")).limit(size).agg(F.min("place")).first()[0]
            else:
                least = rest.agg(F.percentile_approx("place", 1 - size / left, 10000)).first()[0]
            hubs, rest = rest.where(F.col("place") >= least), rest.where(F.col("place") < least)
            left = rest.count()
        else:
            left = 0
        hubs = cut(hubs.select(F.col("node").alias("hub")), "round")
        # first towards what a hub reaches (labels "into" it), then against the calls
        new_into = _spread(arcs, hubs, out, into)
        new_out = _spread(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hubs, into, out)
        into, out = cut(into.unionByName(new_into), "into"), cut(out.unionByName(new_out), "out")
        size *= MORE_HUBS
    return small[0].unionAll(out.select("node", "hub")), small[1].unionAll(into.select("node", "hub"))


def _spread(arcs: DataFrame, hubs: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """``node, hub``: what each hub reaches along ``arcs``, not beyond nodes for which ``near`` and ``far`` (labels of earlier
    rounds, of the hub and of the node) have a hub in common. Only nodes that a hub comes to are asked for that, not all pairs."""
    own = near.join(hubs.select(F.col("hub").alias("node")), "node", "left_semi").select(F.col("node").alias("h"), F.col("hub").alias("v"), F.lit(True).alias("met"))
    own, told = cut(own, "told"), far.select(F.col("node").alias("at"), F.col("hub").alias("via"))
    state = hubs.select(F.col("hub").alias("node"), "hub", F.lit(True).alias("new"))
    while True:
        for _ in range(HOPS):
            # each row stays, once for each call that it sends on
            to = state.join(arcs, (F.col("node") == F.col("src")) & F.col("new"), "left")
            sent = F.when(F.col("dst").isNotNull(), F.struct(F.col("dst").alias("node"), F.lit(False).alias("known")))
            rows = to.select("hub", F.inline(F.array_compact(F.array(F.struct("node", F.lit(True).alias("known")), sent))))
            state = rows.groupBy("node", "hub").agg(F.bool_or("known").alias("known"))
            asked = state.join(told, (F.col("node") == F.col("at")) & ~F.col("known"), "left").join(own, (F.col("hub") == F.col("h")) & (F.col("via") == F.col("v")), "left")
            state = asked.groupBy("node", "hub").agg(F.bool_or("known").alias("known"), F.bool_or("met").alias("met")).where("known or met is null").select("node", "hub", (~F.col("known")).alias("new"))
        state = cut(state, "spread")
        if state.where("new").isEmpty():
            return state.select("node", "hub")


def reaches(pairs: DataFrame, components: DataFrame, labels: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The ``pairs`` (``a, b``) of which a reaches b, itself included, answered by ``reachability_labels`` alone."""
    rows = pairs.select("a", "b").distinct().join(components.toDF("a", "ca"), "a").join(components.toDF("b", "cb"), "b")
    from_a, to_b = labels[0].toDF("ca", "hub"), labels[1].toDF("cb", "hub")
    met = rows.where("ca != cb").join(from_a, "ca").join(to_b, ["cb", "hub"], "left_semi").select("a", "b")
    return rows.where("ca = cb").select("a", "b").unionByName(met.distinct())


#: Parts that what reaches a hub, and a component's symbols, are dealt to, so that a large one is not one task's.
HUB_PARTS = 16


def reached_among(symbols: DataFrame, components: DataFrame, labels: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``a, b`` of all of the ``symbols`` (``id``) that reach each other, found by their hubs, without trying all pairs."""
    own = symbols.select("id").distinct().join(components, "id")
    a, b = own.toDF("a", "component"), own.toDF("b", "component")
    dealt = lambda rows: rows.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(HUB_PARTS)).cast("int"))
    in_all = lambda rows: rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))))
    same = dealt(a).join(in_all(b), ["component", "part"]).select("a", "b")
    from_a, to_b = a.join(labels[0], "component").select("a", "hub"), b.join(labels[1], "component").select("b", "hub")
    return same.unionByName(dealt(from_a).join(in_all(to_b), ["hub", "part"]).select("a", "b")).distinct()


def between(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by which the ``symbols`` (``id``, once each) reach each other just as they do by ``calls``, over as few others as that takes.

    A round drops other symbols that nothing calls or that call nothing, and of those with one caller or one callee all whose
    hash is less than such neighbours' have: what calls them now calls what they called, which is no more calls. So chains and
    trees, however long, take few rounds. It ends where DEAL calls are left, or where a round takes out little.
    """
    arcs = cut(calls.where("caller != callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct(), "arcs")
    n, turn = arcs.count(), 0
    while n > DEAL:
        ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(False).alias("own")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(False).alias("own")))
        both = arcs.select(F.inline(ends)).unionAll(symbols.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(True).alias("own")))
        degree = both.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.bool_or("own").alias("own"))
        free = ~F.col("own") & ((F.col("o") == 1) | (F.col("i") == 1))
        s, d = degree.select(F.col("id").alias("src"), (F.col("own") | (F.col("i") > 0)).alias("sl"), free.alias("sf")), degree.select(F.col("id").alias("dst"), (F.col("own") | (F.col("o") > 0)).alias("dl"), free.alias("df"))
        kept = cut(arcs.join(s, "src").join(d, "dst").where("sl and dl").select("src", "dst", "sf", "df"), "kept")
        place = lambda c: F.xxhash64(c, F.lit(turn))
        lost = lambda a, b: F.col("sf") & F.col("df") & (place(a) >= place(b))
        ends = F.array(F.struct(F.col("src").alias("id"), F.col("sf").alias("free"), lost("src", "dst").alias("lost")), F.struct(F.col("dst").alias("id"), F.col("df").alias("free"), lost("dst", "src").alias("lost")))
        picked = cut(kept.select(F.inline(ends)).where("free").groupBy("id").agg(F.bool_or("lost").alias("lost")).where("not lost").select("id"), "picked")
        p, q = picked.select(F.col("id").alias("src"), F.lit(True).alias("sp")), picked.select(F.col("id").alias("dst"), F.lit(True).alias("dp"))
        kept = cut(kept.select("src", "dst").join(p, "src", "left").join(q, "dst", "left"), "kept")
        past = kept.where("dp").select(F.col("dst").alias("id"), F.col("src").alias("before")).join(kept.where("sp").select(F.col("src").alias("id"), F.col("dst").alias("after")), "id").where("before != after")
        arcs = cut(kept.where("sp is null and dp is null").select("src", "dst").unionAll(past.select("before", "after")).distinct(), "arcs")
        was, n, turn = n, arcs.count(), turn + 1
        if n > 0.95 * was:
            break
    return arcs.toDF("caller", "callee")


def reachable_among(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``a, b`` of all of the ``symbols`` (``id``) that reach each other by ``calls``, itself included, by an index of the calls
    ``between`` them alone."""
    asked = cut(symbols.select("id").distinct(), "asked")
    calls = between(calls, asked)
    components = cut(strong_components(calls), "components")
    # what calls no other and isn't called by one is a component of its own
    every = asked.join(components, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return reached_among(asked, every, reachability_labels(calls, components))


def call_cycles(calls: DataFrame, components: DataFrame) -> DataFrame:
    """``component, cycle_type, size, member``: mutual recursion and self-calls, a row for each symbol of a cycle."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    many = components.join(sizes, "component").select("component", F.lit("MutualRecursion").alias("cycle_type"), "size", F.col("id").alias("member"))
    own = calls.where("caller = callee").select("caller").distinct().select(F.col("caller").alias("component"), F.lit("SelfLoop").alias("cycle_type"), F.lit(1).cast("long").alias("size"), F.col("caller").alias("member"))
    return many.unionByName(own)


def condensation(calls: DataFrame, components: DataFrame) -> DataFrame:
    """``src, dst``: calls between different components, once each."""
    a, b = components.toDF("caller", "src"), components.toDF("callee", "dst")
    return calls.join(a, "caller").join(b, "callee").where("src != dst").select("src", "dst").distinct()


def component_ancestors(calls: DataFrame, symbol: DataFrame) -> DataFrame:
    """``id``: members of every other component that can reach the symbol's (``start``).

    Whatever reaches one member of a component reaches all, so these are all symbols that reach the given one, without those
    of its own component. The latter are what it reaches among the former, so that no other component need be known.
    """
    found = cut(reached(reversed_calls(calls), symbol), "ancestors")
    home = reached(calls.join(found.select(F.col("id").alias("callee")), "callee", "left_semi"), symbol)
    return found.join(home, "id", "left_anti")


def condensation_figures(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``supernodes, edges, largest``: how many components and calls between them there are, and the largest one's size."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("supernodes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    return _one_row(sizes, edges.agg(F.count("*").alias("edges"))).select("supernodes", "edges", "largest")


def _one_row(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each, side by side."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def call_paths(calls: DataFrame, entry: DataFrame, max_depth: int = 50, end: DataFrame | None = None, max_paths: int | None = None) -> DataFrame:
    """``path`` (array): simple call paths from the entries that end at an ``end`` symbol, or where none is given
    at a symbol without calls to others on the way, or at ``max_depth`` symbols; the first ``max_paths`` in order.

    All paths grow by a symbol at a time. Every beginning that is kept leads to some path, so that no more than the first
    ``max_paths`` of them are: without an ``end`` all do, with one those from which it can still be reached.
    """
    steps = calls.where("caller != callee").select("caller", "callee")
    if end is not None and max_depth > 0:
        return _paths_to(steps, entry, max_depth, end, max_paths)
    near = cut(steps.groupBy(F.col("caller").alias("node")).agg(F.collect_set("callee").alias("to")), "steps")
    live = _first(entry.select(F.array("start").alias("path")).distinct(), max_paths)
    found: list[DataFrame] = []
    depth, open_ = 1, max_depth > 0
    while open_:
        rounds = []
        for _ in range(HOPS):
            here = live.withColumn("node", F.element_at("path", -1)).join(near, "node", "left").select("path", F.expr("array_except(coalesce(to, cast(array() as array<bigint>)), path)" if depth < max_depth else "cast(array() as array<bigint>)").alias("next"))
            rounds.append(here.where("size(next) = 0").select("path", F.lit(False).alias("live")))
            live = _first(here.select("path", F.explode("next").alias("to")).select(F.concat("path", F.array("to")).alias("path")), max_paths)
            depth += 1
            if depth > max_depth:
                break
        if depth <= max_depth:
            rounds.append(live.select("path", F.lit(True).alias("live")))
        grown = cut(reduce(DataFrame.unionByName, rounds), "paths")
        found.append(grown.where("not live").select("path"))
        live = grown.where("live").select("path")
        open_ = depth <= max_depth and not live.isEmpty()
    return _first(reduce(DataFrame.unionByName, found), max_paths) if found else live.where("false")


def _first(paths: DataFrame, n: int | None) -> DataFrame:
    return paths if n is None else paths.orderBy("path").limit(n)


def nearest_ways(steps: DataFrame, goal: DataFrame, max_depth: int) -> DataFrame:
    """``node, chain`` (array): from each symbol the shortest way to a ``goal`` (``node``) of at most ``max_depth`` symbols."""
    state, depth = goal.select("node", F.array("node").alias("chain")).distinct().withColumn("new", F.lit(True)), 1
    while True:
        for _ in range(HOPS):
            to = state.join(steps, (F.col("node") == F.col("callee")) & F.col("new"), "left")
            own = F.struct("node", "chain", F.lit(True).alias("known"))
            sent = F.when(F.col("caller").isNotNull() & (F.size("chain") < max_depth), F.struct(F.col("caller").alias("node"), F.concat(F.array("caller"), "chain").alias("chain"), F.lit(False).alias("known")))
            rows = to.select(F.inline(F.array_compact(F.array(own, sent))))
            best = rows.groupBy("node").agg(F.min(F.struct(F.size("chain").alias("n"), "chain")).alias("x"), F.bool_or("known").alias("known"))
            state = best.select("node", "x.chain", (~F.col("known")).alias("new"))
            depth += 1
        state = cut(state, "ways")
        if depth >= max_depth or state.where("new").isEmpty():
            return state.drop("new")


#: Entries that are tried first for each path that is wanted, and by how much later rounds have more.
STARTS, MORE_STARTS = 10, 16


def _paths_to(steps: DataFrame, entry: DataFrame, max_depth: int, end: DataFrame, max_paths: int | None) -> DataFrame:
    """Simple paths to an ``end``, all or the first in order.

    The first paths in order begin at the least entries, so these are tried first, then more of them, until there are paths
    enough or no more entries. Only calls that the tried entries reach take part.
    """
    if max_paths is None:
        return _paths_among(steps, entry, max_depth, end.select(F.col("start").alias("node")).distinct(), None)
    starts, size = cut(entry.select("start").distinct(), "entries"), STARTS * max(1, max_paths)
    n = starts.count()
    while True:
        tried = cut(starts.orderBy("start").limit(size), "tried") if size < n else starts
        near = cut(reached(steps, tried, max_depth - 1), "near")
        ahead = cut(steps.join(near.select(F.col("id").alias("caller")), "caller", "left_semi").select("caller", "callee"), "ahead")
        goal = cut(end.select(F.col("start").alias("node")).distinct().join(near.select(F.col("id").alias("node")), "node", "left_semi"), "goal")
        found = _paths_among(ahead, tried, max_depth, goal, max_paths)
        if size >= n:
            return found
        found = cut(found, "found")
        if found.count() >= max_paths:
            return _first(found, max_paths)
        size *= MORE_STARTS


def _paths_among(steps: DataFrame, entry: DataFrame, max_depth: int, goal: DataFrame, max_paths: int | None) -> DataFrame:
    """Simple paths to a ``goal`` (``node``), level by level; of the beginnings of a level only those that lead on, the first in order.

    Where a symbol's nearest way to an end meets nothing that the beginning has been at, it leads on. Only the others, as far
    as they come before the last that is wanted, are followed from symbol to symbol, and only at levels of more beginnings
    than are wanted.
    """
    ways = nearest_ways(steps, goal, max_depth)
    ahead = ways.select(F.col("node").alias("callee"))
    near = cut(steps.join(ahead, "callee", "left_semi").groupBy(F.col("caller").alias("node")).agg(F.collect_set("callee").alias("to")), "steps")
    last = F.element_at("path", -1)
    live = cut(_first(entry.select(F.array("start").alias("path")).distinct().join(ways, last == F.col("node"), "left_semi"), max_paths), "paths")
    found = [live.join(goal, last == F.col("node"), "left_semi")]
    for _ in range(1, max_depth):
        next_ = live.join(near, last == F.col("node")).select("path", F.explode(F.expr("array_except(to, path)")).alias("node")).join(ways, "node")
        grown = next_.select(F.concat("path", F.array("node")).alias("path"), "chain").where(F.size("path") + F.size("chain") - 1 <= max_depth)
        grown = cut(grown.select("path", (F.size(F.array_intersect("path", "chain")) == 1).alias("sure")), "grown")
        n = grown.count()
        if not n:
            break
        if max_paths is None or n > max_paths:
            sure, doubt = _first(grown.where("sure").select("path"), max_paths), grown.where("not sure").select("path")
            n, most = sure.agg(F.count("*"), F.max("path")).first()
            doubt = doubt.where(F.col("path") < F.array(*map(F.lit, most))) if n and n == max_paths else doubt
            live = cut(_first(sure.union(_leading_on(doubt, near, goal, max_depth)), max_paths), "paths")
        else:
            live = grown.select("path")
        found.append(live.join(goal, last == F.col("node"), "left_semi"))
    return _first(reduce(DataFrame.unionByName, found), max_paths)


def _leading_on(paths: DataFrame, near: DataFrame, goal: DataFrame, max_depth: int) -> DataFrame:
    """The beginnings from which some goal is reached over other symbols, ``max_depth`` symbols in all at most."""
    if paths.isEmpty():
        return paths
    state, depth = paths.select("path", F.element_at("path", -1).alias("node"), F.lit(True).alias("new")), 0
    while True:
        for _ in range(HOPS):
            depth += 1
            sent = state.where("new").join(near, "node").where(F.size("path") + depth <= max_depth).select("path", F.explode(F.expr("array_except(to, path)")).alias("node"), F.lit(False).alias("known"))
            both = state.select("path", "node", F.lit(True).alias("known")).union(sent)
            state = both.groupBy("path", "node").agg((~F.bool_or("known")).alias("new"))
        state = cut(state, "reach")
        met = state.join(goal, "node", "left_semi").select("path").distinct()
        if state.where("new").join(met, "path", "left_anti").isEmpty():
            return met


def call_path_statistics(paths: DataFrame, max_paths: int) -> DataFrame:
    """``paths, shortest, longest, mean, symbols, truncated`` of the first ``max_paths``, given one more where there are more."""
    kept = paths.orderBy("path").limit(max_paths)
    figures = kept.agg(F.count("*").alias("paths"), F.min(F.size("path")).alias("shortest"), F.max(F.size("path")).alias("longest"), F.round(F.avg(F.size("path")), 6).alias("mean"))
    symbols = kept.select(F.explode("path").alias("id")).agg(F.countDistinct("id").alias("symbols"))
    more = paths.agg((F.count("*") > max_paths).alias("truncated"))
    return _one_row(figures, symbols, more)


def hotspots(calls: DataFrame, components: DataFrame, paths: DataFrame, top: int = 20) -> DataFrame:
    """``id, path_count, dominance, risk``: symbols on most call paths; members of large components weigh double."""
    counts = paths.select(F.explode("path").alias("id")).groupBy("id").agg(F.count("*").alias("path_count"))
    sizes = components.groupBy("component").agg(F.count("*").alias("dominance"))
    rows = counts.join(components, "id").join(sizes, "component")
    return rows.select("id", "path_count", "dominance", (F.col("path_count") + F.col("dominance") * 2.0).alias("risk")).orderBy(F.desc("risk"), "id").limit(top)


def hotspots_or(inter: DataFrame, intra: DataFrame) -> DataFrame:
    """``id, path_count, dominance, complexity, risk``: hotspots by calls, or where there are none those by flow
    (``flow.hotspots``), each with null for what it doesn't know."""
    own = inter.select("id", "path_count", "dominance", F.lit(None).cast("int").alias("complexity"), "risk")
    other = intra.select(F.col("function_id").alias("id"), "path_count", F.lit(None).cast("long").alias("dominance"), "complexity", "risk")
    return own if not own.isEmpty() else other
