"""SQL expressions over one function's row (``n, tags, kinds, succ, pred``): fixpoints as higher-order functions."""

from __future__ import annotations

EMPTY = "cast(array() as array<int>)"
EXITS = "filter(sequence(0, n - 1), x -> tags[x] in ('Return', 'Unreachable', 'Abort'))"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def closure(adjacent: str, seen: str, new: str, depth: int | None = None) -> str:
    """All that ``new`` leads to (in ``depth`` steps at most), and ``seen``, without going on from ``seen`` (sorted)."""
    step = let("found", f"array_except(array_distinct(flatten(transform(s.new, x -> {adjacent}[x]))), s.seen)", "named_struct('seen', concat(s.seen, found), 'new', found)")
    rounds = "sequence(1, n)" if depth is None else f"slice(sequence(1, n), 1, {depth})"
    return f"sort_array(aggregate({rounds}, named_struct('seen', {seen}, 'new', {new}), (s, i) -> if(size(s.new) = 0, s, {step}), s -> s.seen))"


REACH = closure("succ", "array(0)", "array(0)")


def dominated(tree: str, a: str, b: str) -> str:
    """Whether ``a`` dominates ``b`` (both reached), by places in the tree (``kernels.TREE``)."""
    return f"{tree}.enter[{b}] between {tree}.enter[{a}] and {tree}.enter[{a}] + {tree}.size[{a}] - 1"


def ancestors(tree: str, b: str) -> str:
    """The dominators of a reached block, from the root to the block itself: those before it whose subtree has it."""
    return f"filter(slice({tree}.order, 1, {tree}.enter[{b}]), y -> {tree}.enter[y] + {tree}.size[y] > {tree}.enter[{b}])"


#: Ends of edges back to a dominator, as struct(tail, header), by tail then header.
BACK_EDGES = f"flatten(transform(reach, t -> transform(filter(succ[t], h -> {dominated('dom', 'h', 't')}), h -> named_struct('tail', t, 'header', h))))"


def adjacency(pairs: str, a: str, b: str) -> str:
    """For each block the sorted ``b`` of the pairs with it as ``a``, from an array of structs: one sort and one pass."""
    tagged = f"sort_array(concat(transform(filter({pairs}, x -> x.{a} between 0 and n - 1), x -> named_struct('a', x.{a}, 'b', x.{b})), transform(sequence(0, n - 1), i -> named_struct('a', i, 'b', -1))))"
    own = "transform(starts, (s, i) -> transform(slice(p, s + 2, coalesce(get(starts, i + 1), size(p)) - s - 1), x -> x.b))"
    return let("p", tagged, let("starts", "filter(sequence(0, size(p) - 1), k -> p[k].b = -1)", own))


#: Kind of a walk by the blocks on it; the last block alone can be an exit.
WALK_KIND = (
    "case when exists(blocks, b -> tags[b] = 'Call' and unwinds[b]) then 'Error' when tags[element_at(blocks, -1)] = 'Abort' then 'Error' "
    "when tags[element_at(blocks, -1)] = 'Unreachable' then 'Degenerate' when kinds[0] != 'Entry' or tags[element_at(blocks, -1)] in ('Goto', 'SwitchInt') then 'Degenerate' else 'Normal' end"
)
#: Whether a walk can be run to its end: from an entry, over reached blocks, to a block that can be left for good.
FEASIBLE = (
    "coalesce(get(kinds, get(blocks, 0)) = 'Entry' and forall(blocks, b -> array_contains(reach, b)) and (get(tags, try_element_at(blocks, -1)) in ('Return', 'Abort') "
    "or get(tags, try_element_at(blocks, -1)) = 'Call' and (not get(unwinds, try_element_at(blocks, -1)) or get(calls, try_element_at(blocks, -1)))), false)"
)
PATH_ID = "sha2(concat_ws(',', cast(size(blocks) as string), transform(blocks, b -> cast(b as string))), 256)"
ARROWS = "array_join(transform(blocks, b -> cast(b as string)), '->')"
#: Colours of edges in Graphviz.
EDGE_COLOURS = "map('TrueBranch', 'green', 'FalseBranch', 'red', 'Fallthrough', 'black', 'LoopBack', 'blue', 'LoopExit', 'orange', 'Exception', 'purple', 'Call', 'gray', 'Return', 'darkgray')"
#: Kind of a given path, of which nothing is known: the first block that is wrong decides, then how it ends.
GIVEN_KIND = (
    "coalesce(get(array_compact(transform(blocks, b -> case when n is null or b is null or b < 0 or b >= n then 'Degenerate' when not array_contains(reach, b) then 'Unreachable' "
    "when tags[b] = 'Abort' or tags[b] = 'Call' and unwinds[b] then 'Error' when tags[b] = 'Unreachable' then 'Degenerate' end)), 0), "
    "if(get(tags, try_element_at(blocks, -1)) = 'Return', 'Normal', 'Degenerate'), 'Degenerate')"
)
