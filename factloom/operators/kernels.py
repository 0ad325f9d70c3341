"""Algorithms on the flow graph of one function. They run inside a grouped map: a function is a
bounded group, and its whole graph fits a task many times over."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

EXIT = -1
Adj = dict[int, list[int]]


def adjacency(edges: Iterable[tuple[int, int]]) -> tuple[Adj, Adj]:
    """(successors, predecessors), sorted and without repeats."""
    suc: dict[int, set[int]] = defaultdict(set)
    pre: dict[int, set[int]] = defaultdict(set)
    for a, b in edges:
        suc[a].add(b)
        pre[b].add(a)
    return {k: sorted(v) for k, v in suc.items()}, {k: sorted(v) for k, v in pre.items()}


def reachable(suc: Adj, start: int) -> set[int]:
    """Nodes on a path of one edge or more from start."""
    seen: set[int] = set()
    todo = deque(suc.get(start, ()))
    while todo:
        x = todo.popleft()
        if x not in seen:
            seen.add(x)
            todo.extend(suc.get(x, ()))
    return seen


def reverse_postorder(suc: Adj, root: int) -> list[int]:
    out, seen, stack = [], {root}, [(root, iter(suc.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(suc.get(nxt, ()))))
                break
        else:
            out.append(node)
            stack.pop()
    return out[::-1]


def immediate_dominators(suc: Adj, pre: Adj, root: int) -> dict[int, int]:
    """Node to immediate dominator for nodes reachable from the root, which has none. Finger
    intersection over reverse postorder numbers until nothing changes."""
    order = reverse_postorder(suc, root)
    at = {n: i for i, n in enumerate(order)}
    dom: list[int | None] = [None] * len(order)
    dom[0] = 0
    changed = True
    while changed:
        changed = False
        for i in range(1, len(order)):
            new = None
            for p in pre.get(order[i], ()):
                j = at.get(p)
                if j is None or dom[j] is None:
                    continue
                if new is None:
                    new = j
                    continue
                while new != j:
                    if new > j:
                        new = dom[new]
                    else:
                        j = dom[j]
            if new != dom[i]:
                dom[i], changed = new, True
    return {order[i]: order[d] for i, d in enumerate(dom) if i and d is not None}


def ancestors(idom: dict[int, int], node: int) -> list[int]:
    """Strict dominators, nearest first."""
    out = []
    while node in idom:
        node = idom[node]
        out.append(node)
    return out


def control_dependences(edges: Iterable[tuple[int, int]], ipdom: dict[int, int], compat: bool = False) -> set[tuple[int, int]]:
    """(block, branch block it depends on). For an edge m -> n where n does not postdominate m,
    n and its postdominators up to but excluding m's depend on m. ``compat`` keeps all
    postdominators of n except m's nearest common one."""
    out = set()
    for m, n in edges:
        up_m = ancestors(ipdom, m)
        if n in up_m or n == EXIT:
            continue
        chain = [n, *ancestors(ipdom, n)]
        stop = up_m[0] if up_m else None
        for x in chain:
            if not compat and x == stop:
                break
            if x != EXIT and not (compat and x == stop):
                out.add((x, m))
    return out


class Environment:
    """What the transfers of one function may read, write and keep: rows of relations, rows of their
    own, and a dict that lives as long as the function's analysis.

    An analysis asks its transfers again and again until facts settle. What they write on the way is
    forgotten; only a last pass from the settled facts is written down, each row once."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.kept: dict = {}
        self._by: dict[tuple[str, ...], dict[tuple, list[dict]]] = {}
        self._told: dict[tuple, None] | None = None

    def ask(self, **key) -> list[dict]:
        """The rows with these values in these columns."""
        names = tuple(sorted(key))
        if names not in self._by:
            index = self._by[names] = defaultdict(list)
            for r in self.rows:
                index[tuple(r[n] for n in names)].append(r)
        return self._by[names].get(tuple(key[n] for n in names), [])

    def tell(self, *row) -> None:
        if self._told is not None:
            self._told[row] = None

    def settled(self, replay: Callable[[], None]) -> list[tuple]:
        """What is written during a last pass."""
        self._told = {}
        replay()
        told, self._told = list(self._told), None
        return told


@dataclass
class Dataflow:
    """A monotone analysis: a lattice by ``top`` and ``meet`` (meet(a, top) = a, finite height),
    the fact at the start, and a transfer for each instruction. ``edge`` may give, for a
    terminator, facts of single successors; those it leaves out get the plain result, those
    that are no successors are discarded, and repeated ones are met. Backward analyses start
    at the virtual exit; there ``edge`` is asked with the fact of each successor and says what
    of it goes back over the edge. Transfers may read and write an Environment."""

    top: Any
    start: Any
    meet: Callable[[Any, Any], Any]
    transfer: Callable[[Any, Any], Any]
    edge: Callable[[Any, Any], list[tuple[int, Any]]] | None = None
    forward: bool = True

    def solve(self, blocks: dict[int, list[Any]], suc: Adj, pre: Adj, entry: int) -> dict[int, Any]:
        """Facts at the entry of each visited block (forward) or at its start after the block has
        been run backward; the virtual exit is a block without instructions."""
        return self._forward(blocks, suc, entry) if self.forward else self._backward(blocks, suc, pre)

    def _forward(self, blocks, suc, entry):
        fact, todo, queued = {entry: self.start}, deque([entry]), {entry}
        while todo:
            b = todo.popleft()
            queued.discard(b)
            out = fact[b]
            for i in blocks.get(b, ()):
                out = self.transfer(out, i)
            to = suc.get(b, [])
            give: dict[int, Any] = {}
            if self.edge and blocks.get(b):
                for t, f in self.edge(out, blocks[b][-1]):
                    if t in to:
                        give[t] = self.meet(give[t], f) if t in give else f
            for t in to:
                new = give.get(t, out)
                old = fact.get(t)
                if old is not None:
                    new = self.meet(old, new)
                if old is None or new != old:
                    fact[t] = new
                    if t not in queued:
                        queued.add(t)
                        todo.append(t)
        return fact

    def _backward(self, blocks, suc, pre):
        fact, todo = {EXIT: self.start}, deque(pre.get(EXIT, ()))
        while todo:
            b = todo.popleft()
            new = self._below(b, fact, blocks, suc)
            for i in reversed(blocks.get(b, [])):
                new = self.transfer(new, i)
            if b not in fact or fact[b] != new:
                fact[b] = new
                todo.extend(pre.get(b, ()))
        return fact

    def _below(self, b, fact, blocks, suc):
        """The fact under a block's last instruction, from its successors' facts."""
        new = self.top
        for t in suc.get(b, ()):
            if t in fact:
                given = [f for x, f in self.edge(fact[t], blocks[b][-1]) if x == t] if self.edge and blocks.get(b) else []
                for f in given or [fact[t]]:
                    new = self.meet(new, f)
        return new

    def replay(self, blocks: dict[int, list[Any]], facts: dict[int, Any], suc: Adj) -> None:
        """Runs each visited block once from the settled facts, for what transfers write."""
        for b, body in blocks.items():
            if b in facts:
                after = self.at(blocks, facts, suc, b)
                if self.edge and self.forward and body:
                    self.edge(after[-1], body[-1])

    def at(self, blocks: dict[int, list[Any]], facts: dict[int, Any], suc: Adj, block: int) -> list[Any]:
        """The fact after each instruction of a block (for backward ones: above it); top in a block
        that was never visited."""
        out = []
        if self.forward:
            f = facts.get(block)
            for i in blocks[block]:
                f = self.top if f is None else self.transfer(f, i)
                out.append(f)
            return out
        f = self._below(block, facts, blocks, suc)
        for i in reversed(blocks[block]):
            f = self.transfer(f, i) if block in facts else self.top
            out.append(f)
        return out[::-1]
