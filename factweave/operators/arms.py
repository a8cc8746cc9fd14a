"""How the two arms of each decision of a method end, and why that cannot be told where it cannot.

Input is a method's flow graph: nodes(method, node, kind), edges(method, source, target, kind), loops(method, loop, header, node, role) with
the nodes of each loop (Body, without the header) and those behind it (Exit), and regions(method, node, kind) with the regions that hold
a node. A method is bounded by its source: its rows are dealt to one task, and each arm is walked there; no step is a job of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow

# Edges that a walk follows, regions of exception handling, edges into them, and what ends or rejoins.
FOLLOWED = ("Normal", "True", "False", "Return", "Throw", "Rethrow")
HANDLERS = ("Catch", "Filter", "Finally")
HANDLER_EDGES = ("ExceptionHandler", "Filter", "Finally")
LEAVING = ("Return", "Throw", "Rethrow")


class Withheld(Exception):
    """Carries the reason for which an arm is not classified."""


class Method:
    """The flow graph of one method, from its tagged rows."""

    def __init__(self, rows: list[tuple]):
        self.kind: dict[int, str] = {}
        self.edges: dict[int, list[tuple[int, str]]] = {}
        self.regions: dict[int, set[str]] = {}
        loops: dict[int, tuple[int, set[int], set[int]]] = {}
        for tag, a, b, c, kind in rows:
            if tag == 0:
                self.kind.setdefault(int(a), kind)
            elif tag == 1:
                self.edges.setdefault(int(a), []).append((int(b), kind))
            elif tag == 2:
                _, body, exits = loops.setdefault(int(c), (int(a), set(), set()))
                if b is not None:
                    (body if kind == "Body" else exits).add(int(b))
            else:
                self.regions.setdefault(int(a), set()).add(kind)
        self.loops: dict[int, tuple[set[int], set[int]]] = {}
        for loop in sorted(loops):  # of several loops with one header the first counts
            header, body, exits = loops[loop]
            self.loops.setdefault(header, (body, exits))

    def handles(self, node: int) -> bool:
        return any(k in HANDLERS for k in self.regions.get(node, ()))

    def admit(self, decision: int, polarity: str) -> int:
        """The first node of an arm; Withheld if the decision itself cannot be told."""
        own, out = self.loops.get(decision), self.edges.get(decision, [])
        back = [t for t, k in out if k == "LoopBack"]
        if back and own is None:
            raise Withheld("loop-back")
        if any(t != decision for t in back):
            raise Withheld("foreign-loop-back")
        mine = [t for t, k in out if k == polarity]
        if len(mine) > 1 or any(k in ("SwitchCase", "SwitchDefault") for _, k in out):
            raise Withheld("switch")
        # A loop's header may lie in any region but a handler's, another decision in none but a try's.
        if self.handles(decision) or (own is None and any(k not in ("Root", "Try") for k in self.regions.get(decision, ()))):
            raise Withheld("exception-region")
        if not mine:
            raise Withheld("missing-arm-edge")
        if any(k in HANDLER_EDGES for _, k in out):
            raise Withheld("exception-edge")
        return mine[0]

    def ends(self, decision: int, polarity: str) -> str:
        """Terminates or Rejoins if every way of the arm does; else Withheld."""
        own, todo, seen, found = self.loops.get(decision), [self.admit(decision, polarity)], set(), set()
        while todo:
            node = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            if node not in self.kind:
                raise Withheld("missing-node")
            if self.handles(node):
                raise Withheld("exception-region-target")
            kind, out = self.kind[node], sorted(self.edges.get(node, []))
            if kind in ("Exit", "Decision"):
                if own is not None and node not in own[1]:
                    raise Withheld("mismatched-exit")
                found.add("Rejoins")
                continue
            if kind == "Loop":
                raise Withheld("loop")
            if kind in ("Return", "Throw"):
                if any(self.handles(t) for t, _ in out):
                    raise Withheld("exception-boundary-target")
                if any(k not in LEAVING for _, k in out):
                    raise Withheld("operation-derived-duplicate-terminal")
                found.add("Terminates")
                continue
            # The way back to the decision's own loop is an iteration; any other way back is not followed.
            again = [(t, k) for t, k in out if k == "LoopBack" and own is not None and t == decision]
            odd = [k for t, k in out if k not in FOLLOWED and (t, k) not in again]
            if odd:
                raise Withheld(f"unsupported-edge:{odd[0]}")
            if again:
                if node not in own[0]:
                    raise Withheld("foreign-body-source")
                found.add("Rejoins")
            todo += [t for t, k in out if (t, k) not in again]
        if not found:
            raise Withheld("no-reachable-boundary")
        if len(found) > 1:
            raise Withheld("mixed-boundary")
        return found.pop()


def _classify(rows: list[tuple]) -> list[tuple]:
    method, out = Method(rows), []
    for decision in sorted(n for n, k in method.kind.items() if k == "Decision"):
        for arm in (True, False):
            try:
                out.append((decision, arm, method.ends(decision, str(arm)), None))
            except Withheld as why:
                out.append((decision, arm, "Unknown", why.args[0]))
    return out


def arm_terminals(nodes: DataFrame, edges: DataFrame, loops: DataFrame, regions: DataFrame) -> DataFrame:
    """(method, decision, arm, terminal, reason) for both arms of every node of kind Decision.

    Terminates if every way through the arm returns or throws, Rejoins if every way comes to the exit, to another decision or
    back to the decision's own loop header; else Unknown, with the first reason met. Ways meet exits and decisions of a loop's header only
    where the loop says that it is left.
    """
    far = lambda rows, tag, a, b, c, kind: rows.select("method", F.lit(tag).alias("tag"), *[(F.col(x) if x else F.lit(None)).cast("long").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"))], F.col(kind).alias("kind"))
    tagged = far(nodes, 0, "node", None, None, "kind").unionAll(far(edges, 1, "source", "target", None, "kind"))
    tagged = tagged.unionAll(far(loops, 2, "header", "node", "loop", "role")).unionAll(far(regions, 3, "node", None, None, "kind"))
    return flow.walk_methods(tagged, ["tag", "a", "b", "c", "kind"], ["tag", "a", "b", "c", "kind"], _classify, "decision long, arm boolean, terminal string, reason string")


def block_terminals(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """arm_terminals() of blocks as flow.edges() takes them and regions(method, start_block, end_block, kind), each method in one walk.

    A block with both successors decides, the last one is the exit; edges are those of flow.edges(), loops the natural ones.
    """
    whole = lambda c: F.col(c).cast("long")
    none = F.lit(None).cast("long")
    rows = blocks.select("method", F.lit(0).alias("tag"), whole("ord").alias("a"), whole("n").alias("b"), whole("cond_succ").alias("c"), whole("fall").alias("d"), F.col("terminal").alias("kind"))
    rows = rows.unionAll(regions.select("method", F.lit(1), whole("start_block"), whole("end_block"), none, none, "kind"))
    columns = ["tag", "a", "b", "c", "d", "kind"]
    return flow.walk_methods(rows, columns, columns[:2], lambda found: _classify(_graph(found)), "decision long, arm boolean, terminal string, reason string")


def _graph(found: list[tuple]) -> list[tuple]:
    """The rows of Method from a method's blocks and regions."""
    number = lambda v: None if v is None else int(v)
    body = [(int(a), int(b), kind, number(c), number(d)) for tag, a, b, c, d, kind in found if tag == 0]
    if not body:
        return []
    g = flow.graph_of(body)
    back = flow.back_edges_of(g)
    looped = set(back)
    nodes, out = [(0, g[0], None, None, "Exit")], []
    for o, n, terminal, cond, fall in body:
        ends = terminal in LEAVING
        nodes.append((0, o, None, None, "Decision" if cond is not None and fall is not None else "Return" if terminal == "Return" else "Throw" if ends else "Block"))
        for target, kind in ((cond, "True"), (fall, "False" if terminal == "Conditional" else "Normal")):
            if target is not None:
                out.append((1, o, target, None, terminal if ends else "LoopBack" if (o, target) in looped else kind))
        if fall is None and terminal in ("Throw", "Rethrow"):
            out.append((1, o, n, None, terminal))
    for latch, header in sorted(back, key=lambda e: (e[1], e[0])):
        inside = flow.loop_body(g, latch, header)
        out += [(2, header, k if k != header else None, latch, "Body") for k in inside]
        out += [(2, header, k, latch, "Exit") for k in {x for k in inside for x in g[1][k]} - inside]
    for tag, start, end, _, _, kind in found:
        if tag == 1 and start is not None and end is not None:
            out += [(3, node, None, None, kind) for _, node, *_ in nodes if start <= node <= end]
    return nodes + out
