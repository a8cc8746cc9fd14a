"""Predicate trees as adjacency rows, admitted by types and operators, and folded to canonical and to readable text.

Rows: tree, node, parent (null at the root), place (among siblings), kind (constant, parameter, local, member, opaque, unary,
binary), operator, type (of a leaf), constant (a constant's value or a symbol's name; null for the constant null). A tree is one condition
of a program and so small: rows are numbered within their tree and folded as they pass, which takes one shuffle whatever their depth, or
none where they lie together already. Trees
deeper than MAX_DEPTH, without exactly one root or with nodes that the root does not reach (a cycle) are withheld with
PRED003; those with an unknown kind, a wrong number of operands, or an operator that is not admitted for the types of its
operands with PRED001.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 64
# Kinds of nodes with their number of operands, and how tightly operators bind.
OPERANDS = {"parameter": 0, "local": 0, "member": 0, "opaque": 0, "constant": 0, "unary": 1, "binary": 2}
PRECEDENCE = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "!": 7}
# Names of operators in canonical text, and types by what may be done with them.
COMPARISONS = {"==": "Equal", "!=": "NotEqual", "<": "LessThan", "<=": "LessThanOrEqual", ">": "GreaterThan", ">=": "GreaterThanOrEqual"}
ARITHMETIC = {"+": "Add", "-": "Subtract", "*": "Multiply", "/": "Divide", "%": "Remainder"}
NUMERIC = frozenset(f"System.{t}" for t in ("SByte", "Byte", "Int16", "UInt16", "Int32", "UInt32", "Int64", "UInt64", "Single", "Double", "Decimal"))
BOOLEAN, STRING, CHARACTER, TIME = "System.Boolean", "System.String", "System.Char", "System.DateTime"
LEAF = 9


class Malformed(Exception):
    """Carries the code for which a tree is withheld."""


@lru_cache(maxsize=4096)
def result_type(operator: str | None, operands: tuple[tuple[str, bool], ...]) -> str:
    """The type of an operation on operands (type, whether the constant null); Malformed if it is not admitted.

    Both operands have one type. And, or and not take booleans; numbers, booleans, characters, times and enumerations compare in
    every way, strings for equality, and anything with null for equality; numbers add up.
    """
    types = {t for t, null in operands if not null}
    one = next(iter(types)) if len(types) == 1 else None
    if len(operands) == 1 or operator in ("&&", "||"):
        if operator in ("!", "&&", "||") and (operator == "!") == (len(operands) == 1) and types == {BOOLEAN} and not any(n for _, n in operands):
            return BOOLEAN
    elif operator in ("==", "!=") and any(n for _, n in operands):
        return BOOLEAN
    elif operator in COMPARISONS and one is not None and not any(n for _, n in operands) and (one != STRING or operator in ("==", "!=")):
        return BOOLEAN
    elif operator in ARITHMETIC and one in NUMERIC and not any(n for _, n in operands):
        return one
    raise Malformed("PRED001")


def leaf_kind(kind: str, type_: str | None, value: str | None) -> str:
    """What a leaf is called in canonical text; numbers that are not finite, and names that are missing, are not admitted."""
    if not type_ or (kind != "constant" and not value):
        raise Malformed("PRED001")
    if kind != "constant":
        return "opaque" if kind == "opaque" else "sym"
    if value is None:
        return "null"
    if type_ in NUMERIC:
        try:
            if math.isfinite(float(value)):
                return "num"
        except ValueError:
            pass
        raise Malformed("PRED001")
    return {BOOLEAN: "bool", STRING: "str", CHARACTER: "chr"}.get(type_, "enum")


def _fold(nodes: DataFrame, make) -> DataFrame:
    """(tree, text, code); make(kind, operator, type, constant, operands, is_root) gives a node's (text, rank); operands are such pairs."""

    columns = ["ordinal", "tree", "node", "parent", "kind", "operator", "type", "constant"]

    def whole(rows: list[tuple]) -> str:
        below: dict = {}
        for row in rows:
            below.setdefault(row[3], []).append(row)
        seen = 0

        def text(row: tuple, depth: int):
            """(text, rank), and (type, whether null) of a node."""
            nonlocal seen
            seen += 1
            _, _, node, _, kind, operator, type_, constant = row
            kids = below.get(node, ())
            if len(kids) != OPERANDS.get(kind):
                raise Malformed("PRED001")
            if depth >= MAX_DEPTH:
                raise Malformed("PRED003")
            if not kids:
                kind = leaf_kind(kind, type_, constant)
                return make(kind, operator, type_, constant, (), depth == 0), (type_, kind == "null")
            found = [text(k, depth + 1) for k in kids]
            type_ = result_type(operator, tuple([t for _, t in found]))
            return make("operation", operator, type_, constant, [x for x, _ in found], depth == 0), (type_, False)

        roots = below.get(None, ())
        if len(roots) != 1:
            raise Malformed("PRED003")
        out = text(roots[0], 0)[0][0]
        if seen != len(rows):
            raise Malformed("PRED003")
        return out

    def fold(rows: list[tuple]) -> tuple:
        try:
            return rows[0][1], whole(rows), None
        except Malformed as e:
            return rows[0][1], None, e.args[0]

    def told(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[k] for row in done], t) for k, t in enumerate((kind, pa.string(), pa.string()))], ["tree", "text", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the tree that the last batch may have cut
        kind = None
        for batch in batches:
            done, kind = [], batch.column("tree").type
            # Whole numbers stay such beside nulls.
            for row in zip(*(batch.column(c).to_pandas(integer_object_nulls=True).tolist() for c in columns)):
                if row[0] == 1 and held:
                    done.append(fold(held))
                    held = []
                held.append(row)
            yield told(done, kind)
        if held:
            yield told([fold(held)], kind)

    kind = nodes.schema["tree"].dataType.simpleString()
    rows = nodes.withColumn("ordinal", F.row_number().over(Window.partitionBy("tree").orderBy("parent", "place", "node")))
    return rows.sortWithinPartitions("tree", "parent", "place", "node").select(*columns).mapInArrow(run, f"tree {kind}, text string, code string")


def framed(text: str) -> str:
    return f"{len(text)}:{text}"


def canonical(nodes: DataFrame) -> DataFrame:
    """Each node as kind(length:type,...), so that no two trees share a text; a boolean symbol that is the whole condition is a truth."""

    def make(kind, operator, type_, constant, operands, is_root):
        below = ",".join(t for t, _ in operands)
        if operator in COMPARISONS and operands:
            return f"cmp({framed(type_)},{framed(COMPARISONS[operator])},{below})", 0
        if operator in ARITHMETIC and operands:
            return f"arith({framed(type_)},{framed(ARITHMETIC[operator])},{below})", 0
        if operands:
            return f"{ {'!': 'neg', '&&': 'and', '||': 'or'}[operator] }({framed(type_)},{below})", 0
        value = constant.lower() if kind == "bool" else constant
        text = f"{kind}({framed(type_)})" if kind == "null" else f"{kind}({framed(type_)},{framed(value)})"
        return (f"truth({framed(BOOLEAN)},{text})" if is_root and kind == "sym" and type_ == BOOLEAN else text), 0

    return _fold(nodes, make)


def readable(nodes: DataFrame) -> DataFrame:
    """Infix text with brackets only where an operand binds less tightly than its operator."""

    def make(kind, operator, type_, constant, operands, is_root):
        if not operands:
            return "null" if kind == "null" else constant, LEAF
        rank = PRECEDENCE[operator]
        # The right operand needs brackets at equal rank too, as operators associate to the left.
        parts = [f"({t})" if r < rank or (r == rank and k) else t for k, (t, r) in enumerate(operands)]
        return f"{operator}{parts[0]}" if len(parts) == 1 else f"{parts[0]} {operator} {parts[1]}", rank

    return _fold(nodes, make)
