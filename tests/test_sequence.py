"""Sequence trees as diagrams, on hand-built plans, all of which are drawn in one run."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import render, sequence

PEOPLE = "plan string, place long, key string, label string"
MESSAGE = "plan string, message long, source string, target string, label string, kind string, place long"
ELEMENT = "plan string, element long, parent long, place long, kind string, label string, is_else boolean, message long"
BRANCH = "plan string, place long, label string, message long"
TOLD = {1: ("client", "service", "GET api/Test", "Request"), 2: ("service", "client", "Inside -> HTTP 200", "Response"), 3: ("service", "client", "Ok -> HTTP 200", "Response")}
GET, INSIDE, OK = "client->>service: GET api/Test", "service-->>client: Inside -> HTTP 200", "service-->>client: Ok -> HTTP 200"


def ref(element, parent, place, message):
    return element, parent, place, "message", None, None, message


def block(element, parent, place, kind, label, is_else=None):
    return element, parent, place, kind, label, is_else, None


def arms(label, is_else):
    """An alt A whose first shown arm has this label; its second is C, and one between them is empty."""
    return [block(1, None, 0, "alt", "A"), block(2, 1, 5, "arm", "C", True), ref(3, 2, 0, 3), block(4, 1, 1, "arm", label, is_else), ref(5, 4, 0, 2), block(6, 1, 3, "arm", "empty", True)]


def shown(*extra):
    return ["    alt A", *extra, f"      {INSIDE}", "    else C", f"      {OK}", "    end"]


# Of each plan its elements, branches, messages, and the lines below the participants, or the code that withholds it.
CASES = {
    "loop": ([ref(1, None, 0, 1), block(2, None, 1, "loop", 'Retry "max"\r\nn=3'), ref(3, 2, 0, 2), ref(4, None, 2, 3)], [], TOLD, [f"    {GET}", "    loop Retry #quot;max#quot; n=3", f"      {INSIDE}", "    end", f"    {OK}"]),
    # Of the outer alt only the second arm, of the inner one only the first, has anything to show.
    "one arm": ([block(1, None, 0, "alt", "Decision"), block(2, 1, 0, "arm", "Decision", False), block(3, 1, 1, "arm", "Other", True), block(4, 3, 0, "alt", "Inner"), block(5, 4, 0, "arm", "Other", False), block(6, 4, 1, "arm", "Never", True), ref(7, 5, 0, 3)], [], TOLD,
                ["    opt Other", "      opt Other", f"        {OK}", "      end", "    end"]),
    "first arm": (arms("A", False), [], TOLD, shown()),
    "else first": (arms("B", True), [], TOLD, shown("    else B")),
    "else of the same label": (arms("A", True), [], TOLD, shown()),
    "breaks and empty blocks": ([block(1, None, 0, "break", "Path terminates"), ref(2, 1, 0, 2), block(3, None, 1, "opt", "outer"), block(4, 3, 0, "break", "x"), ref(5, 4, 0, 3), block(6, None, 2, "loop", "none"), ref(7, None, 3, 1)], [], TOLD, [f"    {GET}"]),
    "lost reference": ([block(1, None, 0, "opt", "o"), ref(2, 1, 0, 2), ref(3, 1, 1, 99)], [], TOLD, "UnresolvedReference"),
    "lost reference alone": ([ref(1, None, 0, 99)], [], TOLD, "UnresolvedReference"),
    # Alone in its block, or behind a break, such a reference is never reached.
    "lost in an empty block": ([block(1, None, 0, "opt", "o"), ref(2, 1, 0, 99), ref(3, None, 1, 1)], [], TOLD, [f"    {GET}"]),
    "lost in a break": ([block(1, None, 0, "break", "o"), ref(2, 1, 0, 99), ref(3, None, 1, 1)], [], TOLD, [f"    {GET}"]),
    "ring": ([block(1, 2, 0, "opt", "a"), block(2, 1, 0, "opt", "b"), ref(3, None, 0, 1)], [], TOLD, "Unreached"),
    "branches": ([], [(0, "success path", 3), (1, 'other "path"', 2), (1, 'other "path"', 77)], TOLD, [f"    {GET}", "    alt success path", f"        {OK}", "    else other #quot;path#quot;", f"        {INSIDE}", "    end"]),
    "nothing": ([], [], (), []),
}


@pytest.fixture(scope="module")
def drawn(spark):
    people = spark.createDataFrame([(p, *who) for p in CASES for who in ((0, "client", "Client"), (1, "service", "GadgetService"))], PEOPLE)
    messages = spark.createDataFrame([(p, m, *TOLD[m], m) for p, case in CASES.items() for m in case[2]], MESSAGE)
    elements = spark.createDataFrame([(p, *e) for p, case in CASES.items() for e in case[0]], ELEMENT)
    branches = spark.createDataFrame([(p, *b) for p, case in CASES.items() for b in case[1]], BRANCH)
    lines, codes = sequence.diagram_lines(people, messages, elements, branches)
    text = sequence.diagram_text(lines).withColumn("errors", F.size(render.diagram_errors(F.col("diagram")))).collect()
    assert all(r.errors == 0 for r in text)
    head = ["sequenceDiagram", "    participant client as Client", "    participant service as GadgetService"]
    found = {r.plan: r.diagram.split("\n") for r in text}
    assert all(x[:3] == head for x in found.values())
    return {p: x[3:] for p, x in found.items()} | {r.plan: r.code for r in codes.collect()}


@pytest.mark.parametrize("plan", CASES)
def test_diagram(drawn, plan):
    assert drawn[plan] == CASES[plan][3]


def test_no_plans(spark):
    tables = [spark.createDataFrame([], s) for s in (PEOPLE, MESSAGE, ELEMENT, BRANCH)]
    lines, codes = sequence.diagram_lines(*tables)
    assert lines.count() == 0 and codes.count() == 0
