"""Chains of receivers: which calls a call is made on, from the first to the last, by pointer doubling.

links(method, node, receiver) name the one receiver of a node. Tables of jumps of 1, 2, 4, ... receivers are joined from one another, so a
chain of n calls takes log2(n) rounds; every start then meets all that is above it by one join for each table. What still jumps after as many
receivers as its method has nodes goes in a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frameworks
from .calls import cut


def ancestors(starts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((method, start, node, up), (method, start)): all nodes on the way up from starts(method, start), the start itself at up 0, and the starts that end in a circle.

    A node of several receivers has none. A start may be no node of links; a receiver that is none itself ends the way.
    """
    one = links.where("receiver is not null").distinct().groupBy("method", "node").agg(F.count("*").alias("n"), F.min("receiver").alias("target")).where("n = 1").drop("n")
    jumps = [cut(one)]
    most = jumps[0].groupBy("method").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        step = jumps[-1]
        further = step.join(step.select("method", F.col("node").alias("target"), F.col("target").alias("next")), ["method", "target"])
        further = cut(further.select("method", "node", F.col("next").alias("target"))).toDF("method", "node", "target")
        if further.isEmpty():
            break
        jumps.append(further)
        if 2 ** (len(jumps) - 1) > most:
            break
    endless = jumps.pop() if 2 ** (len(jumps) - 1) > most else None
    starts = starts.select("method", "start").distinct()
    if endless is None:
        circles = starts.limit(0)
    else:
        circles = starts.join(endless.select("method", F.col("node").alias("start")).distinct(), ["method", "start"], "left_semi")
        starts = starts.join(circles, ["method", "start"], "left_anti")
    found = starts.select("method", "start", F.col("start").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        # Every distance is a sum of different powers of two, so each node above is met once.
        more = found.join(jumps[k], ["method", "node"]).select("method", "start", F.col("target").alias("node"), (F.col("up") + 2**k).alias("up"))
        found = cut(found.unionAll(more)).toDF("method", "start", "node", "up")
    return found, circles


def query_steps(terminals: DataFrame, calls: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((method, terminal, place, op, name), (method, terminal, member, entity, steps)) of terminals(method, op).

    calls(method, op, receiver, name) are invocations, members(method, op, member, entity) the properties and fields on which a query begins. The
    steps are the calls between, from the member on, without the terminal itself. A chain that begins with anything else, or goes in a
    circle, is withheld: it has no row.
    """
    starts = terminals.select("method", F.col("op").alias("start"))
    found, _ = ancestors(starts, calls.select("method", F.col("op").alias("node"), "receiver"))
    base = members.select("method", F.col("op").alias("node"), "member", "entity").dropDuplicates(["method", "node"])
    begins = found.where("up > 0").join(base, ["method", "node"]).groupBy("method", "start").agg(F.min(F.struct("up", "member", "entity")).alias("b")).select("method", "start", "b.*")
    # A member ends the walk, whatever lies above it.
    steps = found.join(begins.select("method", "start", F.col("up").alias("length")), ["method", "start"]).where("up > 0 and up < length")
    steps = steps.join(calls.select("method", F.col("op").alias("node"), "name"), ["method", "node"])
    placed = steps.select("method", F.col("start").alias("terminal"), (F.col("length") - 1 - F.col("up")).alias("place"), F.col("node").alias("op"), "name")
    return placed, begins.select("method", F.col("start").alias("terminal"), "member", "entity", (F.col("up") - 1).alias("steps"))


def minimal_routes(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """(method, op, verb, route, operation_key, code) of maps(method, op, member, receiver, route, handler).

    member is MapGet, MapPost, MapPut or MapDelete; groups(method, op, receiver, prefix, exact) are the groups that maps and groups are made on, from
    the application (a null receiver) inwards. The route is every prefix, the outermost first, and the map's own. The first reason that holds withholds
    a map: group (a step that is not exact, is not known, or a circle), callback (no handler), route (no literal one, or a blank).
    """
    known = groups.select("method", "op", "receiver", "prefix", F.coalesce("exact", F.lit(False)).alias("exact")).dropDuplicates(["method", "op"])
    links = known.select("method", F.col("op").alias("node"), "receiver").unionAll(maps.select("method", F.col("op").alias("node"), "receiver"))
    found, circles = ancestors(maps.select("method", F.col("op").alias("start")), links)
    above = found.where("up > 0").join(known.select("method", F.col("op").alias("node"), "prefix", "exact"), ["method", "node"], "left")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("up", F.coalesce("prefix", F.lit("")).alias("prefix"))), asc=False), lambda x: x["prefix"])
    per = above.groupBy("method", F.col("start").alias("op")).agg(parts.alias("prefixes"), F.bool_and(F.coalesce("exact", F.lit(False))).alias("sound"))
    rows = maps.join(per, ["method", "op"], "left").join(circles.select("method", F.col("start").alias("op"), F.lit(True).alias("circle")), ["method", "op"], "left")
    whole = F.concat(F.coalesce("prefixes", F.array().cast("array<string>")), F.array(F.coalesce("route", F.lit(""))))
    pieces = F.filter(F.flatten(F.transform(whole, lambda p: F.split(p, "/"))), lambda p: p != "")
    joined = F.array_join(pieces, "/")
    code = F.when(F.col("circle").isNotNull() | ~F.coalesce("sound", F.lit(True)), "group").when(F.col("handler").isNull(), "callback").when(F.trim(F.coalesce("route", F.lit(""))) == "", "route")
    out = rows.withColumn("code", code).withColumn("verb", F.upper(F.regexp_replace("member", "^Map", "")))
    held = lambda c: F.when(F.col("code").isNull(), c)
    return out.select("method", "op", held(F.col("verb")).alias("verb"), held(F.concat(F.lit("/"), joined)).alias("route"), held(F.concat_ws(" ", "verb", joined)).alias("operation_key"), "code")


def query_facts(placed: DataFrame, begun: DataFrame, terminals: DataFrame) -> DataFrame:
    """frameworks.queries() of the chains that query_steps() found; terminals(method, op, name, predicate) tell what ends them."""
    names = placed.groupBy("method", "terminal").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("steps"))
    whole = begun.drop("steps").join(names, ["method", "terminal"], "left").join(terminals.select("method", F.col("op").alias("terminal"), F.col("name").alias("end"), "predicate"), ["method", "terminal"])
    key = F.struct("method", "terminal")
    return frameworks.queries(whole.select(key.alias("operation"), F.col("end").alias("terminal"), F.coalesce("steps", F.array().cast("array<string>")).alias("steps"), "predicate", F.col("member").alias("source")))
