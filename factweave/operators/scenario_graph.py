"""The scenario graph of every entry point: what a request reaches, as typed nodes and edges, and why something is withheld.

All entries are built in one plan. An entry's methods (its root, and the service method that it calls) are found first; each table of
facts is then cut to them by an equi-join and becomes a stream of nodes, edges and diagnostics, and the streams are united.
Ids are hashes of (entry, kind, key), so an edge knows the ids of its ends without a lookup. Nothing gathers an entry.

Every fact has one reading: a match that must be unique and is not gives a code instead of a node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import calls, frameworks, joins

# Codes of calls that an expansion does not follow, and of dispatches without one handler.
STOPS = {
    "NodeBudget": "SC-DIRECT-NODE-BUDGET", "Cycle": "SC-DIRECT-CYCLE", "Depth": "SC-DIRECT-DEPTH", "BodyUnavailable": "SC-DIRECT-BODY-UNAVAILABLE",
    "SourceUnavailable": "SC-DIRECT-SOURCE-UNAVAILABLE", "NoFlow": "SC-DIRECT-NO-FLOW", "AmbiguousFlow": "SC-DIRECT-AMBIGUOUS-FLOW", "Guarded": "SC-DIRECT-GUARDED",
}
#: Sites of service calls that a broadcast may hold.
BROADCAST_SITES = 1_000_000
DISPATCHES = {"Ambiguous": "SC-DISPATCH-AMBIGUOUS", "OpenGeneric": "SC-DISPATCH-OPEN-GENERIC"}
ACTIONS = {"Configured": "configured method", "Minimal": "minimal API handler", "Controller": "controller action"}


def resolve_services(actions: DataFrame, methods: DataFrame, bindings: DataFrame, sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entry, root, service_type, implementation, site, operation, method, reason): the one service that each action(entry, root) calls.

    methods(method_id, type_name, is_constructor) leads from the root to its type and that type's constructor (the first);
    bindings(constructor, service_type, implementation, registration) to the services given to it; sites(caller, site, operation,
    declared_type, complete) to the calls of one of them, and candidates(site, candidate, declaring_type) to the one method of the
    implementation. The first service type (by name) that is called at all decides. reason names the first hop that fails, and the
    type at the later ones.
    """
    typed = actions.join(methods.select(F.col("method_id").alias("root"), F.col("type_name").alias("own_type"), F.lit(True).alias("known")), "root", "left")
    constructors = methods.where("is_constructor").groupBy(F.col("type_name").alias("own_type")).agg(F.min("method_id").alias("constructor"))
    typed = typed.join(constructors, "own_type", "left")
    bound = bindings.groupBy("constructor", "service_type").agg(F.count_distinct("implementation").alias("implementations"), F.min("implementation").alias("implementation"), F.min("registration").alias("registration"), F.count("registration").alias("registered"))
    any_bound = bound.select("constructor").distinct().withColumn("bound", F.lit(True))
    called = sites.groupBy(F.col("caller").alias("root"), F.col("declared_type").alias("service_type")).agg(F.count("*").alias("sites"), F.min("site").alias("site"), F.min("operation").alias("operation"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))
    met = typed.join(bound, "constructor").join(called, ["root", "service_type"])
    fields = ("service_type", "implementations", "implementation", "registered", "sites", "site", "operation", "complete")
    first = calls.cut(met.groupBy("entry").agg(F.min_by(F.struct(*fields), "service_type").alias("s")).select("entry", "s.*"))
    # Only candidates of the sites that decide are counted: they are few of all, which are not dealt for them up to a counted bound.
    sought = first.select("site", F.col("implementation").alias("declaring_type")).distinct()
    sought = F.broadcast(sought) if first.count() <= BROADCAST_SITES else sought
    single = candidates.join(sought, ["site", "declaring_type"], "left_semi").groupBy("site", F.col("declaring_type").alias("implementation")).agg(F.count_distinct("candidate").alias("found"), F.min("candidate").alias("method"))
    out = typed.join(any_bound, "constructor", "left").join(first, "entry", "left").join(single, ["site", "implementation"], "left")
    found = F.coalesce("found", F.lit(0))
    at = lambda name: F.concat(F.lit(f"{name}:"), "service_type")
    reason = (
        F.when(F.col("known").isNull(), "action-method-missing").when(F.col("constructor").isNull(), "controller-constructor-missing")
        .when(F.col("bound").isNull(), "no-di-bindings").when(F.col("service_type").isNull(), "no-service-call-matched")
        .when(F.col("sites") > 1, at("multiple-matching-call-sites")).when(~F.col("complete"), at("incomplete-resolution"))
        .when(F.col("implementations") > 1, at("multiple-di-targets")).when(found == 0, at("no-implementation-candidate"))
        .when(found > 1, at("multiple-implementation-candidates")).when(F.col("registered") == 0, "registration-missing")
    )
    out = out.withColumn("reason", reason)
    held = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select("entry", "root", *[held(c) for c in ("service_type", "implementation", "site", "operation", "method")], "reason")


def associate_results(resolved: DataFrame, decisions: DataFrame, factories: DataFrame, returned: DataFrame, locals_: DataFrame) -> DataFrame:
    """(entry, root, method, success, failure, type_name, code, detail): the two factories whose results a service returns.

    resolved(entry, root, method); decisions(method, local) of roots, the first local counts; factories(method, operation, outcome, type_name)
    with outcome Success or NotFound, of which those count whose operation is returned(method, operation); locals_(method, name,
    type_name) of roots, the first of a name. SC006 without a decision; SC007 if no factory is returned, if there is not one of each outcome, or
    if the decision's local is not of the success's type.
    """
    decided = decisions.groupBy(F.col("method").alias("root")).agg(F.min("local").alias("local"), F.lit(True).alias("decided"))
    used = factories.join(returned.select("method", "operation").distinct(), ["method", "operation"], "left_semi")
    side = lambda outcome, c: F.min(F.when(F.col("outcome") == outcome, F.col(c)))
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    made = used.groupBy("method").agg(count("Success").alias("n_success"), count("NotFound").alias("n_failure"), side("Success", "operation").alias("success"), side("NotFound", "operation").alias("failure"), side("Success", "type_name").alias("type_name"))
    named = locals_.groupBy(F.col("method").alias("root"), F.col("name").alias("local")).agg(F.min("type_name").alias("local_type"))
    out = resolved.join(decided, "root", "left").join(made, "method", "left").join(named, ["root", "local"], "left")
    uneven = (F.col("n_success") != 1) | (F.col("n_failure") != 1)
    code = F.when(F.col("decided").isNull(), "SC006").when(F.col("n_success").isNull() | uneven | ~F.coalesce(F.col("local_type") == F.col("type_name"), F.lit(False)), "SC007")
    detail = F.when(F.col("decided").isNull(), F.col("root").cast("string")).when(F.col("n_success").isNull(), "no-return-provenance")
    detail = detail.when(uneven, F.concat(F.lit("success="), "n_success", F.lit(" failure="), "n_failure")).otherwise(F.concat(F.lit("local="), F.coalesce("local", F.lit("?"))))
    out = out.withColumn("code", code)
    held = lambda c: F.when(F.col("code").isNull(), F.col(c)).alias(c)
    return out.select("entry", "root", "method", held("success"), held("failure"), held("type_name"), "code", F.when(F.col("code").isNotNull(), detail).alias("detail"))


def join_outcomes(claims: DataFrame, outcomes: DataFrame, on: list[str], routes: DataFrame | None = None) -> DataFrame:
    """claims(entry, method, operation, helper, created, ...) with status, polarity, key, detail and code of their one outcome(method, operation, helper, status).

    on: the columns that make an outcome a claim's: its operation, or its helper. SC004 if there is not exactly one, if its helper is another or
    its status neither success nor failure. A CreatedAtAction names the route of the one entry of routes(root, route) that its created
    target is; without one the outcome stands, but `lost` holds SC010.
    """
    one = joins.exactly_one(claims, outcomes.select("method", *on, F.col("status"), F.col("helper").alias("found"), F.col("operation").alias("at")), ["method", *on], "SC004", "SC004", ["status", "found", "at"])
    one = one.withColumn("polarity", frameworks.outcome_polarity(F.col("status")))
    same = F.coalesce(F.col("found") == F.col("helper"), F.lit(False)) & F.col("polarity").isin("Success", "Failure")
    one = one.withColumn("code", F.when(F.col("code").isNotNull() | ~same, "SC004"))
    linked = (F.col("helper") == "CreatedAtAction") & F.col("created").isNotNull()
    if routes is None:
        one = one.withColumn("route", F.lit(None).cast("string")).withColumn("lost", F.lit(None).cast("string"))
    else:
        known = routes.groupBy(F.col("root").alias("created")).agg(F.count("*").alias("n"), F.min("route").alias("route")).where("n = 1").drop("n")
        one = one.join(known, "created", "left").withColumn("lost", F.when(linked & F.col("code").isNull() & F.col("route").isNull(), "SC010"))
    status = F.col("status").cast("string")
    detail = F.concat("helper", F.lit(" -> HTTP "), status, F.when(linked & F.col("route").isNotNull(), F.concat(F.lit(" links to GET "), "route")).otherwise(""))
    return one.select(*claims.columns, "status", "polarity", F.concat(F.lit("outcome:"), status, F.lit(":"), "helper").alias("key"), detail.alias("detail"), "at", "code", "lost")


@dataclass(frozen=True)
class Facts:
    """The tables that a scenario graph is made of; methods are ids, operations ids of operations of methods.

    entries(entry, root, kind, label) with kind of ACTIONS; methods(method_id, name, type_name, has_body, loaded, flows, is_constructor);
    calls(caller, callee, owner, op_ord, operation, guarded): admitted calls; root_calls(caller, callee, operation, place): those admitted
    for an entry's own method; dispatches(method, operation, request_type, resolution, handler); bindings, sites and candidates as
    resolve_services() takes them; steps(method, operation, kind, detail, ordinal) with kind EntityQuery, StateAssignment, Mutation or
    Save; observations(method, observation, operation, detail); arms(method, member, operation, switch, enum, helper, created) and
    terminals(method, operation, helper, created, ordinal) of roots; outcomes(method, operation, helper, status); routes(root, route) of GET
    entries; decisions, factories, returned and locals as associate_results() takes them; paths(method, outcome, helper).
    """

    entries: DataFrame
    methods: DataFrame
    calls: DataFrame
    root_calls: DataFrame
    dispatches: DataFrame
    bindings: DataFrame
    sites: DataFrame
    candidates: DataFrame
    steps: DataFrame
    observations: DataFrame
    arms: DataFrame
    terminals: DataFrame
    outcomes: DataFrame
    routes: DataFrame
    decisions: DataFrame
    factories: DataFrame
    returned: DataFrame
    locals: DataFrame
    paths: DataFrame


NODE = ("entry", "kind", "key", "method", "operation", "detail", "ordinal")
EDGE = ("entry", "source_kind", "source_key", "target_kind", "target_key", "kind", "detail", "ordinal")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and p.endswith((":", " ", "=")) else F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def _rows(rows: DataFrame, columns: tuple[str, ...], **values) -> DataFrame:
    """The columns of a node or an edge: a value is a column, else a constant; what is not given is null."""
    kinds = {"method": "long", "operation": "long", "ordinal": "long"}
    made = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    return rows.select("entry", *[made.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns[1:]])


def _node(rows, kind, key, **values):
    return _rows(rows, NODE, kind=kind, key=key, **values)


def _edge(rows, source, target, kind, detail, ordinal=None):
    return _rows(rows, EDGE, source_kind=source[0], source_key=source[1], target_kind=target[0], target_key=target[1], kind=kind, detail=detail, ordinal=ordinal)


def _told(rows, code, detail):
    return rows.select("entry", (code if isinstance(code, Column) else F.lit(code)).alias("code"), detail.cast("string").alias("detail"))


def node_id(entry: Column, kind: Column, key: Column) -> Column:
    return text.stable_id("scenario-node", {"entry": entry, "kind": kind, "key": key})


def _configured(f: Facts):
    """Configured methods: the tree of their calls, or why they have none."""
    gate = f.entries.where("kind = 'Configured'").join(f.methods.select(F.col("method_id").alias("root"), F.coalesce("has_body", F.lit(False)).alias("body"), "flows"), "root", "left")
    code = F.when(~F.coalesce("body", F.lit(False)), "SC002").when(F.col("flows") == 0, "SC-DIRECT-NO-FLOW").when(F.col("flows") > 1, "SC-DIRECT-AMBIGUOUS-FLOW")
    gate = calls.cut(gate.withColumn("code", code))
    tree = calls.call_tree(gate.where("code is null").select("entry", "root"), f.calls, f.methods, carried=("operation", "op_ord"), few=True)
    tree = calls.kept(tree.where("depth > 0").drop("caller", "place", "depth"))  # read for nodes, edges and stops
    steps = tree.where("step").join(f.methods.select("method_id", "type_name", "name"), "method_id", "left")
    action, own = ("Action", _text("action:", "root")), ("MethodCall", _text("method-call:", "path"))
    above = (F.when(F.col("up") == "", "Action").otherwise("MethodCall"), F.when(F.col("up") == "", action[1]).otherwise(_text("method-call:", "up")))
    nodes = _node(steps, *own, method=F.col("method_id"), operation=F.col("operation"), detail=_text("calls ", F.coalesce(F.concat_ws(".", "type_name", "name"), F.lit("?"))), ordinal=F.col("op_ord"))
    edges = _edge(steps, above, own, "Call", "direct method call", F.col("op_ord"))
    stops = tree.where("stop is not null").withColumn("code", frameworks.lookup(STOPS, F.col("stop")))
    return [nodes], [edges], [_told(gate.where("code is not null"), F.col("code"), F.col("root")), _told(stops, F.col("code"), _text("operation", F.lit("@"), "path"))]


def _dispatched(f: Facts, requests: DataFrame):
    """Requests handed to a handler by type; entries with any have nothing else."""
    place = (F.row_number().over(Window.partitionBy("entry").orderBy("operation")) - 1).cast("long")
    rows = requests.join(f.dispatches.withColumnRenamed("method", "root"), "root").withColumn("ordinal", place)
    dispatch = ("Dispatch", _text("dispatch:", "operation"))
    one = rows.where("resolution = 'ExactSingle' and handler is not null")
    handler = ("Handler", _text("handler:", "operation", F.lit(":"), "handler"))
    nodes = [_node(rows, *dispatch, method=F.col("root"), operation=F.col("operation"), detail=F.col("request_type")), _node(one, *handler, method=F.col("handler"), operation=F.col("operation"), detail=_text("handler ", "handler"))]
    edges = [_edge(rows, ("Action", _text("action:", "root")), dispatch, "Dispatch", "dispatch", F.col("ordinal")), _edge(one, dispatch, handler, "Dispatch", "dispatch", F.col("ordinal"))]
    none = rows.where("not (resolution = 'ExactSingle' and handler is not null)")
    return nodes, edges, [_told(none, F.coalesce(frameworks.lookup(DISPATCHES, F.col("resolution")), F.lit("SC-DISPATCH-UNRESOLVED")), F.col("operation"))]


def _served(f: Facts, resolved: DataFrame):
    """The service call and the facts of the service method; observations also of the root."""
    action, service = ("Action", _text("action:", "root")), ("ServiceCall", _text("service:", "method"))
    nodes = [_node(resolved, *service, method=F.col("method"), operation=F.col("operation"), detail=_text("resolved service implementation ", "implementation"))]
    edges = [_edge(resolved, action, service, "Call", _text("call through ", "service_type"))]
    scope = resolved.select("entry", "method")
    steps = scope.join(f.steps, "method")
    kind = F.when(F.col("kind").isin("Mutation", "Save"), "EntityMutation").otherwise(F.col("kind"))
    name = F.when(kind == "EntityQuery", "query:").when(kind == "StateAssignment", "state:").otherwise("mutation:")
    own = (kind, F.concat(name, F.col("operation").cast("string")))
    nodes.append(_node(steps, *own, method=F.col("method"), operation=F.col("operation"), detail=F.col("detail"), ordinal=F.col("ordinal")))
    edges.append(_edge(steps, service, own, F.when(F.col("kind") == "EntityQuery", "Query").otherwise(F.col("kind")), F.col("detail"), F.col("ordinal")))
    # An observation stands under the root if it is the root's, else under the service; a method that is both counts once.
    scopes = resolved.select("entry", F.col("root").alias("method"), F.lit("Action").alias("at"), action[1].alias("at_key"))
    scopes = scopes.unionAll(resolved.where("method <> root").select("entry", "method", F.lit("ServiceCall"), service[1]))
    seen = scopes.join(f.observations, "method")
    own = ("SourceObservation", _text("observation:", "observation"))
    nodes.append(_node(seen, *own, method=F.col("method"), operation=F.col("operation"), detail=F.col("detail")))
    edges.append(_edge(seen, (F.col("at"), F.col("at_key")), own, "Observation", ""))
    return nodes, edges, []


def _ended(joined: DataFrame, source: tuple):
    """Outcome nodes, once an entry and key by the first claim, with an edge for each claim; codes of those that cannot be told."""
    joined = calls.cut(joined)
    good = joined.where("code is null")
    first = good.groupBy("entry", "key").agg(F.min_by(F.struct("method", "at", "detail"), F.struct("place", "operation")).alias("o")).select("entry", "key", "o.*")
    nodes = _node(first, "Outcome", F.col("key"), method=F.col("method"), operation=F.col("at"), detail=F.col("detail"))
    edges = _edge(good, source, ("Outcome", F.col("key")), F.concat(F.lit("Outcome"), "polarity"), _text("helper", F.lit(" outcome"))).distinct()
    lost = joined.where("lost is not null")
    return nodes, edges, [_told(joined.where("code is not null"), F.col("code"), _text("helper", F.lit("@"), "place")), _told(lost, F.col("lost"), F.col("created"))]


def _by_status(f: Facts, resolved: DataFrame):
    """Roots that switch over a status: a result, and an outcome for each arm and each direct end that no arm has."""
    switched = f.arms.groupBy(F.col("method").alias("root")).agg(F.min("switch").alias("switch"), F.min("enum").alias("enum"))
    rows = resolved.select("entry", "root", "method").join(switched, "root")
    result = ("Result", F.lit("result-status"))
    nodes = [_node(rows, *result, method=F.col("root"), operation=F.col("switch"), detail=_text("status result of ", "enum"))]
    edges = [_edge(rows, ("ServiceCall", _text("service:", "method")), result, "ResultStatus", "status result")]
    roots = rows.select("entry", F.col("root").alias("method"))
    arms = f.arms.select("method", "operation", "helper", "created", F.concat(F.lit("0"), "member").alias("place"))
    direct = f.terminals.join(f.arms.select("method", "operation").distinct(), ["method", "operation"], "left_anti")
    direct = direct.select("method", "operation", "helper", "created", F.concat(F.lit("1"), F.lpad(F.col("ordinal").cast("string"), 12, "0")).alias("place"))
    claims = roots.join(arms.unionAll(direct), "method").select("entry", "method", "operation", "helper", "created", "place")
    node, edge, told = _ended(join_outcomes(claims, f.outcomes, ["operation"], f.routes), result)
    return [*nodes, node], [*edges, edge], told


def _by_factories(f: Facts, resolved: DataFrame):
    """Other roots: a result for either factory that the service returns, with the outcomes of the paths that the root decides between."""
    rows = resolved.select("entry", "root", "method").join(f.arms.select(F.col("method").alias("root")).distinct(), "root", "left_anti")
    found = calls.cut(associate_results(rows, f.decisions, f.factories, f.returned, f.locals))
    sound, service = found.where("code is null"), ("ServiceCall", _text("service:", "method"))
    nodes, edges, told = [], [], [_told(found.where("code is not null"), F.col("code"), F.col("detail"))]
    for outcome, key, column in (("Success", "result-success", "success"), ("NotFound", "result-failure", "failure")):
        result = ("Result", F.lit(key))
        nodes.append(_node(sound, *result, method=F.col("method"), operation=F.col(column), detail=_text(F.lit(f"{column} result of "), "type_name")))
        edges.append(_edge(sound, service, result, f"Result{column.title()}", f"{column} factory"))
        paths = f.paths.where(F.col("outcome") == outcome).select("method", "helper").distinct()
        claims = sound.select("entry", F.col("root").alias("method")).join(paths, "method")
        nothing = F.lit(None).cast("long")
        claims = claims.select("entry", "method", nothing.alias("operation"), "helper", nothing.alias("created"), F.concat(F.lit(key), "helper").alias("place"))
        ended = join_outcomes(claims, f.outcomes, ["helper"]).withColumn("polarity", F.lit(column.title()))
        node, edge, more = _ended(ended, result)
        nodes.append(node)
        edges.append(edge)
        told += more
    return nodes, edges, told


def scenario_graph(f: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, diagnostics) of all entries.

    nodes(entry, node, kind, key, method, operation, detail, ordinal), edges(entry, edge, source, target, kind, detail, ordinal),
    diagnostics(entry, code, detail). A configured method shows its calls; any other entry its dispatches, if it has some, else the one
    service that it resolves to with its facts and outcomes, else (SC001) its own calls.
    """
    f = Facts(**{k: v for k, v in f.__dict__.items()} | {"entries": calls.cut(f.entries)})
    requests = f.entries.where("kind <> 'Configured'").select("entry", "root")
    plain = requests.join(f.dispatches.select(F.col("method").alias("root")).distinct(), "root", "left_anti")
    services = calls.cut(resolve_services(plain, f.methods, f.bindings, f.sites, f.candidates))
    resolved, lost = services.where("reason is null"), services.where("reason is not null")
    action = ("Action", _text("action:", "root"))
    nodes = [_node(f.entries, "EntryPoint", F.col("entry"), method=F.col("root"), detail=F.col("label")), _node(f.entries, *action, method=F.col("root"), detail=frameworks.lookup(ACTIONS, F.col("kind")))]
    edges = [_edge(f.entries, ("EntryPoint", F.col("entry")), action, "Entry", "")]
    told = [_told(lost, "SC001", _text("root", F.lit("|"), "reason"))]
    own = lost.select("entry", "root").join(f.root_calls.withColumnRenamed("caller", "root"), "root").join(f.methods.select(F.col("method_id").alias("callee"), "type_name", "name"), "callee", "left")
    call = ("MethodCall", _text("method-call:", "operation"))
    nodes.append(_node(own, *call, method=F.col("callee"), operation=F.col("operation"), detail=_text("calls ", F.coalesce(F.concat_ws(".", "type_name", "name"), F.lit("?"))), ordinal=F.col("place")))
    edges.append(_edge(own, action, call, "Call", "direct method call", F.col("place")))
    for more_nodes, more_edges, more_told in (_configured(f), _dispatched(f, requests), _served(f, resolved), _by_status(f, resolved), _by_factories(f, resolved)):
        nodes, edges, told = nodes + more_nodes, edges + more_edges, told + more_told
    node, edge, code = (_united(x) for x in (nodes, edges, told))
    # Outcomes of both results of an entry share a key, and so a node.
    node = node.groupBy("entry", "kind", "key").agg(F.min(F.struct(*NODE[3:])).alias("n")).select("entry", "kind", "key", "n.*")
    node = node.select("entry", node_id(F.col("entry"), F.col("kind"), F.col("key")).alias("node"), *NODE[1:])
    ends = [node_id(F.col("entry"), F.col(f"{e}_kind"), F.col(f"{e}_key")).alias(e) for e in ("source", "target")]
    edge = edge.select("entry", *ends, "kind", "detail", "ordinal")
    edge_id = text.stable_id("scenario-edge", {c: F.col(c) for c in ("entry", "source", "target", "kind", "detail")})
    return node, edge.select("entry", edge_id.alias("edge"), "source", "target", "kind", "detail", "ordinal"), code


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
