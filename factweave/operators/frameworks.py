"""Framework models: rules that turn descriptors of operations and symbols into typed facts.

A model is a function DataFrame -> (facts, diagnostics); facts are (fact_id, kind, owner, payload, certainty, producer). The
host runs the applicable ones in their order and drops facts on which models disagree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import facts

# Verbs by attribute, result helpers with their status codes.
VERBS = {"HttpGetAttribute": "GET", "HttpPostAttribute": "POST", "HttpPutAttribute": "PUT", "HttpDeleteAttribute": "DELETE"}
HELPERS = {"Ok": 200, "CreatedAtAction": 201, "BadRequest": 400, "NotFound": 404, "Conflict": 409}
# Query operators, and those that end a query and need an equality predicate.
TERMINALS = ("SingleOrDefaultAsync", "FirstOrDefaultAsync", "CountAsync")
SINGLE_VALUE = ("SingleOrDefaultAsync", "FirstOrDefaultAsync")
STEPS = ("AsNoTracking", "Include", "Where", "SelectMany")
MUTATIONS = {"Add": "DbSet", "RemoveRange": "DbSet", "SaveChangesAsync": "DbContext", "Clear": "Navigation"}

FACT = "fact_id string, kind string, owner string, payload string, certainty int, producer string"


@dataclass(frozen=True)
class Model:
    name: str
    order: int
    packages: frozenset[str]
    analyze: Callable[[DataFrame], DataFrame]


def lookup(table: dict, key):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def run_models(models: list[Model], packages: set[str], descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, diagnostics): of the models whose packages are all referenced, in canonical order.

    Facts of one id and equal content count once, whichever models say so; of unequal content all are dropped, with
    SEQFW003. A fact without evidence of its producer (null) is dropped with SEQFW001.
    """
    chosen = sorted((m for m in models if m.packages <= packages), key=lambda m: (m.order, m.name))
    spark = descriptors.sparkSession
    found = spark.createDataFrame([], FACT)
    for m in chosen:
        found = found.unionByName(m.analyze(descriptors).withColumn("producer", F.lit(m.name)))
    bare = found.where("owner is null or fact_id is null").select(F.coalesce("fact_id", F.lit("")).alias("fact_id"), F.lit("SEQFW001").alias("code"))
    whole = found.where("owner is not null and fact_id is not null")
    kept, dropped = facts.resolve_conflicts(whole, ["fact_id"], ["kind", "owner", "payload", "certainty"], "SEQFW003")
    return kept, dropped.unionByName(bare)


def controllers(types: DataFrame, methods: DataFrame, attributes: DataFrame) -> DataFrame:
    """Entry points (method_id, verb, route) of controller actions.

    types(type_id, name, is_abstract, has_controller_base), methods(method_id, type_id, name, is_public, is_static, arity),
    attributes(target, name, argument). A type or method marked NonController or NonAction is none. Every prefix
    of the type combines with every template of the method; entries of one verb and route are one.
    """
    marked = lambda name: attributes.where(F.col("name") == name).select("target")
    eligible = types.where("not is_abstract and has_controller_base").join(marked("NonControllerAttribute"), F.col("type_id") == F.col("target"), "left_anti")
    actions = methods.where("is_public and not is_static and arity = 0").join(marked("NonActionAttribute"), F.col("method_id") == F.col("target"), "left_anti")
    verbs = attributes.where(F.col("name").isin(*VERBS)).select(F.col("target").alias("method_id"), lookup(VERBS, F.col("name")).alias("verb"), F.col("argument").alias("template"))
    prefixes = attributes.where("name = 'RouteAttribute'").select(F.col("target").alias("type_id"), F.col("argument").alias("prefix"))
    rows = actions.join(eligible.select("type_id", F.col("name").alias("controller")), "type_id").join(prefixes, "type_id", "left").join(verbs, "method_id")
    route = text.rooted_route(text.route_combine(F.col("prefix"), F.coalesce("template", F.lit(""))), F.col("controller"))
    return rows.select("method_id", "verb", route.alias("route")).distinct()


def bind_parameters(parameters: DataFrame, routes: DataFrame) -> DataFrame:
    """(method_id, ordinal, binding) of handler parameters, by the first that applies.

    A name in the route is Route; a cancellation token is Cancellation; a custom binder is Unknown; a simple type is Query;
    the only one left that can be read from the body is Body; else Unknown.
    """
    names = routes.select("method_id", F.explode(text.placeholders(F.col("route"))).alias("name")).distinct().withColumn("placed", F.lit(True))
    rows = parameters.join(names, ["method_id", "name"], "left")
    first = F.when(F.col("placed"), "Route").when(F.col("type") == "System.Threading.CancellationToken", "Cancellation").when(F.col("custom"), "Unknown").when(F.col("simple"), "Query")
    rows = rows.withColumn("binding", first)
    bodies = rows.where("binding is null and body").groupBy("method_id").agg(F.count("*").alias("bodies"))
    rows = rows.join(bodies, "method_id", "left")
    body = F.when(F.col("body") & (F.col("bodies") == 1), "Body").otherwise("Unknown")
    return rows.select("method_id", "ordinal", F.coalesce("binding", body).alias("binding"))


def helper_outcomes(claims: DataFrame) -> DataFrame:
    """claims(..., helper) with the status that a known helper answers with, its polarity, and SC004 for any other helper or polarity."""
    status = lookup(HELPERS, F.col("helper"))
    polarity = outcome_polarity(status)
    known = polarity.isin("Success", "Failure")
    return claims.select("*", F.when(known, status).alias("status"), F.when(known, polarity).alias("polarity"), F.when(~F.coalesce(known, F.lit(False)), "SC004").alias("code"))


def outcome_polarity(status):
    """Success for 2xx, Failure for 4xx and 5xx, Next for any other status; null for none."""
    return F.when(status.between(200, 299), "Success").when(status.between(400, 599), "Failure").when(status.isNotNull(), "Next")


def queries(chains: DataFrame) -> DataFrame:
    """Query facts of chains(operation, terminal, steps: array of names, predicate, source).

    A chain is admitted if its terminal and all its steps are known, AsNoTracking occurs once at most, its source is a set,
    and a terminal that gives one value has an equality predicate.
    """
    known = F.col("terminal").isin(*TERMINALS) & F.forall("steps", lambda s: s.isin(*STEPS))
    once = F.size(F.filter("steps", lambda s: s == "AsNoTracking")) <= 1
    single = ~F.col("terminal").isin(*SINGLE_VALUE) | F.coalesce(F.col("predicate") == "Equality", F.lit(False))
    return chains.where(known & once & single & (F.col("source") == "DbSet")).select("operation", "terminal", F.array_join("steps", ">").alias("steps"))


def mutations(operations: DataFrame) -> DataFrame:
    """Operations (operation, member, receiver) that change a set or save, by exact member and receiver."""
    return operations.where(lookup(MUTATIONS, F.col("member")) == F.col("receiver")).select("operation", F.col("member").alias("kind"))


def dispatches(sends: DataFrame, handlers: DataFrame) -> DataFrame:
    """(operation, resolution, handler) of sends(operation, request, response) to handlers(handler, request, response).

    Request and response must both be equal: none is Unresolved, one ExactSingle, several Ambiguous (and no handler).
    """
    per = handlers.groupBy("request", "response").agg(F.count_distinct("handler").alias("n"), F.min("handler").alias("handler"))
    rows = sends.join(per, ["request", "response"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("operation", F.when(n == 0, "Unresolved").when(n == 1, "ExactSingle").otherwise("Ambiguous").alias("resolution"), F.when(n == 1, F.col("handler")).alias("handler"))


def registrations(calls: DataFrame) -> DataFrame:
    """Service registrations of calls(operation, member, service, implementation, has_factory): closed, receiver-only ones."""
    lifetime = F.regexp_extract("member", "^Add(Scoped|Singleton|Transient)$", 1)
    shaped = (lifetime != "") & ~F.col("has_factory") & F.col("service").isNotNull() & F.col("implementation").isNotNull()
    closed = ~F.col("service").rlike(r"^System\.Collections\.Generic\.IEnumerable<|<,*>$")
    return calls.where(shaped & closed).select("operation", lifetime.alias("lifetime"), "service", "implementation")


def cache_regions(caches: DataFrame, boundaries: DataFrame, key: list[str]) -> DataFrame:
    """Cache facts joined with the callback boundary of the same key, where both sides have exactly one of the key."""
    one = lambda rows, name: rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").drop("n")
    return one(caches, "fact").join(one(boundaries, "boundary"), key)


def callback_cardinality(uses: DataFrame) -> DataFrame:
    """(callback, cardinality) of uses(callback, kind, in_loop, in_region, conditional, on_every_path).

    kind 'escape' or no invocation is Unbounded; an invocation inside a switch, try, using or lock is Unknown; several, or one in a loop,
    RepeatedOrUnknown; one on every path ExactlyOnce; one under a single condition ZeroOrOne; else Unknown.
    """
    invoked = F.col("kind") == "invoke"
    per = uses.groupBy("callback").agg(F.bool_or(F.col("kind") == "escape").alias("escapes"), F.count_if(invoked).alias("n"), *[F.bool_or(invoked & F.col(c)).alias(c) for c in ("in_loop", "in_region", "conditional", "on_every_path")])
    kind = (
        F.when(F.col("escapes") | (F.col("n") == 0), "Unbounded")
        .when(F.col("in_region"), "Unknown")
        .when((F.col("n") > 1) | F.col("in_loop"), "RepeatedOrUnknown")
        .when(~F.col("conditional") & F.col("on_every_path"), "ExactlyOnce")
        .when(F.col("conditional"), "ZeroOrOne")
        .otherwise("Unknown")
    )
    return per.select("callback", kind.alias("cardinality"))
