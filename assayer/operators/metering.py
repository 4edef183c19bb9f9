"""Usage events: defaults, summaries, cost, budgets and entitlements."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.ranks import in_parts, with_totals

# Units by resource, prices per 1,000 tokens (in, out) by model.
UNITS = {"page": "page", "browser_second": "second", "token": "token", "vision_call": "call", "provider_credit": "credit", "storage_byte": "byte", "api_call": "call"}
PRICES = {"gemini-1.5-flash": (7.5e-05, 0.0003), "gemini-1.5-pro": (0.00125, 0.005), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4o": (0.0025, 0.01), "openrouter/free": (0.0, 0.0), "gsk-llama": (0.0, 0.0)}


@dataclass(frozen=True)
class CostRates:
    token_input_per_1k: float = 7.5e-05
    token_output_per_1k: float = 0.0003
    token_blended_per_1k: float = 0.00015
    browser_second: float = 0.0
    provider_credit: float = 0.001
    vision_call: float = 0.0
    page: float = 0.0


@dataclass(frozen=True)
class Budget:
    max_tokens: float = 100_000
    max_usd: float = 0.5
    max_credits: float = 0
    max_pages: float = 5000
    max_seconds: float = 3600
    soft_fraction: float = 0.8


def _map(values: Mapping[str, object], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def usage_event_defaults(df: DataFrame) -> DataFrame:
    """Fills unit and total_cost_usd; `rejected` marks negative quantities and costs."""
    unit = F.coalesce(F.when(F.col("unit") != "", F.col("unit")), _map(UNITS, F.col("resource_type")), F.lit("unit"))
    total = F.coalesce("total_cost_usd", F.col("quantity") * F.coalesce("unit_cost_snapshot", F.lit(0)))
    bad = F.coalesce((F.col("quantity") < 0) | (F.col("unit_cost_snapshot") < 0) | (F.col("total_cost_usd") < 0), F.lit(False))
    return df.withColumns({"unit": unit, "total_cost_usd": total, "rejected": bad})


def dedupe_events(df: DataFrame, key: str = "event_id", seq: str = "occurred_at") -> DataFrame:
    """One row per event id, the first: a replayed batch adds nothing."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), seq).alias("r")).select(key, "r.*")


def run_usage_events(runs: DataFrame) -> DataFrame:
    """Run metrics as one event per resource with a positive quantity."""
    names = {"pages": "page", "tokens": "token", "browser_seconds": "browser_second", "credits": "provider_credit", "vision_calls": "vision_call", "bytes": "storage_byte"}
    cells = F.array(*(F.struct(F.lit(r).alias("resource_type"), F.col(c).cast("double").alias("quantity")) for c, r in names.items()))
    rows = runs.select("run_id", "client_id", "occurred_at", F.inline(cells)).where("quantity > 0")
    return rows.withColumn("unit", _map(UNITS, F.col("resource_type"))).withColumn("metadata", F.create_map(F.lit("run"), F.col("run_id").cast("string")))


def usage_summary(events: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Per client and resource: events, quantity, cost, in [since, until); and a `__total__` row per client.

    Two aggregates with map-side combine over one scan; an empty window of a known client still has its total.
    """
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col("occurred_at").isNull() | (F.col("occurred_at") >= since))
    if until is not None:
        inside = inside & (F.col("occurred_at").isNull() | (F.col("occurred_at") < until))
    marked = events.withColumn("_in", inside)
    sums = [F.count_if("_in").alias("events"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("quantity"))), F.lit(0)).alias("quantity"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("total_cost_usd"))), F.lit(0)).alias("cost_usd")]
    per = marked.where("_in").groupBy("client_id", "resource_type").agg(*sums)
    total = marked.groupBy("client_id").agg(*sums).withColumn("resource_type", F.lit("__total__"))
    return per.unionByName(total)


def event_usd(rates: CostRates) -> Column:
    meta = F.from_json("metadata", "input_tokens double, output_tokens double")
    into, out = F.coalesce(meta["input_tokens"], F.lit(0.0)), F.coalesce(meta["output_tokens"], F.lit(0.0))
    q, kind = F.col("quantity").cast("double"), F.col("resource_type")
    tokens = F.when((into != 0) | (out != 0), into / 1000 * rates.token_input_per_1k + out / 1000 * rates.token_output_per_1k).otherwise(q / 1000 * rates.token_blended_per_1k)
    flat = {"browser_second": rates.browser_second, "provider_credit": rates.provider_credit, "vision_call": rates.vision_call, "page": rates.page}
    usd = F.when(kind == "token", tokens)
    for name, rate in flat.items():
        usd = usd.when(kind == name, q * rate)
    return F.coalesce(usd, F.lit(0.0))


def cost_report(events: DataFrame, rates: CostRates = CostRates()) -> DataFrame:  # noqa: B008
    """(client_id, resource_type, events, quantity, usd)."""
    return events.withColumn("usd", event_usd(rates)).groupBy("client_id", "resource_type").agg(F.count("*").alias("events"), F.sum(F.col("quantity").cast("double")).alias("quantity"), F.sum("usd").alias("usd"))


def provider_costs(events: DataFrame, rates: CostRates = CostRates()) -> DataFrame:  # noqa: B008
    """(provider, credits, usd): the breakdown map of a credit event where it has one, else its provider."""
    credits = events.where("resource_type = 'provider_credit'").withColumn("split", F.from_json("metadata", "breakdown map<string,double>")["breakdown"])
    own = F.create_map(F.coalesce(F.when(F.col("provider") != "", F.col("provider")), F.lit("unknown")), F.col("quantity").cast("double"))
    rows = credits.select(F.explode(F.when(F.size("split") > 0, F.col("split")).otherwise(own)).alias("provider", "credits"))
    return rows.groupBy("provider").agg(F.sum("credits").alias("credits"), (F.sum("credits") * rates.provider_credit).alias("usd"))


def model_cost(calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    """(kind, calls, usd) from (kind, model, input_tokens, output_tokens); an unknown model costs nothing."""
    price_in, price_out = (F.coalesce(_map({m: p[k] for m, p in prices.items()}, F.col("model")), F.lit(0.0)) for k in (0, 1))
    usd = F.col("input_tokens") / 1000 * price_in + F.col("output_tokens") / 1000 * price_out
    return calls.withColumn("usd", usd).groupBy("kind").agg(F.count("*").alias("calls"), F.sum("usd").alias("usd"))


def estimate_runs(plans: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES, browser_second: float = 0.0, credit: float = 0.001) -> DataFrame:
    """Adds est_usd to planned runs (pages, tokens_per_page, model, seconds_per_page, credits_per_page): 70 % of tokens go in."""
    price_in, price_out = (F.coalesce(_map({m: p[k] for m, p in prices.items()}, F.col("model")), F.lit(0.0)) for k in (0, 1))
    tokens = F.col("pages") * F.col("tokens_per_page")
    usd = tokens * 0.7 / 1000 * price_in + tokens * 0.3 / 1000 * price_out + F.col("pages") * F.col("seconds_per_page") * browser_second + F.col("pages") * F.col("credits_per_page") * credit
    return plans.withColumn("est_usd", usd)


def recent_events(events: DataFrame, n: int, client: str = "client_id", at: str = "occurred_at", key: str = "event_id") -> DataFrame:
    """The newest n events of each client; Spark drops the rest of a client within each task before the exchange."""
    place = F.row_number().over(Window.partitionBy(client).orderBy(F.desc(at), F.desc(key)))
    return events.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def budget_trip(usage: DataFrame, budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """Per job: the first event at which a running total reaches its limit, why, and whether 80 % came first.

    From (job_id, at, seq, tokens, usd, credits, pages, seconds); (at, seq) orders the events of a job. Totals of partitions
    tell in which partition of a job a limit is reached, and only that one is scanned in order, so a job may have all rows.
    A negative amount raises an error, a null one counts as zero.
    """
    limits = {"tokens": budget.max_tokens, "usd": budget.max_usd, "credits": budget.max_credits, "pages": budget.max_pages, "seconds": budget.max_seconds}

    def why(total: Callable[[str], Column]) -> Column:
        reason = F.lit(None).cast("string")
        for c, limit in reversed(limits.items()):
            if c != "credits" or limit > 0:
                reason = F.when(total(c) >= limit, f"max_{c}").otherwise(reason)
        return reason

    def soft(total: Callable[[str], Column]) -> Column:
        some = F.lit(False)
        for c, limit in limits.items():
            if limit > 0 and c != "seconds":
                some = some | (F.least(F.lit(1.0), F.round(total(c) / limit, 4)) >= budget.soft_fraction)
        return some

    checked = {c: F.when(F.col(c) < 0, F.raise_error(F.lit("amounts must not be negative")).cast("double")).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in limits}
    order = [F.asc("at"), F.asc("seq")]
    dealt, totals = in_parts(usage.select("job_id", "at", "seq", *(e.alias(c) for c, e in checked.items())), "job_id", order, {c: c for c in limits})
    end = lambda c: F.col(f"before_{c}") + F.col(f"own_{c}")
    parts = totals.withColumns({"over": why(end).isNotNull(), "soft": soft(end)})
    jobs = parts.groupBy("_key").agg(F.min(F.when(F.col("over"), F.col("_in"))).alias("_at"), F.bool_or(F.col("soft") & ~F.col("over")).alias("before"))
    crossing = parts.select("_key", "_in", *(f"before_{c}" for c in limits)).join(jobs.select(F.col("_key").alias("_k"), "_at"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_in") == F.col("_at"))).drop("_k", "_at")
    inside = Window.partitionBy("job_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = with_totals(dealt, crossing, "job_id").withColumns({f"own_{c}": F.sum(c).over(inside) for c in limits})
    marked = run.select("job_id", "at", "seq", why(end).alias("why"), soft(end).alias("soft"))
    hit = F.when(F.col("why").isNotNull(), F.struct("at", "seq", "why"))
    tripped = marked.groupBy(F.col("job_id").alias("_j")).agg(F.min(hit).alias("h"), F.bool_or(F.col("soft") & F.col("why").isNull()).alias("within"))
    found = jobs.join(tripped, F.col("_key").eqNullSafe(F.col("_j")), "left")
    return found.select(F.col("_key").alias("job_id"), F.col("h.seq").alias("trip_seq"), F.col("h.why").alias("reason"), (F.col("before") | F.coalesce("within", F.lit(False))).alias("warned"))


def credit_headroom(usage: DataFrame, limits: DataFrame, need: int = 1) -> DataFrame:
    """Per provider and month: credits used, remaining after the reserve, the busiest day, and whether `need` more fit."""
    days = usage.groupBy("provider", F.date_trunc("day", "at").alias("day")).agg(F.sum("credits").alias("used"))
    months = days.groupBy("provider", F.date_trunc("month", "day").alias("month")).agg(F.sum("used").alias("used_month"), F.max("used").alias("most_day"))
    room = F.col("monthly_limit") - F.col("emergency_reserve") - F.col("used_month")
    joined = months.join(limits, "provider")
    return joined.select("provider", F.col("month").cast("date").alias("month"), "used_month", "most_day", F.when(F.col("monthly_limit") > 0, F.greatest(F.lit(0), room)).otherwise(0).alias("remaining"), ((F.col("monthly_limit") > 0) & (room >= need)).alias("can_use"))


def check_entitlements(requests: DataFrame, usage: DataFrame, plans: DataFrame, clients: DataFrame, default_plan: str = "free") -> DataFrame:
    """requests (client_id, resource, amount) with limit, used, remaining, allowed and reason.

    A plan's limits (map) are overlaid with the client's overrides; no limit allows everything; beyond a limit the
    plan's overage policy BLOCK, WARN or ALLOW decides.
    """
    used = usage.groupBy("client_id", F.col("resource_type").alias("resource")).agg(F.sum("quantity").alias("used"))
    of = requests.join(clients.select("client_id", "plan", "overrides"), "client_id", "left").withColumn("plan", F.coalesce("plan", F.lit(default_plan)))
    joined = of.join(plans.select("plan", "limits", "overage_policy"), "plan", "left").join(used, ["client_id", "resource"], "left")
    limit = F.coalesce(F.col("overrides")[F.col("resource")], F.col("limits")[F.col("resource")])
    after = F.coalesce("used", F.lit(0)) + F.col("amount")
    within = limit.isNull() | (after <= limit)
    reason = F.when(limit.isNull(), "no limit").when(after <= limit, "within limit").when(F.col("overage_policy") == "WARN", "over limit, warned").when(F.col("overage_policy") == "ALLOW", "over limit, allowed").otherwise("over limit")
    return joined.select("client_id", "resource", "amount", "plan", limit.alias("limit"), F.coalesce("used", F.lit(0)).alias("used"), F.when(limit.isNotNull(), F.greatest(F.lit(0), limit - F.coalesce("used", F.lit(0)))).alias("remaining"),
                         (within | F.col("overage_policy").isin("WARN", "ALLOW")).alias("allowed"), reason.alias("reason"))


def client_features(clients: DataFrame, plans: DataFrame) -> DataFrame:
    """(client_id, features): the plan's features with the client's added and without its removed ones, sorted."""
    none = F.array().cast("array<string>")
    joined = clients.join(plans.select("plan", "features"), "plan", "left")
    features = F.array_except(F.array_union(F.coalesce("features", none), F.coalesce("add_features", none)), F.coalesce("remove_features", none))
    return joined.select("client_id", F.array_sort(features).alias("features"))
