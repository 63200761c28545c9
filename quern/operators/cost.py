"""Token cost with tiered prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompts of more tokens than this are billed at the higher tier.
LONG_PROMPT = 200_000
#: Prices of a model, in dollars per million tokens; each can have a rate for long prompts beside it.
RATES = ("input", "output", "context_cache_read", "cached_input", "cache_creation_5m", "cache_creation_1h")


def _or0(x: Column | None) -> Column:
    return F.lit(0) if x is None else F.coalesce(x, F.lit(0))


def fresh_input(prompt: Column, cached: Column, write_5m: Column, write_1h: Column) -> Column:
    """Prompt tokens billed at the full input price."""
    return F.greatest(prompt - _or0(cached) - _or0(write_5m) - _or0(write_1h), F.lit(0))


def tiered(prompt: Column, base: Column, over: Column) -> Column:
    return F.when((prompt > LONG_PROMPT) & over.isNotNull(), over).otherwise(base)


def token_cost(
    prompt: Column,
    completion: Column,
    prices: dict[str, Column],
    cached: Column | None = None,
    write_5m: Column | None = None,
    write_1h: Column | None = None,
    thinking: Column | None = None,
    thinking_included: Column | None = None,
) -> Column:
    """Cost of one call in dollars; null if the model has no input or output price.

    prices: columns named as in RATES, with _over_200k behind those for long prompts. Reads
    from the cache without a price cost nothing; writes to it without a price (or with a price
    of 0) cost what input costs. Thinking is billed as output, unless it is part of it already.
    """
    null = F.lit(None).cast("double")
    rate = {k: tiered(prompt, prices.get(k, null), prices.get(f"{k}_over_200k", null)) for k in RATES}
    read = F.coalesce(rate["context_cache_read"], rate["cached_input"], F.lit(0.0))
    write = lambda k: F.coalesce(F.nullif(rate[k], F.lit(0.0)), rate["input"])
    apart = F.lit(True) if thinking_included is None else ~F.coalesce(thinking_included, F.lit(False))
    output = completion + F.when(apart, _or0(thinking)).otherwise(F.lit(0))
    total = fresh_input(prompt, cached, write_5m, write_1h) * rate["input"] + _or0(cached) * read
    total = total + _or0(write_5m) * write("cache_creation_5m") + _or0(write_1h) * write("cache_creation_1h") + output * rate["output"]
    return total / 1e6


def usage_cost(usage: Column, prices: dict[str, Column]) -> Column:
    """Cost of one call from its usage record; fields that are absent count as 0."""
    made = usage["cache_creation"]
    return token_cost(
        _or0(usage["prompt_tokens"]),
        _or0(usage["completion_tokens"]),
        prices,
        usage["cache_read_input_tokens"],
        made["ephemeral_5m_input_tokens"],
        made["ephemeral_1h_input_tokens"],
    )


def strict_sum(x: Column) -> Column:
    """A sum that any unknown term makes unknown."""
    return F.when(F.count_if(x.isNull()) > 0, F.lit(None).cast("double")).otherwise(F.sum(x))
