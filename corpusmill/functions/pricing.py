"""Price of a request from its token counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import round_exact


@dataclass(frozen=True)
class PriceCard:
    """US dollars per million tokens of one model."""

    provider: str
    model: str
    input_usd: float
    output_usd: float
    source: str
    is_estimated: bool = False


# The known price cards.
PRICE_CARDS = (
    PriceCard("openai", "gpt-4.1-mini", 0.80, 3.20, "OpenAI pricing (gpt-4.1-mini)"),
    PriceCard("openai", "gpt-4.1", 3.00, 12.00, "OpenAI pricing (gpt-4.1)"),
    PriceCard("openai", "text-embedding-3-small", 0.02, 0.00, "OpenAI pricing (text-embedding-3-small)"),
    PriceCard("openrouter", "openai/gpt-4.1-mini", 0.80, 3.20,
              "OpenRouter passthrough pricing using OpenAI gpt-4.1-mini rates", True),
    PriceCard("openrouter", "openai/gpt-4.1", 3.00, 12.00,
              "OpenRouter passthrough pricing using OpenAI gpt-4.1 rates", True),
)

CARD_FIELDS = "struct<input_usd: double, output_usd: double, source: string, is_estimated: boolean>"


def _card_of(provider: Column, model: Column, cards: tuple[PriceCard, ...]) -> Column:
    """The matching card from a constant map; a price list is configuration and small."""
    entries: list[Column] = []
    for card in cards:
        entries += [
            F.lit(f"{card.provider}\n{card.model}"),
            F.struct(
                F.lit(card.input_usd).alias("input_usd"),
                F.lit(card.output_usd).alias("output_usd"),
                F.lit(card.source).alias("source"),
                F.lit(card.is_estimated).alias("is_estimated"),
            ),
        ]
    table = F.create_map(*entries).cast(f"map<string,{CARD_FIELDS}>")
    return F.try_element_at(table, F.concat(provider, F.lit("\n"), model))


def request_cost(
    provider: Column, model: Column, prompt_tokens: Column, completion_tokens: Column,
    cards: tuple[PriceCard, ...] = PRICE_CARDS,
) -> Column:
    """struct<total, input, output, source, is_estimated>; zero when the model has no card."""
    card = _card_of(provider, model, cards)
    million = F.lit(1_000_000)
    spent_in = prompt_tokens / million * card["input_usd"]
    spent_out = completion_tokens / million * card["output_usd"]

    def dollars(amount: Column) -> Column:
        return F.coalesce(round_exact(amount, 6), F.lit(0.0))

    no_model = F.coalesce(model, F.lit("")) == ""
    unknown = F.concat(F.lit("Unknown price card for "), provider, F.lit("/"), model)
    return F.struct(
        dollars(spent_in + spent_out).alias("total_cost_usd"),
        dollars(spent_in).alias("input_cost_usd"),
        dollars(spent_out).alias("output_cost_usd"),
        F.when(no_model, "No model selected")
        .otherwise(F.coalesce(card["source"], unknown))
        .alias("pricing_source"),
        F.coalesce(card["is_estimated"], F.lit(True)).alias("cost_is_estimated"),
    )


def display_cost(provider_reported: Column, estimated: Column) -> Column:
    """What the provider reported, else the estimate."""
    return F.coalesce(provider_reported, estimated)
