"""The rubric of the risk categories: bands, notes, levels and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import MIN_SCORED_CATEGORIES

# Thresholds in percent, and what a score is capped or lowered by.
BOILERPLATE_MAX_SCORE, HEDGING_MAX_REDUCTION = 5, 2
FOREIGN_REVENUE, FX_IMPACT, RATE_IMPACT, CONCENTRATION = (20, 50), (1, 3), (1, 5), (30, 50)
REVENUE_DECLINE, LEGAL_LOSS, DISRUPTION = 5, 5, 3
LOW, MEDIUM, HIGH = (1, 3), (4, 6), (7, 10)

GENERAL_RULE = (
    "Judge how far this risk may affect earnings and cash flow in the coming one to two years, measured against the company's own revenue, "
    "operating income and net income, which are given. Use INSUFFICIENT only where no passage discusses the risk at all. "
    f"Boilerplate without facts or figures of the company scores {BOILERPLATE_MAX_SCORE} at most."
)

#: category -> what its low, medium and high bands mean.
BANDS: dict[str, tuple[str, str, str]] = {
    "FX Risk": (
        f"less than about {FOREIGN_REVENUE[0]}% of revenue is foreign, or currency effects stay below about {FX_IMPACT[0]}% of revenue",
        f"about {FOREIGN_REVENUE[0]} to {FOREIGN_REVENUE[1]}% of revenue is foreign and hedged; currency effects are about {FX_IMPACT[0]} to {FX_IMPACT[1]}% of revenue",
        f"most revenue is foreign, currency effects exceed about {FX_IMPACT[1]}% of revenue or operating income, emerging markets weigh in, or translation is mostly unhedged",
    ),
    "Interest Rate Risk": (
        f"little net debt, or debt mostly at fixed rates; 100 basis points more cost less than about {RATE_IMPACT[0]}% of net income",
        f"moderate debt, part of it at floating rates; 100 basis points more cost about {RATE_IMPACT[0]} to {RATE_IMPACT[1]}% of net income",
        f"heavy or mostly floating debt, 100 basis points more cost over about {RATE_IMPACT[1]}% of net income, or much debt matures soon",
    ),
    "Liquidity Risk": (
        "cash and operating cash flow cover what falls due soon with ease",
        "cash and operating cash flow cover what falls due soon",
        "cover is thin, or refinancing is relied on",
    ),
    "Revenue Risk": (
        f"no product, customer or region above about {CONCENTRATION[0]}% of revenue, revenue stable or rising, only general demand risks",
        f"one product, segment or region makes about {CONCENTRATION[0]} to {CONCENTRATION[1]}% of revenue, demand is cyclical, or revenue last fell by up to about {REVENUE_DECLINE}%",
        f"one product, customer or market makes most revenue, revenue last fell by more than about {REVENUE_DECLINE}%, or a named threat is material to it",
    ),
    "Legal Risk": (
        "routine matters only, without material accruals or estimates of possible losses",
        f"named matters or investigations, with accruals or possible losses below about {LEGAL_LOSS}% of net income",
        f"accruals or possible losses above about {LEGAL_LOSS}% of net income, matters that threaten a core product or the business, or repeated large settlements",
    ),
    "Operational Risk": (
        "many suppliers and sites, no disruption reported for the period",
        "single-source suppliers, few sites or cost pressure, without a stated material effect",
        f"disruptions with a stated effect above about {DISRUPTION}% of operating income, critical exposed supply, or a large restructuring",
    ),
}
NOTES = {
    "FX Risk": f"Score the gross exposure, then take off {HEDGING_MAX_REDUCTION} points at most for hedging; the reason names exposure and hedging apart.",
    "Interest Rate Risk": "Value changes of investment portfolios weigh less than changes of interest expense.",
}


def risk_level(score: Column) -> Column:
    """Low below 4, Medium below 7, else High; null for null. An overall score is divided by 10 first."""
    return F.when(score < 4, "Low").when(score < 7, "Medium").when(score.isNotNull(), "High")


def rubric_texts() -> dict[str, str]:
    """category -> its bands, one a line, and its note."""
    out = {}
    for category, texts in BANDS.items():
        lines = [f"{low}-{high}: {text}" for (low, high), text in zip((LOW, MEDIUM, HIGH), texts, strict=True)]
        out[category] = "\n".join(lines + ([NOTES[category]] if category in NOTES else []))
    return out


def rubric_text(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rubric_texts().items() for x in pair]), category)


def bands_table(spark: SparkSession) -> DataFrame:
    rows = [(c, low, high, text) for c, texts in BANDS.items() for (low, high), text in zip((LOW, MEDIUM, HIGH), texts, strict=True)]
    return spark.createDataFrame(rows, "category string, low int, high int, description string")


def overall_score(score: Column) -> Column:
    """Aggregate: the mean of the scores that are there, of 100; null with fewer than four. Halves go to the even side."""
    mean = F.sum(score) / (10.0 * F.count(score)) * 100
    return F.when(F.count(score) >= MIN_SCORED_CATEGORIES, F.bround(mean, 0).cast("int"))
