"""What a dashboard shows of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import MIN_SCORED_CATEGORIES
from lodestrata.functions.reasons import short_reason
from lodestrata.functions.rubric import risk_level
from lodestrata.functions.text import html_escape

# Colours and style classes of the levels, and the steps of the gauge.
LEVEL_COLORS = {"Low": "#28a745", "Medium": "#ffc107", "High": "#dc3545"}
LEVEL_CLASSES = {"Low": "low-risk", "Medium": "medium-risk", "High": "high-risk"}
UNSCORED_CLASS = "na-risk"
GAUGE_STEPS = ((0, 40, "#d4edda"), (40, 70, "#fff3cd"), (70, 100, "#f8d7da"))


def _mapped(key: Column, values: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def gauge(overall: Column) -> Column:
    """struct<value, level, color, steps> of an overall score."""
    level = risk_level(overall / 10)
    steps = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(c).alias("color")) for a, b, c in GAUGE_STEPS])
    return F.struct(overall.alias("value"), level.alias("level"), _mapped(level, LEVEL_COLORS).alias("color"), steps.alias("steps"))


def risk_card(category: Column, score: Column, reason: Column) -> Column:
    """A category's card as HTML."""
    level = risk_level(score)
    shown = F.coalesce(F.concat(score.cast("string"), F.lit("/10 · "), level), F.lit("n/a"))
    return F.concat(
        F.lit('<div class="risk-card '), _mapped(level, LEVEL_CLASSES, UNSCORED_CLASS), F.lit('"><div class="card-head"><span>'),
        F.replace(category, F.lit(" Risk"), F.lit("")), F.lit('</span><span class="card-score">'), shown,
        F.lit('</span></div><div class="card-line">'), html_escape(short_reason(reason)), F.lit("</div></div>"),
    )


def dashboard_status(overall: Column, scored: Column, categories: Column) -> Column:
    """Why there is no overall score, or how many categories it leaves out; null if it is whole."""
    return F.when(
        overall.isNull(),
        F.concat(F.lit("No overall score: only "), scored.cast("string"), F.lit(" of "), categories.cast("string"), F.lit(f" categories could be scored (at least {MIN_SCORED_CATEGORIES} needed).")),
    ).when(
        scored < categories,
        F.concat((categories - scored).cast("string"), F.lit(" of "), categories.cast("string"), F.lit(" categories could not be scored and are left out of the overall score.")),
    )
