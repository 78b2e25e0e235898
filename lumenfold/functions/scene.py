"""Scene labels: an ordered table of rules, of which the first that holds gives label and confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import hex_channel

# The labels, and how screenshots are named.
SCREENSHOT, NIGHT, SUNSET, SKY, GREEN, FOOD, MONO, PEOPLE, WARM, MISC = "スクショ", "夜景", "夕焼け", "青空", "みどり", "グルメ", "モノクロ", "人物", "あたたかい色", "いろいろ"
SCREENSHOT_NAME = r"(?i)scre[ _-]?shot|スクリーンショット|スクショ"

Rules = Callable[[Column], list[tuple[str, Column]]]


def warm_hue(top_hex: Column) -> Column:
    """Whether the hue of the main colour is 330 to 360 or 0 to 45; false without one.

    In whole numbers, as 45 and 330 are told exactly. Only hues beside red are worked out, so that the condition stays small wherever the
    optimizer copies it to.
    """
    r, g, b = (hex_channel(top_hex, at) for at in range(3))
    yellow, purple = (g - b) * 4 <= (r - b) * 3, (b - g) * 2 <= r - g
    return F.coalesce((r >= g) & (r >= b) & F.when(g >= b, yellow).otherwise(purple), F.lit(False))


def rules(warm: Column) -> list[tuple[str, Column]]:
    """(label, score) in order; a null score means that the rule doesn't hold. The order and all thresholds."""
    c = F.col
    named = F.coalesce(c("name").rlike(SCREENSHOT_NAME), F.lit(False))
    filmed = F.coalesce(c("camera_make"), F.lit("")) != ""
    flat = ~filmed & (c("edge_density") > 0.3) & (c("brightness") > 0.75) & (c("saturation") < 0.25)
    return [
        (SCREENSHOT, F.when(named & flat, 0.95).when(named, 0.85).when(flat, 0.65)),
        (NIGHT, F.when(c("brightness") < 0.12, 0.8).when(c("brightness") < 0.22, 0.66).when((c("iso") >= 1600) & (c("brightness") < 0.4), 0.6)),
        (SUNSET, F.when(warm & (c("aspect") >= 1.2) & (c("warmth") > 0.12) & c("brightness").between(0.3, 0.78) & (c("colorfulness") > 25), 0.6)),
        (SKY, F.when((c("blue_top_ratio") > 0.4) & (c("brightness") > 0.55) & (c("edge_density") < 0.15), F.least(F.lit(0.85), c("blue_top_ratio") - 0.4 + 0.6))),
        (GREEN, F.when((c("green_ratio") > 0.35) & (c("saturation") > 0.3), F.least(F.lit(0.85), c("green_ratio") - 0.35 + 0.6))),
        (FOOD, F.when((c("warmth") > 0.05) & (c("saturation") > 0.4) & (c("colorfulness") > 40) & (c("edge_density") < 0.35), 0.56)),
        (MONO, F.when((c("saturation") < 0.12) & filmed & (c("edge_density") < 0.5) & (c("brightness") > 0.1), 0.7)),
        (PEOPLE, F.when((c("aspect") < 1) & (c("f_number") < 2.8) & warm & (c("saturation") > 0.15) & (c("saturation") < 0.6), 0.56)),
        (WARM, F.when(c("warmth") > 0.15, 0.5)),
    ]


def classify(photos: DataFrame, own_rules: Rules = rules) -> DataFrame:
    """`photos` with `scene` (the label of the first rule that holds, or one for the rest) and `scene_confidence`.

    `own_rules` maps a column (whether the main colour is reddish) to (label, score) pairs over the columns of photos.
    """
    told = own_rules(F.col("__warm"))
    # the rules once, as an array: twice in one CASE each, beside what the photos come of, are a method too long for the JVM to compile
    held = F.filter(F.array(*(F.struct(F.lit(name).alias("scene"), score.cast("double").alias("score")) for name, score in told)), lambda rule: rule["score"].isNotNull())
    rows = photos.withColumn("__warm", warm_hue(F.col("top_hex"))).withColumn("__first", F.get(held, F.lit(0)))
    found = {"scene": F.coalesce("__first.scene", F.lit(MISC)), "scene_confidence": F.coalesce("__first.score", F.lit(0.4))}
    return rows.withColumns(found).drop("__warm", "__first")


def labelled(photos: DataFrame, floor: float = 0.55, own_rules: Rules = rules) -> DataFrame:
    """`photos` with `label`: the scene if it can make an album, else null."""
    makes = (F.col("scene_confidence") >= floor) & ~F.col("scene").isin(MISC, PEOPLE)
    held = [c for c in photos.columns if c in ("scene", "scene_confidence")]
    found = classify(photos.withColumnsRenamed({c: f"__own_{c}" for c in held}), own_rules).withColumn("label", F.when(makes, F.col("scene"))).drop("scene", "scene_confidence")
    return found.withColumnsRenamed({f"__own_{c}": c for c in held})
