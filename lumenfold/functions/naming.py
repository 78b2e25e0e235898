"""Titles, emoji and reasons of albums, seasons and holidays, all as Spark columns over album rows.

Album rows have: kind, n, date_start, date_end (epoch ms or null), nights, place_name, place_known, place_home,
subtype, scene_label, device_model, year and month (of monthly albums).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Album names, words and phrases as users read them.
SEASON_OF_MONTH = {1: "冬", 2: "冬", 3: "春", 4: "春", 5: "春", 6: "夏", 7: "夏", 8: "夏", 9: "秋", 10: "秋", 11: "秋", 12: "冬"}
SEASON_WORD = {1: "冬", 2: "冬", 3: "春", 4: "桜", 5: "新緑", 6: "梅雨", 7: "夏", 8: "夏", 9: "秋", 10: "秋", 11: "紅葉", 12: "冬"}
SEASON_EMOJI = {1: "❄️", 2: "❄️", 3: "🌸", 4: "🌸", 5: "🌿", 6: "☔", 7: "🌻", 8: "🌻", 9: "🍂", 10: "🍁", 11: "🍁", 12: "❄️"}
FIXED_HOLIDAYS = {(1, 1): "元日", (2, 11): "建国記念の日", (4, 29): "昭和の日", (5, 3): "憲法記念日", (5, 4): "みどりの日", (5, 5): "こどもの日", (11, 3): "文化の日", (11, 23): "勤労感謝の日"}
SCENE_TITLES = {"青空": "青空コレクション", "夜景": "夜さんぽ", "夕焼け": "夕焼けの記録", "みどり": "みどりの写真", "グルメ": "おいしいもの記録", "モノクロ": "モノクロ写真", "人物": "だれかとの写真", "あたたかい色": "あたたかい色の写真"}
SCENE_EMOJI = {"青空": "☁️", "夜景": "🌙", "夕焼け": "🌇", "みどり": "🌿", "グルメ": "🍽️", "モノクロ": "🎞️", "人物": "👥", "あたたかい色": "🎨"}
SCENE_PHRASES = {
    "青空": "青空がきれいな写真を",
    "夜景": "夜に撮った写真を",
    "夕焼け": "あたたかい夕方の色をした写真を",
    "みどり": "緑や自然が多い写真を",
    "グルメ": "おいしそう…料理っぽい写真を",
    "モノクロ": "色みの少ないモノクロっぽい写真を",
    "人物": "人物っぽい写真を",
    "あたたかい色": "あたたかい色あいの写真を",
}
UNSURE_SCENES = ("グルメ", "人物", "あたたかい色")
CONFIDENCE_LABELS = {"high": "高", "med": "中", "low": "低"}
CONFIDENCE_WORDS = {"high": "かなり自信あり", "med": "まあまあ自信あり", "low": "自信ひかえめ"}
CONFIDENCE_DOTS = {"high": 3, "med": 2, "low": 1}


def looked_up(key: Column, table: dict, other: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out if other is None else out.otherwise(other)


def date_of(ms: Column) -> Column:
    """The day of an epoch time in ms; wall clocks are kept as UTC, so no zone is applied."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


def month_day(ms: Column) -> Column:
    return F.concat(F.month(date_of(ms)).cast("string"), F.lit("月"), F.dayofmonth(date_of(ms)).cast("string"), F.lit("日"))


def holiday(ms: Column) -> Column:
    """The name of a Japanese holiday, or null. The years, the days and the numbers of the equinoxes."""
    date = date_of(ms)
    y, m, d = F.year(date), F.month(date), F.dayofmonth(date)
    out = F.when(F.lit(False), "")
    for (month, day), name in FIXED_HOLIDAYS.items():
        out = out.when((m == month) & (d == day), name)
    out = out.when(y.between(1989, 2018) & (m == 12) & (d == 23) | (y >= 2020) & (m == 2) & (d == 23), "天皇誕生日")
    out = out.when((y >= 2016) & (m == 8) & (d == 11), "山の日")
    monday = F.dayofweek(date) == 2
    for month, nth, name in ((1, 2, F.lit("成人の日")), (7, 3, F.lit("海の日")), (9, 3, F.lit("敬老の日")), (10, 2, F.when(y >= 2020, "スポーツの日").otherwise("体育の日"))):
        out = out.when((m == month) & monday & (F.ceil(d / 7) == nth), name)
    for month, base, name in ((3, 20.8431, "春分の日"), (9, 23.2488, "秋分の日")):
        out = out.when((m == month) & (d == F.floor(base + 0.242194 * (y - 1980) - F.floor((y - 1980) / 4))), name)
    return out


@F.pandas_udf(T.StringType())
def one_decimal(seconds: pd.Series) -> pd.Series:
    """A number with one decimal, ties of its exact binary value upward. For albums only, which are few."""
    return seconds.map(lambda x: None if pd.isna(x) else str(Decimal(float(x)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)))


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def title_and_emoji() -> tuple[Column, Column]:
    c, n = F.col, F.col("n").cast("string")
    nights, known, home = F.coalesce(c("nights"), F.lit(0)), F.coalesce(c("place_known"), F.lit(False)), F.coalesce(c("place_home"), F.lit(False))
    stay = F.when(nights > 0, _said(nights.cast("string"), "泊", (nights + 1).cast("string"), "日の旅")).otherwise("日帰り旅")
    start = F.coalesce(c("date_start"), F.lit(0))
    day = F.coalesce(F.when(c("date_start").isNotNull(), holiday(c("date_start"))), month_day(start))
    title = (
        F.when(c("kind") == "trip", F.when(known, _said(c("place_name"), "、", stay)).otherwise("はじめての場所への旅"))
        .when(c("kind") == "place", F.when(home, "いつもの場所").when(known, _said(c("place_name"), "あたり")).otherwise("はじめての場所"))
        .when(c("kind") == "day", _said(day, "のおでかけ"))
        .when(c("kind") == "burst", F.when(c("subtype") == "dup", "にたものコレクション").otherwise(_said("そっくりさんフォト（", n, "枚）")))
        .when(c("kind") == "scene", looked_up(c("scene_label"), SCENE_TITLES, F.lit("いろいろな写真")))
        .when(c("kind") == "screenshot", "スクショ整理")
        .when(c("kind") == "device", _said(F.coalesce(c("device_model"), F.lit("このカメラ")), "で撮った写真"))
        .when(c("year").isNotNull(), _said(c("year").cast("string"), "年", c("month").cast("string"), "月のこと"))
        .otherwise("いつかの写真たち")
    )
    emoji = (
        F.when(c("kind") == "trip", F.when(known, "🚅").otherwise("🧭"))
        .when(c("kind") == "place", F.when(home, "🏠").otherwise("📍"))
        .when(c("kind") == "day", looked_up(F.month(date_of(start)), SEASON_EMOJI))
        .when(c("kind") == "burst", F.when(c("subtype") == "dup", "🖇️").otherwise("👯"))
        .when(c("kind") == "scene", looked_up(c("scene_label"), SCENE_EMOJI, F.lit("🗂️")))
        .when(c("kind") == "screenshot", "📱")
        .when(c("kind") == "device", "📷")
        .otherwise("🗓️")
    )
    return title, emoji


def reason() -> Column:
    c, n = F.col, F.col("n").cast("string")
    nights, known, home = F.coalesce(c("nights"), F.lit(0)), F.coalesce(c("place_known"), F.lit(False)), F.coalesce(c("place_home"), F.lit(False))
    dated, none = c("date_start").isNotNull(), F.lit("")
    span = F.when(dated & (c("date_start") != c("date_end")), _said(month_day(c("date_start")), "〜", month_day(c("date_end")), "の")).otherwise(none)
    stay = F.when(nights > 0, _said(nights.cast("string"), "泊", (nights + 1).cast("string"), "日ぶんの")).otherwise("日帰りの")
    seconds = (c("date_end") - c("date_start")) / 1000
    lasted = F.when(seconds > 0, _said(one_decimal(F.when((c("kind") == "burst") & (c("subtype") != "dup"), seconds)), "秒のあいだの")).otherwise(none)
    device = F.coalesce(c("device_model"), F.lit("このカメラ"))
    return (
        F.when(c("kind") == "trip", _said(span, stay, "おでかけっぽい", n, "枚を、ひとつの旅としてまとめたよ。"))
        .when(c("kind") == "day", _said(F.when(dated, _said(month_day(c("date_start")), "・")).otherwise(none), F.when(known, _said(c("place_name"), "あたりで")).otherwise(none), "近い時間に撮った", n, "枚を、その日のできごととしてまとめたよ。"))
        .when(c("kind") == "place", F.when(home, _said("いつもよく撮っている場所の", n, "枚をあつめたよ。")).otherwise(_said(F.when(known, _said(c("place_name"), "の近く")).otherwise("同じ場所"), "で撮った", n, "枚をまとめたよ。")))
        .when((c("kind") == "burst") & (c("subtype") == "dup"), _said("そっくりな写真が", n, "枚。見比べやすいようにまとめて、いちばん良い1枚を表紙にしたよ。"))
        .when(c("kind") == "burst", _said(lasted, "連写", n, "枚。いちばんくっきりした1枚を表紙にしたよ。"))
        .when(c("kind") == "scene", _said(looked_up(c("scene_label"), SCENE_PHRASES, F.lit("雰囲気の似た写真を")), n, "枚みつけたよ。", F.when(c("scene_label").isin(*UNSURE_SCENES), "（自信ひかえめ）").otherwise(none)))
        .when(c("kind") == "screenshot", _said("カメラで撮っていない、スクショや書類っぽい写真を", n, "枚あつめたよ。"))
        .when(c("kind") == "device", _said(device, "で撮った写真を", n, "枚あつめたよ。"))
        .when(c("year").isNotNull(), _said(c("year").cast("string"), "年", c("month").cast("string"), "月に撮った、どのアルバムにも入らなかった", n, "枚をここにまとめておいたよ。"))
        .otherwise(_said("撮影日時がわからなかった", n, "枚を、ここにまとめておいたよ。"))
    )


def season_of(month: Column) -> Column:
    return looked_up(month, SEASON_OF_MONTH)


def relative_name(home: Column, seen: Column) -> Column:
    return F.when(home, "いつもの場所").when(seen, "この場所").otherwise("はじめての場所")


def date_range_text(start: Column, end: Column) -> Column:
    """`M/D`, or `M/D〜M/D` over two days."""

    def short(ms: Column) -> Column:
        return F.concat_ws("/", F.month(date_of(ms)), F.dayofmonth(date_of(ms)))

    return F.when(start.isNull(), "日付不明").when(short(start) == short(end), short(start)).otherwise(_said(short(start), "〜", short(end)))


def confidence_dots(confidence: Column) -> Column:
    return looked_up(confidence, CONFIDENCE_DOTS)


def confidence_label(confidence: Column) -> Column:
    return looked_up(confidence, CONFIDENCE_LABELS)


def confidence_word(confidence: Column) -> Column:
    return looked_up(confidence, CONFIDENCE_WORDS)


def exif_text_ms(text: Column) -> Column:
    """Epoch ms of `YYYY:MM:DD HH:MM:SS` as a wall clock; parts beyond their range carry over; null for anything else."""
    form = r"^([0-9]{4}):([0-9]{2}):([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})"
    y, mo, d, h, mi, s = (F.try_to_number(F.nullif(F.regexp_extract(F.trim(text), form, k), F.lit("")), F.lit("9999")).cast("int") for k in range(1, 7))
    month = F.add_months(F.make_date(F.when(y < 100, y + 1900).otherwise(y), F.lit(1), F.lit(1)), mo - 1)
    days = F.unix_date(F.date_add(month, d - 1)).cast("long")
    return F.when((y > 0) & (mo > 0) & (d > 0), days * 86_400_000 + ((h * 60 + mi) * 60 + s).cast("long") * 1000)
