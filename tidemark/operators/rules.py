"""Decisions: multipliers, verdicts, alerts, trajectories and their texts, as expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Multipliers of daily volatility by regime (fixed values).
PRICE_MULTIPLIER = {"Stochastic": 1.0, "Transitional": 1.4, "Deterministic": 2.2}
VOLUME_MULTIPLIER = {"Consensus Flow": 1.0, "Dispersed Flow": 1.3, "Erratic/Noisy Flow": 1.8}
#: Bounds of daily volatility in percent (fixed values).
LOW, MIDDLE, HIGH = 0.8, 1.5, 2.5
#: Verdicts by level (below 0.8, from 0.8, 1.5, 2.5), as the running code has them: deterministic, all others (fixed values).
VERDICT_CODE = {
    0: ("CALM MARKET", "CALM MARKET"), 1: ("STRUCTURAL WARNING", "MODERATE RISK"),
    2: ("HIGH RISK", "MODERATE RISK"), 3: ("EXTREME RISK", "ELEVATED VOLATILITY"),
}
#: The same as documented: stochastic, transitional, deterministic (fixed values).
VERDICT_SPEC = {
    0: ("LOW RISK", "STRUCTURAL BUILD-UP", "STRUCTURAL WARNING"), 1: ("LOW-MODERATE", "MODERATE RISK", "STRUCTURAL WARNING"),
    2: ("ELEVATED VOLATILITY", "HIGH RISK", "HIGH RISK"), 3: ("ELEVATED VOLATILITY", "HIGH RISK", "EXTREME RISK"),
}
#: Alert names of price regimes (fixed values).
ALERT_NAMES = {"Deterministic": "Chaos", "Transitional": "Fragile", "Stochastic": "Stable"}
TREND = 0.005


def lookup(key: Column | str, table: dict, default=None) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    mapping = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(mapping, F.coalesce(key, F.lit(""))), F.lit(default))


def multipliers(df: DataFrame, regime: str = "regime", flow: str = "flow", sigma: str = "sigma") -> DataFrame:
    """price_mult, volume_mult, the larger one with its source (Price on ties), and sigma scaled by it."""
    own = df.withColumns({"price_mult": lookup(regime, PRICE_MULTIPLIER, 1.0), "volume_mult": lookup(flow, VOLUME_MULTIPLIER, 1.0)})
    own = own.withColumn("mult", F.greatest("price_mult", "volume_mult"))
    return own.withColumns({"mult_source": F.when(F.col("price_mult") >= F.col("volume_mult"), "Price").otherwise("Volume"), "sigma_adjusted": F.round(F.col(sigma) * F.col("mult") + 1e-9, 4)})  # halves go up, whatever their binary form


def level(sigma: Column) -> Column:
    return F.when(sigma >= HIGH, 3).when(sigma >= MIDDLE, 2).when(sigma >= LOW, 1).when(sigma.isNotNull(), 0)


def verdict(sigma: Column, regime: Column, mode: str = "code") -> Column:
    at, out = level(sigma), F.lit(None).cast("string")
    for k in range(4):
        if mode == "code":
            own = F.when(regime == "Deterministic", VERDICT_CODE[k][0]).otherwise(VERDICT_CODE[k][1])
        else:
            own = F.when(regime == "Stochastic", VERDICT_SPEC[k][0]).when(regime == "Transitional", VERDICT_SPEC[k][1]).when(regime == "Deterministic", VERDICT_SPEC[k][2])
        out = F.when(at == k, own).otherwise(out)
    return out


def zone(sigma: Column) -> Column:
    return F.when(sigma >= MIDDLE, "danger").when(sigma >= LOW, "caution").when(sigma.isNotNull(), "calm")


def breadth(cse: Column) -> Column:
    return F.when(cse < 40, "COHESIVE").when(cse > 70, "DISLOCATED").otherwise("FRAGMENTING")


def alert(regime: Column, flow: Column, vol_global_z: Column, sigma: Column) -> Column:
    """Planes that disagree: a fractured volume under a coordinated price, a thin calm, or a climax of volume."""
    return (
        F.when((regime == "Deterministic") & flow.isin("Dispersed Flow", "Erratic/Noisy Flow"), "HOLLOW RALLY")
        .when((regime == "Stochastic") & (vol_global_z < 0), "CAPITULATION VACUUM")
        .when((vol_global_z > 0) & (sigma >= MIDDLE), "CLIMAX DISTRIBUTION").otherwise("NONE")
    )


def trajectory(v: Column, a: Column) -> Column:
    v, a = F.coalesce(v, F.lit(0.0)), F.coalesce(a, F.lit(0.0))
    return (
        F.when((v > 0) & (a > 0), "accelerating_up").when((v > 0) & (a < 0), "rising_slower")
        .when((v < 0) & (a < 0), "cooling_fast").when((v < 0) & (a > 0), "falling_slower").otherwise("stationary")
    )


def trend(v: Column) -> Column:
    v = F.coalesce(v, F.lit(0.0))
    return F.when(v > TREND, "rising").when(v < -TREND, "falling").otherwise("stable")


def conclusion_key(regime: Column, v: Column, above: Column) -> Column:
    """Which of the ten conclusions holds."""
    side = F.when(F.coalesce(above, F.lit(False)), "above").otherwise("below")
    up = F.when(trend(v) == "rising", "rising").otherwise("other")
    return F.when(regime.isin("Stochastic", "Transitional"), F.concat_ws("/", regime, trend(v))).when(regime == "Deterministic", F.concat_ws("/", regime, side, up))


#: What each conclusion says, in own words: English, Vietnamese.
TEXTS = {
    "Stochastic/rising": ("Prices are diverse and growing more so; daily volatility is {s} %.", "Giá đa dạng và ngày càng đa dạng; biến động ngày {s} %."),
    "Stochastic/falling": ("Prices are still diverse but order is building; daily volatility is {s} %.", "Giá còn đa dạng nhưng trật tự đang hình thành; biến động ngày {s} %."),
    "Stochastic/stable": ("Prices are diverse and steady; daily volatility is {s} %.", "Giá đa dạng và ổn định; biến động ngày {s} %."),
    "Transitional/rising": ("The market is between states and easing; daily volatility is {s} %.", "Thị trường chuyển tiếp và dịu đi; biến động ngày {s} %."),
    "Transitional/falling": ("The market is between states and tightening; daily volatility is {s} %.", "Thị trường chuyển tiếp và siết lại; biến động ngày {s} %."),
    "Transitional/stable": ("The market is between states; daily volatility is {s} %.", "Thị trường chuyển tiếp; biến động ngày {s} %."),
    "Deterministic/above/rising": ("Coordinated buying begins to loosen; daily volatility is {s} %.", "Lực mua đồng loạt bắt đầu nới; biến động ngày {s} %."),
    "Deterministic/above/other": ("Coordinated buying holds; a crowded rise is fragile; daily volatility is {s} %.", "Lực mua đồng loạt kéo dài, đà tăng mong manh; biến động ngày {s} %."),
    "Deterministic/below/rising": ("Coordinated selling begins to loosen; daily volatility is {s} %.", "Lực bán đồng loạt bắt đầu nới; biến động ngày {s} %."),
    "Deterministic/below/other": ("Coordinated selling holds; losses may run on; daily volatility is {s} %.", "Lực bán đồng loạt kéo dài; biến động ngày {s} %."),
}


def conclusion(df: DataFrame, key: str = "conclusion_key", sigma: str = "sigma_adjusted", language: str = "en") -> DataFrame:
    """``conclusion``: the key's text, from a table of ten rows."""
    at = 0 if language == "en" else 1
    texts = df.sparkSession.createDataFrame([(k, v[at]) for k, v in TEXTS.items()], "text_key string, text string")
    own = df.join(F.broadcast(texts), F.col(key) == F.col("text_key"), "left")
    return own.withColumn("conclusion", F.replace("text", F.lit("{s}"), F.format_string("%.2f", F.col(sigma)))).drop("text", "text_key")


#: The other paragraphs, in own words: English, Vietnamese.  {s}, {a}, {m}, {x}, {e}, {f} are numbers, {flow} a label.
PARAGRAPHS = {
    "volatility/entropy": ("Daily volatility is {s} % ({a} % a year); entropy explains part of it: price {p}, volume {v}.", "Biến động ngày {s} % ({a} % năm); entropy giải thích một phần: giá {p}, khối lượng {v}."),
    "volatility/plain": ("Daily volatility is {s} % ({a} % a year); entropy adds nothing significant to it at present.", "Biến động ngày {s} % ({a} % năm); hiện entropy không bổ sung thông tin có ý nghĩa."),
    "volatility/none": ("No volatility model: too few complete bars.", "Chưa có mô hình biến động: quá ít dữ liệu đầy đủ."),
    "regime/Stochastic": ("Price entropy is high: many views, none dominates.", "Entropy giá cao: nhiều quan điểm, không bên nào áp đảo."),
    "regime/Transitional": ("Price entropy is in the middle: the structure is changing.", "Entropy giá ở mức giữa: cấu trúc đang thay đổi."),
    "regime/Deterministic/above": ("Price entropy is low while prices rise: buyers move as one.", "Entropy giá thấp khi giá tăng: bên mua hành động đồng loạt."),
    "regime/Deterministic/below": ("Price entropy is low while prices fall: sellers move as one.", "Entropy giá thấp khi giá giảm: bên bán hành động đồng loạt."),
    "volume/Consensus Flow": ("Volume is orderly and carries the price.", "Dòng tiền có trật tự và nâng đỡ giá."),
    "volume/Dispersed Flow": ("Volume is split; a sudden move finds little depth.", "Dòng tiền phân tán; thiếu chiều sâu trước biến động đột ngột."),
    "volume/Erratic/Noisy Flow": ("Volume is erratic: panic or speculation.", "Dòng tiền thất thường: hoảng loạn hoặc đầu cơ."),
    "multiplier/volume": ("Prices need no surcharge; {flow} raises {s} % by {m} to {x} %.", "Giá không cần hệ số; {flow} nâng {s} % lên {m} lần thành {x} %."),
    "multiplier/both": ("Price and volume regimes raise {s} % by {m} to {x} %.", "Chế độ giá và khối lượng nâng {s} % lên {m} lần thành {x} %."),
    "multiplier/none": ("No regime raises the {s} % ({a} % a year).", "Không chế độ nào nâng mức {s} % ({a} % năm)."),
    "tail/adjusted": ("On the worst days, one in twenty, the mean loss is {e} %; with today's breadth {f} %, a {w} tail than usual.", "Trong 5 % ngày xấu nhất, lỗ trung bình {e} %; theo độ rộng hôm nay {f} %, đuôi {w} hơn thường lệ."),
    "tail/plain": ("On the worst days, one in twenty, the mean loss is {e} %.", "Trong 5 % ngày xấu nhất, lỗ trung bình {e} %."),
    "watch/rising": ("Watch whether entropy keeps rising over the next two weeks.", "Theo dõi entropy có tiếp tục tăng trong hai tuần tới."),
    "watch/falling": ("Watch for entropy falling further: that leads to coordinated moves.", "Theo dõi entropy giảm thêm: dẫn tới hành động đồng loạt."),
    "watch/stable": ("Watch for a change of the entropy trend.", "Theo dõi thay đổi xu hướng entropy."),
    "watch/other": ("Watch the average of 20 bars: a cross ends this phase.", "Theo dõi trung bình 20 phiên: cắt qua sẽ kết thúc pha này."),
}
WORDS = {"up": ("raises it", "làm tăng"), "down": ("lowers it", "làm giảm"), "fatter": ("fatter", "dày"), "thinner": ("thinner", "mỏng")}


def paragraph_keys() -> dict[str, Column]:
    """Key of each paragraph, from garch_type, regime, above_sma20, flow, mult, es_5pct(_adjusted) and conclusion_key; null: none."""
    c = F.col
    side = F.when(F.coalesce(c("above_sma20"), F.lit(False)), "above").otherwise("below")
    return {
        "volatility": F.when(c("garch_type") == "GARCH-X", "volatility/entropy").when(c("garch_type").isNotNull(), "volatility/plain").otherwise("volatility/none"),
        "regime": F.when(c("regime") == "Deterministic", F.concat(F.lit("regime/Deterministic/"), side)).when(c("regime").isNotNull(), F.concat(F.lit("regime/"), "regime")),
        "volume": F.concat(F.lit("volume/"), "flow"),
        "multiplier": F.when(c("sigma").isNull(), None).when(c("mult") <= 1, "multiplier/none").when(c("regime") == "Stochastic", "multiplier/volume").otherwise("multiplier/both"),
        "tail": F.when(c("es_5pct_adjusted").isNotNull(), "tail/adjusted").when(c("es_5pct").isNotNull(), "tail/plain"),
        "watch": F.concat(F.lit("watch/"), F.regexp_extract("conclusion_key", "[^/]+$", 0)),
    }


def paragraphs(df: DataFrame, language: str = "en") -> DataFrame:
    """``<name>_text`` for each paragraph, from a table of a few rows and the row's numbers (sigma_annual_pct, delta_h_price and delta_h_volume too)."""
    at = 0 if language == "en" else 1
    texts = F.create_map(*(F.lit(x) for k, v in PARAGRAPHS.items() for x in (k, v[at])))
    word = lambda test, yes, no: F.when(test, WORDS[yes][at]).otherwise(WORDS[no][at])
    number = lambda x, digits=2: F.format_string(f"%.{digits}f", F.col(x))
    marks = {
        "{s}": number("sigma", 3), "{a}": number("sigma_annual_pct", 1), "{x}": number("sigma_adjusted", 3), "{m}": number("mult", 1), "{e}": number("es_5pct"), "{f}": number("es_5pct_adjusted"), "{flow}": F.col("flow"),
        "{p}": word(F.col("delta_h_price") > 0, "up", "down"), "{v}": word(F.col("delta_h_volume") > 0, "up", "down"), "{w}": word(F.abs("es_5pct_adjusted") > F.abs("es_5pct"), "fatter", "thinner"),
    }
    out = {}
    for name, key in paragraph_keys().items():
        used = {m for k, v in PARAGRAPHS.items() if k.startswith(f"{name}/") for m in marks if m in v[at]}
        text = F.try_element_at(texts, key)
        for m in sorted(used):
            text = F.replace(text, F.lit(m), F.coalesce(marks[m], F.lit("?")))
        out[f"{name}_text"] = text
    return df.withColumns(out)


def market_verdict(groups: Column, p: Column, paradox: Column) -> Column:
    """SKIP below two groups, FAIL without the expected order of means; with it PASS if the test is significant, else PARTIAL."""
    return F.when(F.coalesce(groups, F.lit(0)) < 2, "SKIP").when(~F.coalesce(paradox, F.lit(False)), "FAIL").when(p < 0.05, "PASS").otherwise("PARTIAL")
