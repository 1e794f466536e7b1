"""Banding and labelling expressions, with their display order.

Bands are closed on the right, as in "up to and including 3 days".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelsight.functions.expressions import col

# Band labels in display order, and the upper edges they go with.
DELAY_BANDS = ["조기", "정시", "1-3일 지연", "4-6일 지연", "7-9일 지연", "10일 이상 지연"]
DELAY_EDGES = [3, 6, 9]
THRESHOLD_BANDS = ["조기", "정시", "1-3일 지연", "4일 이상 지연"]
DELAYED_SPLIT = ["1-3일 지연", "4일 이상 지연"]
DISPATCH_BANDS = ["당일-1일", "2-3일", "4-5일", "6일 이상"]
DISPATCH_EDGES = [1, 3, 5]
DISTANCE_BANDS = ["Urban/Last-Mile", "Short-Haul", "Mid-Haul", "Long-Haul", "Continental"]
DISTANCE_EDGES = [50, 250, 750, 1500]
RANK_BANDS = ["1위", "2위", "3위", "etc"]
RISK_LEVELS = ["고위험", "주의", "일반"]
EFFECT_LEVELS = ["Negligible", "Small", "Medium", "Large"]
EFFECT_LABELS = ["매우 작은 효과", "작은 효과", "중간 효과", "큰 효과"]
EFFECT_EDGES = [0.1, 0.3, 0.5]
CORRELATION_STRENGTHS = ["약한", "중간", "강한"]
CORRELATION_EDGES = [0.3, 0.5]
CORRELATION_SIGNS = ["음", "양"]
DELIVERY_STATUS = {1: "Delayed", 0: "On-time"}
SPEED_GROUPS = ["ontime_fast", "ontime_slow", "delayed"]
# Default probability limits of the risk levels.
HIGH_RISK_LIMIT = 0.47
CAUTION_LIMIT = 0.35
# What to do with an order of each risk level.
HIGH_RISK_ACTIONS = ["판매자 출고 상태 우선 확인", "예상 배송일 임박 전 고객 선제 안내", "CS 모니터링 대상 등록"]
PROMISE_REVIEW_ACTION = "추천 예상 배송일 기준으로 보수적 배송 약속 검토"
CAUTION_ACTIONS = ["배송 상태 모니터링 강화", "예상 배송일 초과 조짐 발생 시 고객 안내"]
NORMAL_ACTIONS = ["일반 처리"]


def right_closed(c: str | Column, edges: list, labels: list) -> Column:
    """Label by the first edge the value does not exceed; the last label is open."""
    c = col(c)
    out = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels):
        out = out.when(c <= F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def delay_band(delay_days: str | Column) -> Column:
    d = col(delay_days)
    late = right_closed(d, DELAY_EDGES, DELAY_BANDS[2:])
    return F.when(d < 0, DELAY_BANDS[0]).when(d == 0, DELAY_BANDS[1]).otherwise(late)


def threshold_band(delay_days: str | Column) -> Column:
    d = col(delay_days)
    late = right_closed(d, [3], THRESHOLD_BANDS[2:])
    return F.when(d < 0, THRESHOLD_BANDS[0]).when(d == 0, THRESHOLD_BANDS[1]).otherwise(late)


def delayed_split(delay_days: str | Column) -> Column:
    """Short against long delay; only meaningful for delayed orders."""
    return right_closed(delay_days, [3], DELAYED_SPLIT)


def dispatch_band(dispatch_days: str | Column) -> Column:
    return right_closed(dispatch_days, DISPATCH_EDGES, DISPATCH_BANDS)


def distance_band(distance_km: str | Column) -> Column:
    return right_closed(distance_km, DISTANCE_EDGES, DISTANCE_BANDS)


def distance_code(distance_km: str | Column) -> Column:
    return right_closed(distance_km, DISTANCE_EDGES, list(range(len(DISTANCE_BANDS))))


def rank_band(rank: str | Column) -> Column:
    return right_closed(rank, [1, 2, 3], RANK_BANDS)


def _left_closed(magnitude: Column, edges: list, labels: list) -> Column:
    out = F.when(magnitude.isNull(), None)
    for edge, label in zip(reversed(edges), reversed(labels)):
        out = out.when(magnitude >= F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(labels[0]))


def effect_level(r: str | Column) -> Column:
    return _left_closed(F.abs(col(r)), EFFECT_EDGES, EFFECT_LEVELS)


def effect_label(r: str | Column) -> Column:
    return _left_closed(F.abs(col(r)), EFFECT_EDGES, EFFECT_LABELS)


def correlation_strength(rho: str | Column) -> Column:
    magnitude = F.abs(col(rho))
    weak, medium, strong = CORRELATION_STRENGTHS
    return (F.when(magnitude > CORRELATION_EDGES[1], strong)
            .when(magnitude > CORRELATION_EDGES[0], medium)
            .when(magnitude.isNotNull(), weak))


def correlation_sign(rho: str | Column) -> Column:
    rho = col(rho)
    return F.when(rho < 0, CORRELATION_SIGNS[0]).when(rho.isNotNull(), CORRELATION_SIGNS[1])


def risk_level(risk: str | Column, high: float = HIGH_RISK_LIMIT,
               caution: float = CAUTION_LIMIT) -> Column:
    r = col(risk)
    return (F.when(r > high, RISK_LEVELS[0]).when(r > caution, RISK_LEVELS[1])
            .when(r.isNotNull(), RISK_LEVELS[2]))


def action_list(level: str | Column, adjustment_days: str | Column) -> Column:
    """What to do with an order; a promised-date review joins when days were added."""
    level = col(level)
    texts = lambda items: F.array(*map(F.lit, items))
    urgent = texts(HIGH_RISK_ACTIONS)
    with_review = F.array_insert(urgent, 2, F.lit(PROMISE_REVIEW_ACTION))
    return (
        F.when((level == RISK_LEVELS[0]) & (col(adjustment_days) > 0), with_review)
        .when(level == RISK_LEVELS[0], urgent)
        .when(level == RISK_LEVELS[1], texts(CAUTION_ACTIONS))
        .otherwise(texts(NORMAL_ACTIONS))
    )


def ordered_labels(spark, labels: list, name: str = "label"):
    """The fixed label list as a table with its display order."""
    return spark.createDataFrame(
        [(label, position) for position, label in enumerate(labels, 1)],
        f"{name} string, {name}_order int",
    )
