"""Registered queries: risk levels, promised dates and work lists on a known score."""

from pyspark.sql import functions as F

from parcelsight.functions import bands
from parcelsight.plans import features, scoring
from parcelsight.plans.catalog.registry import Inputs, register
from parcelsight.plans.catalog.splitting import _SCORED, scored_lines

_DECIDED = _SCORED + """
, d AS (SELECT order_id, 1 - p AS risk, p * 50 AS pred, expected_delivery_days AS e,
  greatest(expected_delivery_days::DOUBLE, ceil(p * 50)) AS rec,
  CASE WHEN 1 - p > 0.47 THEN '고위험' WHEN 1 - p > 0.35 THEN '주의' ELSE '일반' END AS level
  FROM scored)"""


def decided_lines(q: Inputs):
    """Scored lines with risk, predicted days and the resulting decision."""
    rows = scored_lines(q).select(
        "order_id", "expected_delivery_days",
        scoring.risk_probability("probability").alias("review_risk_probability"),
        (F.col("probability") * 50).alias("predicted_delivery_days_quantile"))
    return scoring.with_decision(rows)


@register("p1_p2_risk_level", _DECIDED + """
SELECT order_id, round(risk, 6) AS review_risk_probability, level AS risk_level FROM d""")
def _(q: Inputs):
    return decided_lines(q).select("order_id", "review_risk_probability", "risk_level")


@register("p2_risk_level_custom_limits", _DECIDED + """
SELECT CASE WHEN risk > 0.6 THEN '고위험' WHEN risk > 0.2 THEN '주의' ELSE '일반' END
  AS risk_level, count(*) AS n FROM d GROUP BY 1""")
def _(q: Inputs):
    level = bands.risk_level("review_risk_probability", high=0.6, caution=0.2)
    return decided_lines(q).groupBy(level.alias("risk_level")).agg(F.count("*").alias("n"))


@register("p3_recommended_days", _DECIDED + """
SELECT order_id, round(pred, 6) AS predicted_delivery_days_quantile,
  rec AS recommended_expected_days, rec - e AS adjustment_days, risk > 0.47 AS is_track_c_target
FROM d""")
def _(q: Inputs):
    return decided_lines(q).select(
        "order_id", "predicted_delivery_days_quantile", "recommended_expected_days",
        "adjustment_days", "is_track_c_target")


@register("p4_recommended_days_with_slack", _DECIDED + """
SELECT order_id, greatest(e::DOUBLE, ceil(pred - 3)) AS recommended_expected_days FROM d""")
def _(q: Inputs):
    return decided_lines(q).select("order_id", scoring.recommended_days(
        "expected_delivery_days", "predicted_delivery_days_quantile", slack_days=3,
    ).alias("recommended_expected_days"))


@register("p6_action_lists", _DECIDED + """
SELECT order_id, level AS risk_level, CASE
  WHEN level = '고위험' AND rec - e > 0 THEN '판매자 출고 상태 우선 확인|'
    || '추천 예상 배송일 기준으로 보수적 배송 약속 검토|예상 배송일 임박 전 고객 선제 안내|'
    || 'CS 모니터링 대상 등록'
  WHEN level = '고위험' THEN '판매자 출고 상태 우선 확인|예상 배송일 임박 전 고객 선제 안내|'
    || 'CS 모니터링 대상 등록'
  WHEN level = '주의' THEN '배송 상태 모니터링 강화|예상 배송일 초과 조짐 발생 시 고객 안내'
  ELSE '일반 처리' END AS actions FROM d""")
def _(q: Inputs):
    actions = bands.action_list("risk_level", "adjustment_days")
    return decided_lines(q).select("order_id", "risk_level",
                                   F.array_join(actions, "|").alias("actions"))


@register("p7_high_risk_orders", _DECIDED + """
SELECT order_id, round(max(risk), 6) AS review_risk_probability FROM d WHERE level = '고위험'
GROUP BY 1""")
def _(q: Inputs):
    return scoring.high_risk_orders(decided_lines(q)).select("order_id", "review_risk_probability")


@register("l4_p8_top_risky_rows", _DECIDED + """
SELECT order_id, round(risk, 6) AS review_risk_probability FROM d WHERE level = '고위험'
ORDER BY risk DESC, order_id LIMIT 20""")
def _(q: Inputs):
    return scoring.top_rows(decided_lines(q), 20).select("order_id", "review_risk_probability")


@register("p9_what_if_features", """
, w AS (SELECT *, expected_delivery_days + 7 AS e2, coalesce(('NATION_0' <> seller_state)::INTEGER,
    1) AS x2, coalesce((seller_state = 'NATION_0')::INTEGER, 0) AS s FROM final_items)
SELECT order_id, order_item_id, round(price, 6) AS price, e2 AS expected_delivery_days,
  x2 AS cross_state, 1 AS is_sp_customer, 1 + s AS sp_route_type,
  1 + s AS sp_route_type_customer, 2 * s AS sp_route_type_seller FROM w""")
def _(q: Inputs):
    # every order as if promised a week later to a customer in the hub state
    items = q.items(*features.ORDER_TIME_SOURCE)
    scenario = features.with_overrides(
        items, customer_state=q.hub, expected_delivery_days=F.col("expected_delivery_days") + 7)
    return features.order_time_frame(scenario, q.hub).select(
        "order_id", "order_item_id", "price", "expected_delivery_days", "cross_state",
        "is_sp_customer", "sp_route_type", "sp_route_type_customer", "sp_route_type_seller")
