"""Fixed schemas of the nine raw tables.

Nothing is inferred: schema inference costs a full extra scan and turns zip
prefixes into numbers.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# Column names and types of the raw data set.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        customer_id=_S, customer_unique_id=_S, customer_zip_code_prefix=_S,
        customer_city=_S, customer_state=_S,
    ),
    "geolocation": _struct(
        geolocation_zip_code_prefix=_S, geolocation_lat=_D, geolocation_lng=_D,
        geolocation_city=_S, geolocation_state=_S,
    ),
    "order_items": _struct(
        order_id=_S, order_item_id=_I, product_id=_S, seller_id=_S,
        shipping_limit_date=_TS, price=_D, freight_value=_D,
    ),
    "payments": _struct(
        order_id=_S, payment_sequential=_I, payment_type=_S,
        payment_installments=_I, payment_value=_D,
    ),
    "reviews": _struct(
        review_id=_S, order_id=_S, review_score=_I, review_comment_title=_S,
        review_comment_message=_S, review_creation_date=_TS, review_answer_timestamp=_TS,
    ),
    "orders": _struct(
        order_id=_S, customer_id=_S, order_status=_S, order_purchase_timestamp=_TS,
        order_approved_at=_TS, order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS, order_estimated_delivery_date=_TS,
    ),
    "products": _struct(
        product_id=_S, product_category_name=_S, product_name_lenght=_I,
        product_description_lenght=_I, product_photos_qty=_I, product_weight_g=_D,
        product_length_cm=_D, product_height_cm=_D, product_width_cm=_D,
    ),
    "sellers": _struct(
        seller_id=_S, seller_zip_code_prefix=_S, seller_city=_S, seller_state=_S,
    ),
    "category": _struct(product_category_name=_S, product_category_name_english=_S),
}
