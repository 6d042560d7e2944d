"""Types of the columns the jobs use, per source table; other columns load as text."""

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_TS = T.TimestampNTZType()


def _struct(**fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


TABLES = {
    "orders": _struct(
        order_id=_S,
        customer_id=_S,
        order_status=_S,
        order_purchase_timestamp=_TS,
        order_approved_at=_TS,
        order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS,
        order_estimated_delivery_date=_TS,
    ),
    "order_items": _struct(
        order_id=_S,
        order_item_id=_I,
        product_id=_S,
        seller_id=_S,
        shipping_limit_date=_TS,
        price=_D,
        freight_value=_D,
    ),
    "order_payments": _struct(
        order_id=_S,
        payment_sequential=_I,
        payment_type=_S,
        payment_installments=_I,
        payment_value=_D,
    ),
    "order_reviews": _struct(
        review_id=_S,
        order_id=_S,
        review_score=_I,
        review_comment_title=_S,
        review_comment_message=_S,
        review_creation_date=_TS,
        review_answer_timestamp=_TS,
    ),
    "customers": _struct(
        customer_id=_S,
        customer_unique_id=_S,
        customer_city=_S,
        customer_state=_S,
    ),
    "products": _struct(
        product_id=_S,
        product_category_name=_S,
        product_weight_g=_D,
    ),
    "sellers": _struct(seller_id=_S, seller_state=_S),
    "geolocation": _struct(),
    "category_translation": _struct(
        product_category_name=_S,
        product_category_name_english=_S,
    ),
}
