"""Table schemas and closed vocabularies of the retail star schema."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)



CUSTOMERS_DDL = """
customer_id string, customer_name string, customer_age int, gender string, customer_segment string,
customer_city string, customer_state string, customer_country string, region string,
customer_postal_code string, customer_acquisition_cost decimal(10,2)
"""
PRODUCTS_DDL = """
product_id string, product_name string, product_category string, product_subcategory string, brand string,
supplier string, unit_price decimal(12,2), product_cost decimal(12,2), product_rating decimal(3,2)
"""
ORDERS_DDL = """
order_id string, customer_id string, order_date date, order_time string, order_status string,
sales_channel string, customer_type string, region string, payment_method string, payment_status string,
currency string, shipping_method string, warehouse string, delivery_days decimal(6,2),
estimated_delivery_days decimal(6,2), delivery_status string, return_status string, return_reason string,
marketing_channel string, campaign_name string, coupon_code string, loyalty_points_earned int,
loyalty_points_redeemed int, quantity int, gross_sales decimal(12,2), discount_amount decimal(12,2),
tax_amount decimal(12,2), shipping_cost decimal(12,2), net_sales decimal(12,2), product_cost decimal(12,2),
profit decimal(12,2), profit_margin_percentage decimal(6,2), customer_lifetime_value decimal(12,2),
is_repeat_customer boolean, customer_order_count int
"""
ORDER_ITEMS_DDL = """
order_id string, product_id string, quantity int, unit_price decimal(12,2), discount_percentage decimal(6,4),
discount_amount decimal(12,2), gross_sales decimal(12,2), tax_amount decimal(12,2),
shipping_cost decimal(12,2), net_sales decimal(12,2), product_cost decimal(12,2), profit decimal(12,2)
"""
RATINGS_DDL = "order_id string, customer_id string, rating decimal(3,1), review_sentiment string, customer_review string"
CHUNKS_DDL = """
id bigint, doc_title string, section_title string, chunk_text string, embedding array<float>,
metadata struct<source_file:string, section_index:int, word_count:int, embedding_model:string, embedding_dim:int>
"""

DDL = {
    "customers": CUSTOMERS_DDL,
    "products": PRODUCTS_DDL,
    "orders": ORDERS_DDL,
    "order_items": ORDER_ITEMS_DDL,
    "ratings": RATINGS_DDL,
    "chunks": CHUNKS_DDL,
}

PRIMARY_KEY = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "ratings": "order_id"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(DDL[table].split()))


# The closed vocabularies of the categorical columns.
VOCABULARIES: dict[str, tuple[str, ...]] = {
    "gender": ("Male", "Female", "Non-Binary"),
    "customer_segment": ("Consumer", "Premium", "VIP", "Business"),
    "customer_type": ("Loyal", "New", "Returning"),
    "region": ("Central", "East", "North", "South", "West"),
    "order_status": ("Cancelled", "Completed", "Pending", "Returned"),
    "delivery_status": ("Cancelled", "Delayed", "Early", "On Time"),
    "payment_status": ("Failed", "Paid", "Pending", "Refunded"),
    "payment_method": (
        "Bank Transfer",
        "Buy Now Pay Later",
        "Cash on Delivery",
        "Credit Card",
        "Debit Card",
        "Digital Wallet",
        "PayPal",
    ),
    "shipping_method": ("Economy", "Express", "Same Day", "Standard"),
    "sales_channel": ("Marketplace", "Mobile App", "Social Media", "Website"),
    "marketing_channel": (
        "Affiliate",
        "Direct",
        "Email Marketing",
        "Facebook Ads",
        "Google Ads",
        "Instagram",
        "Organic Search",
        "Referral",
        "TikTok",
        "YouTube",
    ),
    "currency": ("AED", "AUD", "CAD", "EUR", "GBP", "INR", "USD"),
    "review_sentiment": ("Negative", "Neutral", "Positive"),
    "product_category": (
        "Automotive",
        "Baby & Kids",
        "Beauty & Personal Care",
        "Books & Media",
        "Electronics",
        "Fashion",
        "Grocery",
        "Health & Wellness",
        "Home & Kitchen",
        "Home Appliances",
        "Jewelry",
        "Office Supplies",
        "Pet Supplies",
        "Sports & Outdoors",
        "Toys & Games",
    ),
}

# The reasons recorded on returned orders, with the group each belongs to.
RETURN_REASONS: dict[str, str] = {
    "Wrong Product": "fulfilment",
    "Other": "customer",
    "Changed Mind": "customer",
    "Size Issue": "quality",
    "Defective Product": "quality",
    "Late Delivery": "fulfilment",
    "Product Not as Expected": "quality",
    "Damaged Product": "fulfilment",
}

# Marketing channel groups.
PAID_CHANNELS = ("Affiliate", "Facebook Ads", "Google Ads", "Instagram", "TikTok", "YouTube")
SOCIAL_CHANNELS = ("Facebook Ads", "Instagram", "TikTok", "YouTube")


def check_vocabulary(column: str, value: str | None) -> str | None:
    """The value itself, or ValueError when it is outside the column's vocabulary."""
    if value is not None and column in VOCABULARIES and value not in VOCABULARIES[column]:
        raise ValueError(f"{value!r} is not a {column}; expected one of {list(VOCABULARIES[column])}")
    return value
