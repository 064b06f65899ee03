"""Canonical schemas (snake_case) and the sheet-header mapping.

Landed files are read with these explicit schemas; nothing is inferred.
``product_id`` is a string everywhere: sample product keys look like
``PROD_01`` even where the warehouse declares an integer.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, DBL, B, I = T.StringType(), T.DateType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ORDERS = _struct(
    ("order_id", S), ("order_date", D), ("ship_date", D), ("customer_id", S), ("product_id", S),
    ("category", S), ("quantity", L), ("sales", DBL), ("profit", DBL), ("discount", DBL),
    ("country", S), ("state", S), ("region", S),
)

RETURNS = _struct(
    ("return_date", D), ("order_id", S), ("customer_id", S), ("product_id", S),
    ("category", S), ("region", S),
)

PEOPLE = _struct(
    ("customer_id", S), ("customer_name", S), ("segment", S), ("region", S),
    ("first_order_date", D), ("last_order_date", D),
)

PRODUCTS = _struct(
    ("id", S), ("title", S), ("price", DBL), ("category", S), ("description", S), ("image", S),
)

INVENTORY = _struct(
    ("date", D), ("product_id", S), ("product_name", S), ("category", S), ("stock_level", L),
    ("daily_demand", L), ("restock_amount", L), ("restocked", B), ("price", DBL),
    ("original_price", DBL), ("price_change_pct", DBL), ("days_of_inventory", DBL),
    ("stockout_risk", B), ("annualized_turnover", DBL), ("fill_rate", DBL),
)

# JSON envelope {status, data: [rows], count} for each record feed.
def envelope(row_schema: T.StructType) -> T.StructType:
    return _struct(("status", S), ("data", T.ArrayType(row_schema)), ("count", I))


ANALYTICS_DOC = T.StructType([
    T.StructField("summary", _struct(
        ("total_orders", L), ("total_returns", L), ("total_customers", L),
        ("total_sales", DBL), ("avg_order_value", DBL),
    )),
    T.StructField("regional_sales", T.MapType(S, DBL)),
    T.StructField("category_sales", T.MapType(S, DBL)),
    T.StructField("monthly_sales", T.MapType(S, DBL)),
])

# Sheet headers as they appear in landed order / returns / people files.
SHEET_HEADERS = {
    "Order ID": "order_id", "Order Date": "order_date", "Ship Date": "ship_date",
    "Customer ID": "customer_id", "Product ID": "product_id", "Category": "category",
    "Quantity": "quantity", "Sales": "sales", "Profit": "profit", "Discount": "discount",
    "Country": "country", "State": "state", "Region": "region",
    "Return Date": "return_date", "Customer Name": "customer_name", "Segment": "segment",
    "First Order Date": "first_order_date", "Last Order Date": "last_order_date",
}
CANONICAL_TO_SHEET = {v: k for k, v in SHEET_HEADERS.items()}

# Warehouse: required (non-null) columns per table.
REQUIRED_FIELDS = {
    "dim_products": ["product_id", "product_name", "category", "price"],
    "dim_customers": ["customer_id", "customer_name"],
    "dim_time": ["date_id", "year", "month", "day", "quarter", "day_of_week", "is_weekend", "is_holiday"],
    "dim_locations": ["location_id", "country"],
    "fact_orders": ["order_id", "order_date", "customer_id", "product_id", "location_id", "quantity", "sales"],
    "fact_inventory": ["inventory_id", "date", "product_id", "stock_level", "daily_demand", "price"],
    "fact_returns": ["return_id", "return_date", "order_id", "customer_id", "product_id"],
}

# Warehouse DDL: column list, partition column and clustering (sort) columns.
WAREHOUSE_DDL = {
    "dim_products": (
        "product_id STRING, product_name STRING, category STRING, price DOUBLE, description STRING, "
        "image_url STRING, created_date TIMESTAMP, updated_date TIMESTAMP", None, ["category"]),
    "dim_customers": (
        "customer_id STRING, customer_name STRING, segment STRING, country STRING, city STRING, "
        "state STRING, postal_code STRING, region STRING, created_date TIMESTAMP, updated_date TIMESTAMP",
        None, ["segment", "country"]),
    "dim_time": (
        "date_id DATE, year INT, month INT, day INT, quarter INT, day_of_week INT, is_weekend BOOLEAN, "
        "is_holiday BOOLEAN", None, ["year", "month"]),
    "dim_locations": (
        "location_id STRING, country STRING, state STRING, city STRING, postal_code STRING, region STRING, "
        "created_date TIMESTAMP, updated_date TIMESTAMP", None, ["country", "state"]),
    "fact_orders": (
        "order_id STRING, ship_date DATE, delivery_date DATE, customer_id STRING, product_id STRING, "
        "location_id STRING, quantity BIGINT, sales DOUBLE, profit DOUBLE, discount DOUBLE, shipping_cost DOUBLE, "
        "lead_time_days BIGINT, order_cycle_time_days BIGINT, order_value DOUBLE, created_date TIMESTAMP, "
        "updated_date TIMESTAMP, order_date DATE", "order_date", ["customer_id", "product_id"]),
    "fact_inventory": (
        "inventory_id STRING, product_id STRING, stock_level BIGINT, daily_demand BIGINT, restock_amount BIGINT, "
        "restocked BOOLEAN, price DOUBLE, original_price DOUBLE, price_change_pct DOUBLE, days_of_inventory DOUBLE, "
        "stockout_risk BOOLEAN, annualized_turnover DOUBLE, fill_rate DOUBLE, created_date TIMESTAMP, "
        "updated_date TIMESTAMP, date DATE", "date", ["product_id"]),
    "fact_returns": (
        "return_id STRING, order_id STRING, customer_id STRING, product_id STRING, return_reason STRING, "
        "return_amount DOUBLE, created_date TIMESTAMP, updated_date TIMESTAMP, return_date DATE",
        "return_date", ["customer_id", "product_id"]),
}
