"""Names and words that results depend on and that are not ours to choose."""

# Fixed values.

# Words that file names carry and table names drop or gain.
NAME_PREFIX = "olist_"
NAME_SUFFIX = "_dataset.csv"
TABLE_POSTFIX = "_data"

# File-name fragments, in the order they are tried.
ORDERS = "olist_orders_dataset"
ITEMS = "olist_order_items_dataset"
CUSTOMERS = "olist_customers_dataset"
PRODUCTS = "olist_products_dataset"
PAYMENTS = "olist_order_payments_dataset"

# The columns that get cleaned, the one added, and the filler.
PURCHASE_TIME = "order_purchase_timestamp"
LOAD_TIME = "processed_at"
PRICE = "price"
CUSTOMER = "customer_id"
CATEGORY = "product_category_name"
UNKNOWN = "unknown"

# The payment chart's column and labels.
PAYMENT_TYPE = "payment_type"
PAYMENT_TYPE_LABEL = "Тип оплаты"
PAYMENT_COUNT_LABEL = "Количество заказов"

POSTGRES_DRIVER = "org.postgresql.Driver"
