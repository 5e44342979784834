"""Explicit schemas of the raw tables, the clickstream and its payload."""

CUSTOMERS = "customer_id string, first_name string, last_name string, email string, phone string, date_of_birth string, gender string, country string, city string, zip_code string, registration_date string, segment string"
PRODUCTS = "product_id string, product_name string, category_id string, category_name string, subcategory_name string, brand string, sku string, unit_price string, cost_price string, weight_kg double, is_active string, launch_date date"
ORDERS = "order_id string, customer_id string, order_date string, status string, shipping_method string, shipping_cost string, discount_amount string, tax_amount string, total_amount string, currency string, channel string"
ORDER_ITEMS = "order_item_id string, order_id string, product_id string, quantity string, unit_price string, discount_pct string, line_total string"
PAYMENTS = "payment_id string, order_id string, payment_date string, payment_method string, payment_status string, amount string, gateway string, transaction_ref string"
REVIEWS = "review_id string, product_id string, customer_id string, rating string, review_title string, review_body string, review_date string, helpful_votes string, verified_purchase string"
CLICKSTREAM = "event_id string, session_id string, customer_id string, event_type string, page_url string, product_id string, event_timestamp string, device_type string, browser string, referrer string, raw_json string"
KAFKA_VALUE = "event_id string, session_id string, customer_id string, event_type string, product_id string, event_timestamp string, device_type string, page_url string"
TABLES = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS, "order_items": ORDER_ITEMS, "payments": PAYMENTS, "reviews": REVIEWS, "clickstream": CLICKSTREAM}
