
SELECT min(order_date) AS first_day, max(order_date) AS last_day FROM ops_orders
