
SELECT order_id, customer_id, order_date, category, product_name, CAST(final_amount AS DOUBLE) AS final_amount,
       payment_method, order_status, state, zone, delivery_days
FROM ops_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' ORDER BY order_date DESC
