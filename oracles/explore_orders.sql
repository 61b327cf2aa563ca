
SELECT CAST(final_amount AS DOUBLE) AS final_amount, order_date, order_id, state, order_status
FROM ops_orders WHERE state = 'NATION_4' AND final_amount > 5000
ORDER BY ops_orders.final_amount, order_date, order_id, state, order_status LIMIT 500
