WITH o_now AS (
  SELECT coalesce(CAST(sum(o.final_amount) AS DOUBLE), 0) AS gmv,
         coalesce(CAST(sum(o.discount) AS DOUBLE), 0) AS total_discount,
         coalesce(CAST(sum(o.gst_amount) AS DOUBLE), 0) AS total_gst,
         count(o.order_id) AS orders,
         count(DISTINCT o.customer_id) AS customers,
         coalesce(CAST(sum(o.final_amount) AS DOUBLE) / nullif(count(o.final_amount), 0), 0) AS aov,
         coalesce(CAST(sum(o.delivery_days) AS DOUBLE) / nullif(count(o.delivery_days), 0), 0) AS avg_delivery,
         coalesce(CAST(count(*) FILTER (WHERE o.order_status = 'Returned') AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS return_rate,
         coalesce(CAST(count(*) FILTER (WHERE o.order_status = 'Cancelled') AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS cancel_rate
  FROM ops_orders o JOIN ops_customers c ON o.customer_id = c.customer_id
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status <> 'Processing'
)
SELECT return_rate, CASE WHEN return_rate > 8 THEN 'above' ELSE 'within' END AS benchmark FROM o_now
