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
),
o_before AS (
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
  WHERE o.order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND o.order_status <> 'Processing'
),
t_now AS (
  SELECT coalesce(CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / nullif(count(*), 0), 0) AS csat,
         coalesce(CAST(count(*) FILTER (WHERE t.status = 'Resolved') AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS resolution
  FROM ops_tickets t JOIN ops_customers c ON t.customer_id = c.customer_id
  WHERE t.created_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
),
t_before AS (
  SELECT coalesce(CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / nullif(count(*), 0), 0) AS csat,
         coalesce(CAST(count(*) FILTER (WHERE t.status = 'Resolved') AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS resolution
  FROM ops_tickets t JOIN ops_customers c ON t.customer_id = c.customer_id
  WHERE t.created_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
)
SELECT 'current' AS period_window, DATE '2000-01-01' AS window_start, DATE '2000-12-31' AS window_end,
       gmv, orders, customers, aov, csat, resolution, avg_delivery, return_rate, cancel_rate, total_discount, total_gst
FROM o_now, t_now
UNION ALL
SELECT 'prior', DATE '1999-01-01', DATE '1999-12-31',
       gmv, orders, customers, aov, csat, resolution, avg_delivery, return_rate, cancel_rate, total_discount, total_gst
FROM o_before, t_before
