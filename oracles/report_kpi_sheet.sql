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
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status <> 'Processing' AND o.state = 'NATION_3'
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
  WHERE o.order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND o.order_status <> 'Processing' AND o.state = 'NATION_3'
),
t_now AS (
  SELECT coalesce(CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / nullif(count(*), 0), 0) AS csat,
         coalesce(CAST(count(*) FILTER (WHERE t.status = 'Resolved') AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS resolution
  FROM ops_tickets t JOIN ops_customers c ON t.customer_id = c.customer_id
  WHERE t.created_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND t.state = 'NATION_3'
),
t_before AS (
  SELECT coalesce(CAST(sum(t.csat_tenths) AS DOUBLE) / 10 / nullif(count(*), 0), 0) AS csat,
         coalesce(CAST(count(*) FILTER (WHERE t.status = 'Resolved') AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS resolution
  FROM ops_tickets t JOIN ops_customers c ON t.customer_id = c.customer_id
  WHERE t.created_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND t.state = 'NATION_3'
),
kpis AS (
SELECT o.gmv, CASE WHEN p.gmv = 0 THEN 0 ELSE (CAST(o.gmv AS DOUBLE) - p.gmv) / p.gmv * 100 END AS gmv_delta,
       o.orders, CASE WHEN p.orders = 0 THEN 0 ELSE (CAST(o.orders AS DOUBLE) - p.orders) / p.orders * 100 END AS orders_delta,
       o.customers, CASE WHEN p.customers = 0 THEN 0 ELSE (CAST(o.customers AS DOUBLE) - p.customers) / p.customers * 100 END AS customers_delta,
       o.aov, CASE WHEN p.aov = 0 THEN 0 ELSE (CAST(o.aov AS DOUBLE) - p.aov) / p.aov * 100 END AS aov_delta,
       t.csat, CASE WHEN q.csat = 0 THEN 0 ELSE (CAST(t.csat AS DOUBLE) - q.csat) / q.csat * 100 END AS csat_delta,
       t.resolution, CASE WHEN q.resolution = 0 THEN 0 ELSE (CAST(t.resolution AS DOUBLE) - q.resolution) / q.resolution * 100 END AS resolution_delta,
       o.avg_delivery, o.return_rate, o.cancel_rate, o.total_discount, o.total_gst
FROM o_now o, o_before p, t_now t, t_before q
)
SELECT 1 AS position, 'Gross Merchandise Value' AS label, gmv / 100000 AS value, '₹' || printf('%.1f', gmv / 100000) || 'L' AS shown, gmv_delta AS delta, CASE WHEN gmv_delta >= 0 THEN '+' ELSE '' END || printf('%.1f', gmv_delta) || '%' AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 2 AS position, 'Total Orders' AS label, CAST(orders AS DOUBLE) AS value, format('{:,}', orders) AS shown, orders_delta AS delta, CASE WHEN orders_delta >= 0 THEN '+' ELSE '' END || printf('%.1f', orders_delta) || '%' AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 3 AS position, 'Active Customers' AS label, CAST(customers AS DOUBLE) AS value, format('{:,}', customers) AS shown, customers_delta AS delta, CASE WHEN customers_delta >= 0 THEN '+' ELSE '' END || printf('%.1f', customers_delta) || '%' AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 4 AS position, 'Avg Order Value' AS label, aov AS value, '₹' || format('{:,.0f}', aov) AS shown, aov_delta AS delta, CASE WHEN aov_delta >= 0 THEN '+' ELSE '' END || printf('%.1f', aov_delta) || '%' AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 5 AS position, 'CSAT Score' AS label, csat AS value, printf('%.2f', csat) AS shown, csat_delta AS delta, CASE WHEN csat_delta >= 0 THEN '+' ELSE '' END || printf('%.1f', csat_delta) || '%' AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 6 AS position, 'Resolution Rate' AS label, resolution AS value, printf('%.0f', resolution) || '%' AS shown, resolution_delta AS delta, CASE WHEN resolution_delta >= 0 THEN '+' ELSE '' END || printf('%.1f', resolution_delta) || '%' AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 7 AS position, 'Return Rate' AS label, return_rate AS value, printf('%.1f', return_rate) || '%' AS shown, CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS VARCHAR) AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 8 AS position, 'Avg Delivery Days' AS label, avg_delivery AS value, printf('%.1f', avg_delivery) || 'd' AS shown, CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS VARCHAR) AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 9 AS position, 'Total GST Collected' AS label, total_gst AS value, '₹' || format('{:,.0f}', total_gst) AS shown, CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS VARCHAR) AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 10 AS position, 'Total Discounts Given' AS label, total_discount AS value, '₹' || format('{:,.0f}', total_discount) AS shown, CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS VARCHAR) AS delta_shown, 'State: NATION_3' AS filters FROM kpis
UNION ALL
SELECT 11 AS position, 'Cancellation Rate' AS label, cancel_rate AS value, printf('%.1f', cancel_rate) || '%' AS shown, CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS VARCHAR) AS delta_shown, 'State: NATION_3' AS filters FROM kpis
