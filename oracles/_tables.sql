ops_places AS (
  SELECT c.c_custkey, n.n_name AS state, r.r_name AS zone,
         n.n_name || '-' || CAST(c.c_custkey % 5 AS VARCHAR) AS city
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
ops_lines AS (
  SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS amount,
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS gst_amount,
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS discount,
         p.p_type AS category, p.p_name AS product_name, o.o_orderpriority AS payment_method,
         CASE WHEN l.l_returnflag = 'R' THEN 'Returned'
              WHEN o.o_orderstatus = 'P' THEN 'Processing'
              WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'O' THEN 'Cancelled'
              WHEN l.l_linestatus = 'F' THEN 'Delivered'
              ELSE 'Shipped' END AS order_status,
         pl.city, pl.state, pl.zone,
         CAST(2 + (l.l_orderkey + l.l_linenumber) % 13 AS INTEGER) AS delivery_days,
         l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN ops_places pl ON o.o_custkey = pl.c_custkey
),
ops_orders AS (
  SELECT *, CAST(amount + gst_amount - discount AS DECIMAL(12,2)) AS final_amount,
         CAST(order_date + delivery_days AS DATE) AS delivery_date,
         CASE WHEN order_status = 'Returned' THEN 1 ELSE 0 END AS is_returned
  FROM ops_lines
),
ops_spend AS (
  SELECT c.c_custkey AS customer_id,
         coalesce(sum(CASE WHEN o.order_status = 'Delivered' THEN o.final_amount END), 0) AS spent
  FROM customer c LEFT JOIN ops_orders o ON o.customer_id = c.c_custkey
  GROUP BY c.c_custkey
),
ops_customers AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS full_name, pl.city, pl.state, pl.zone,
         c.c_mktsegment AS segment,
         CASE WHEN s.spent >= 500000 THEN 'Platinum' WHEN s.spent >= 200000 THEN 'Gold'
              WHEN s.spent >= 80000 THEN 'Silver' ELSE 'Bronze' END AS tier,
         CAST(DATE '1995-01-01' + CAST((c.c_custkey * 37) % 2190 AS INTEGER) AS DATE) AS join_date,
         CASE c.c_custkey % 7 WHEN 0 THEN 'Churned' WHEN 1 THEN 'At-Risk' ELSE 'Active' END AS status,
         CASE c.c_custkey % 5 WHEN 0 THEN '18-25' WHEN 1 THEN '26-35' WHEN 2 THEN '36-45'
                              WHEN 3 THEN '46-60' ELSE '60+' END AS age_group
  FROM customer c
  JOIN ops_places pl ON pl.c_custkey = c.c_custkey
  JOIN ops_spend s ON s.customer_id = c.c_custkey
),
ops_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS secs
  FROM events
),
ops_tickets AS (
  SELECT e.event_id AS ticket_id, e.user_id AS customer_id, e.event_id % 10 AS agent_id,
         CAST(DATE '1995-01-01' + CAST(e.secs // 1080 AS INTEGER) AS DATE) AS created_date,
         e.event_type AS ticket_category,
         CASE WHEN e.k < 25 THEN 'Low' WHEN e.k < 70 THEN 'Medium' WHEN e.k < 90 THEN 'High' ELSE 'Critical' END AS priority,
         CASE WHEN (7 * e.k + e.event_id) % 100 < 68 THEN 'Resolved'
              WHEN (7 * e.k + e.event_id) % 100 < 80 THEN 'Open'
              WHEN (7 * e.k + e.event_id) % 100 < 90 THEN 'Escalated' ELSE 'Pending' END AS status,
         10 + (e.event_id * 13) % 41 AS csat_tenths,
         CAST(e.value AS DECIMAL(12,2)) AS resolution_hours,
         CAST(CAST(e.value AS DECIMAL(12,2)) * 0.25 AS DECIMAL(14,4)) AS first_response_h,
         CASE WHEN e.event_id % 11 < 2 THEN 1 ELSE 0 END AS is_repeat,
         pl.state
  FROM ops_events e LEFT JOIN ops_places pl ON pl.c_custkey = e.user_id
),
ops_agents AS (
  SELECT s.s_suppkey AS agent_id, s.s_name AS agent_name,
         'Team-' || CAST(s.s_suppkey % 5 AS VARCHAR) AS team,
         'Shift-' || CAST(s.s_suppkey % 3 AS VARCHAR) AS shift, n.n_name AS state
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
),
ops_returns AS (
  SELECT 'RET' || CAST(order_id AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS return_id,
         order_id, customer_id,
         CAST(order_date + CAST(1 + order_id % 7 AS INTEGER) AS DATE) AS return_date,
         'Reason-' || CAST(l_partkey % 8 AS VARCHAR) AS reason,
         CAST(round(amount * CAST(85 + l_suppkey % 16 AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS refund_amount,
         CASE WHEN l_partkey % 100 < 70 THEN 'Completed' WHEN l_partkey % 100 < 88 THEN 'Pending'
              ELSE 'Processing' END AS refund_status,
         state
  FROM ops_orders WHERE is_returned = 1
)
