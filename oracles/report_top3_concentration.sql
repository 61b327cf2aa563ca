WITH states AS (
  SELECT o.state, sum(o.final_amount) AS revenue FROM ops_orders o
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status <> 'Processing' GROUP BY o.state
),
ranked AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, state) AS place FROM states)
SELECT CAST((SELECT sum(revenue) FROM ranked WHERE place <= 3) AS DOUBLE)
         / CAST((SELECT sum(revenue) FROM ranked) AS DOUBLE) * 100 AS top3_share,
       coalesce((SELECT state FROM ranked WHERE place = 4), 'other states') AS next_state
