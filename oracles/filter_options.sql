WITH options AS (
  SELECT DISTINCT 'state' AS field, state AS value FROM ops_orders
  UNION ALL SELECT DISTINCT 'zone', zone FROM ops_orders
  UNION ALL SELECT DISTINCT 'category', category FROM ops_orders
  UNION ALL SELECT DISTINCT 'segment', segment FROM ops_customers
)
SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY value) AS INTEGER) AS position, value FROM options
UNION ALL
SELECT field, 0, 'All' FROM (VALUES ('state'), ('zone'), ('category'), ('segment')) f(field)
