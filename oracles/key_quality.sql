
SELECT 'customers' AS table_name, 'primary key customer_id' AS rule, count(*) AS violations FROM (SELECT customer_id FROM ops_customers GROUP BY customer_id HAVING count(*) > 1)
UNION ALL
SELECT 'orders' AS table_name, 'primary key order_id' AS rule, count(*) AS violations FROM (SELECT order_id FROM ops_orders GROUP BY order_id HAVING count(*) > 1)
UNION ALL
SELECT 'tickets' AS table_name, 'primary key ticket_id' AS rule, count(*) AS violations FROM (SELECT ticket_id FROM ops_tickets GROUP BY ticket_id HAVING count(*) > 1)
UNION ALL
SELECT 'agents' AS table_name, 'primary key agent_id' AS rule, count(*) AS violations FROM (SELECT agent_id FROM ops_agents GROUP BY agent_id HAVING count(*) > 1)
UNION ALL
SELECT 'returns' AS table_name, 'primary key return_id' AS rule, count(*) AS violations FROM (SELECT return_id FROM ops_returns GROUP BY return_id HAVING count(*) > 1)
UNION ALL
SELECT 'orders', 'foreign key customer_id', count(*) FROM ops_orders x WHERE x.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ops_customers c WHERE c.customer_id = x.customer_id)
UNION ALL
SELECT 'tickets', 'foreign key customer_id', count(*) FROM ops_tickets x WHERE x.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ops_customers c WHERE c.customer_id = x.customer_id)
UNION ALL
SELECT 'customers', 'not null full_name', count(*) FROM ops_customers WHERE full_name IS NULL
UNION ALL
SELECT 'agents', 'not null agent_name', count(*) FROM ops_agents WHERE agent_name IS NULL
