
SELECT 'customers' AS table_name, 0 AS position, 'customer_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 1 AS primary_key, count(*) - count(customer_id) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 1 AS position, 'full_name' AS column_name, 'string' AS data_type, 1 AS not_null, 0 AS primary_key, count(*) - count(full_name) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 2 AS position, 'city' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(city) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 3 AS position, 'state' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(state) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 4 AS position, 'zone' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(zone) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 5 AS position, 'segment' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(segment) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 6 AS position, 'tier' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(tier) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 7 AS position, 'join_date' AS column_name, 'date' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(join_date) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 8 AS position, 'status' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(status) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'customers' AS table_name, 9 AS position, 'age_group' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(age_group) AS null_rows, count(*) AS total_rows FROM ops_customers
UNION ALL
SELECT 'orders' AS table_name, 0 AS position, 'order_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 1 AS primary_key, count(*) - count(order_id) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 1 AS position, 'customer_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(customer_id) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 2 AS position, 'order_date' AS column_name, 'date' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(order_date) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 3 AS position, 'delivery_date' AS column_name, 'date' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(delivery_date) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 4 AS position, 'amount' AS column_name, 'decimal(12,2)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(amount) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 5 AS position, 'gst_amount' AS column_name, 'decimal(12,2)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(gst_amount) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 6 AS position, 'discount' AS column_name, 'decimal(12,2)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(discount) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 7 AS position, 'final_amount' AS column_name, 'decimal(12,2)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(final_amount) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 8 AS position, 'category' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(category) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 9 AS position, 'product_name' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(product_name) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 10 AS position, 'payment_method' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(payment_method) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 11 AS position, 'order_status' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(order_status) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 12 AS position, 'city' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(city) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 13 AS position, 'state' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(state) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 14 AS position, 'zone' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(zone) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 15 AS position, 'delivery_days' AS column_name, 'int' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(delivery_days) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'orders' AS table_name, 16 AS position, 'is_returned' AS column_name, 'int' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(is_returned) AS null_rows, count(*) AS total_rows FROM ops_orders
UNION ALL
SELECT 'tickets' AS table_name, 0 AS position, 'ticket_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 1 AS primary_key, count(*) - count(ticket_id) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 1 AS position, 'customer_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(customer_id) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 2 AS position, 'agent_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(agent_id) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 3 AS position, 'created_date' AS column_name, 'date' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(created_date) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 4 AS position, 'ticket_category' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(ticket_category) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 5 AS position, 'priority' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(priority) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 6 AS position, 'status' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(status) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 7 AS position, 'csat_score' AS column_name, 'decimal(3,1)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(csat_tenths) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 8 AS position, 'resolution_hours' AS column_name, 'decimal(12,2)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(resolution_hours) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 9 AS position, 'first_response_h' AS column_name, 'decimal(14,4)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(first_response_h) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 10 AS position, 'is_repeat' AS column_name, 'int' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(is_repeat) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'tickets' AS table_name, 11 AS position, 'state' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(state) AS null_rows, count(*) AS total_rows FROM ops_tickets
UNION ALL
SELECT 'agents' AS table_name, 0 AS position, 'agent_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 1 AS primary_key, count(*) - count(agent_id) AS null_rows, count(*) AS total_rows FROM ops_agents
UNION ALL
SELECT 'agents' AS table_name, 1 AS position, 'agent_name' AS column_name, 'string' AS data_type, 1 AS not_null, 0 AS primary_key, count(*) - count(agent_name) AS null_rows, count(*) AS total_rows FROM ops_agents
UNION ALL
SELECT 'agents' AS table_name, 2 AS position, 'team' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(team) AS null_rows, count(*) AS total_rows FROM ops_agents
UNION ALL
SELECT 'agents' AS table_name, 3 AS position, 'shift' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(shift) AS null_rows, count(*) AS total_rows FROM ops_agents
UNION ALL
SELECT 'agents' AS table_name, 4 AS position, 'state' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(state) AS null_rows, count(*) AS total_rows FROM ops_agents
UNION ALL
SELECT 'returns' AS table_name, 0 AS position, 'return_id' AS column_name, 'string' AS data_type, 0 AS not_null, 1 AS primary_key, count(*) - count(return_id) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 1 AS position, 'order_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(order_id) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 2 AS position, 'customer_id' AS column_name, 'bigint' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(customer_id) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 3 AS position, 'return_date' AS column_name, 'date' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(return_date) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 4 AS position, 'reason' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(reason) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 5 AS position, 'refund_amount' AS column_name, 'decimal(12,2)' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(refund_amount) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 6 AS position, 'refund_status' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(refund_status) AS null_rows, count(*) AS total_rows FROM ops_returns
UNION ALL
SELECT 'returns' AS table_name, 7 AS position, 'state' AS column_name, 'string' AS data_type, 0 AS not_null, 0 AS primary_key, count(*) - count(state) AS null_rows, count(*) AS total_rows FROM ops_returns
