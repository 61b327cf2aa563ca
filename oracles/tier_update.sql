SELECT customer_id, full_name, segment, tier FROM ops_customers
