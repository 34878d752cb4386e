"""Document analytics on Spark: extraction, cleaning, block relations and a searchable library."""
