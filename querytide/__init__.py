"""Search-demand analytics as DataFrame operators: many seeds and markets in one Spark job."""
