"""Shardloom: a PySpark-native engine that plans, routes and checks the movement of table rows between shards."""
