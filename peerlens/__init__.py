"""Point-in-time, peer-relative panel analytics as lazy Spark DataFrame operators."""
