"""gridlake: transmission-network analytics as composable PySpark DataFrame operators."""
