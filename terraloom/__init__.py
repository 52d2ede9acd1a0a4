"""terraloom: climate and earth-observation analytics as PySpark DataFrame operators."""
