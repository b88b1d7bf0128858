"""pointloom: laser-scan analytics declared as Spark DataFrame plans."""
