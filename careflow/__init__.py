"""careflow: clinical and population-health analytics as Spark DataFrame operators."""
