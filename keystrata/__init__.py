"""keystrata: cryptographic inventory analytics as Spark DataFrame operators."""
