"""relata: a relational-algebra engine on PySpark."""
