"""orgweave: entity resolution and ownership graphs as Spark DataFrame plans."""
