"""tessera: seed-based decontamination of large sequence and text collections on Spark."""
