"""Key indexes, ranks, mutable key stores and hot keys as Spark DataFrame plans."""
