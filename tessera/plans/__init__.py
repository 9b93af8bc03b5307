"""Query packs: SQL that runs unchanged on Spark and in the oracle, by inventory id."""
