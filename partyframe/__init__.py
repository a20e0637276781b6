"""partyframe: column-partitioned (multi-party) analytics and learning on PySpark."""
