"""symgraph: a PySpark-native property-graph and document analytics engine."""
