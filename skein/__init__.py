"""skein: a provenance-tracked knowledge view over mutable message logs, on PySpark."""
