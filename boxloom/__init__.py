"""boxloom: a PySpark-native engine for curating captions and detection boxes."""
