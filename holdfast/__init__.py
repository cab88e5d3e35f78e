"""A PySpark-native engine for packed binary containers and the media inside them."""
