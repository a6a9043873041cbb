"""Spark-native analytics for user-item interaction data.

``operators`` holds DataFrame -> DataFrame functions, ``sources`` readers and
sinks, ``functions`` column expressions, ``plans`` the registered queries and
``streaming`` the Structured Streaming forms.  Subpackages that are optional
are never imported from here.
"""
