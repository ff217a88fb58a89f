"""PySpark-native analytics for recorded web-application interaction data.

Everything is expressed with DataFrames; nothing here runs at import time.
"""

__version__ = "0.1.0"
