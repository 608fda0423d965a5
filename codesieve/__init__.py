"""codesieve: a Spark-native audit engine for source files, agent transcripts and event logs.

Every public operator is a function ``DataFrame -> DataFrame`` built from Catalyst
expressions; none of them runs an action.  See README.md for the operator list.
"""

__version__ = "0.1.0"
