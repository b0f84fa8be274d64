"""threadmill: a Spark-native engine for message-shaped data.

Every operator is a function from DataFrames to a DataFrame that declares a
logical plan and leaves the physical strategy to Catalyst and AQE.  The
subpackage ``llm`` holds the operators for training data; nothing else imports
it.
"""

__version__ = "0.1.0"
