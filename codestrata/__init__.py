"""codestrata: code-intelligence analytics on Spark DataFrames.

Layers: ``sources`` reads file trees and tables, ``functions`` holds column
functions, ``parsing`` turns source text into record sets, ``operators`` holds
the DataFrame operators, ``plans`` the registered queries with their SQL,
``streaming`` the incremental jobs.  ``llm`` holds the operators that prepare
training text; nothing outside of it imports it.
"""

__version__ = "0.1.0"
