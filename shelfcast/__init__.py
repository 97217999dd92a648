"""shelfcast: order-shortage analytics on Spark.

Operators take and return DataFrames; see the sub-packages ``sources``,
``functions``, ``operators``, ``learners``, ``plans`` and ``streaming``.
"""

__version__ = "0.1.0"
